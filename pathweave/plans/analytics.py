"""Queries over the star schema, in the query language, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine, Session
from ..model import Model
from ..operators import tree as T

SPEC = {
    "region": {"elements": {"r_regionkey": {"type": "Integer", "key": True}, "r_name": "String", "nations": {"target": "nation", "many": True, "on": "nations.region = $self"}}},
    "nation": {
        "elements": {
            "n_nationkey": {"type": "Integer", "key": True},
            "n_name": "String",
            "n_regionkey": "Integer",
            "region": {"target": "region", "on": "region.r_regionkey = n_regionkey"},
            "customers": {"target": "customer", "many": True, "on": "customers.c_nationkey = n_nationkey"},
        }
    },
    "customer": {
        "elements": {
            "c_custkey": {"type": "Integer64", "key": True},
            "c_name": "String",
            "c_nationkey": "Integer",
            "c_acctbal": "Double",
            "c_mktsegment": "String",
            "nation": {"target": "nation", "on": "nation.n_nationkey = c_nationkey"},
            "orders": {"target": "orders", "many": True, "on": "orders.o_custkey = c_custkey", "composition": True},
            "rich": {"type": "Boolean", "calc": "c_acctbal > 5000"},
        }
    },
    "supplier": {
        "elements": {
            "s_suppkey": {"type": "Integer64", "key": True},
            "s_name": "String",
            "s_nationkey": "Integer",
            "s_acctbal": "Double",
            "nation": {"target": "nation", "on": "nation.n_nationkey = s_nationkey"},
            "lineitems": {"target": "lineitem", "many": True, "on": "lineitems.l_suppkey = s_suppkey"},
            "richer": {"target": "supplier", "many": True, "on": "richer.s_nationkey = s_nationkey and richer.s_acctbal > s_acctbal"},
        }
    },
    "part": {"elements": {"p_partkey": {"type": "Integer64", "key": True}, "p_name": "String", "p_brand": "String", "p_type": "String", "p_size": "Integer", "p_retailprice": "Double", "lineitems": {"target": "lineitem", "many": True, "on": "lineitems.l_partkey = p_partkey"}}},
    "orders": {
        "elements": {
            "o_orderkey": {"type": "Integer64", "key": True},
            "o_custkey": "Integer64",
            "o_orderstatus": {"type": "String", "enum": {"open": "O", "filled": "F", "partial": "P"}},
            "o_totalprice": "Double",
            "o_orderdate": "Timestamp",
            "o_orderpriority": "String",
            "customer": {"target": "customer", "on": "customer.c_custkey = o_custkey"},
            "items": {"target": "lineitem", "many": True, "on": "items.l_orderkey = o_orderkey", "composition": True},
        }
    },
    "lineitem": {
        "elements": {
            "l_orderkey": {"type": "Integer64", "key": True},
            "l_partkey": "Integer64",
            "l_suppkey": "Integer64",
            "l_linenumber": {"type": "Integer", "key": True},
            "l_quantity": "Double",
            "l_extendedprice": "Double",
            "l_discount": "Double",
            "l_tax": "Double",
            "l_returnflag": "String",
            "l_linestatus": "String",
            "l_shipdate": "Timestamp",
            "net": {"type": "Double", "calc": "l_extendedprice * (1 - l_discount)"},
            "order": {"target": "orders", "on": "order.o_orderkey = l_orderkey"},
            "part": {"target": "part", "on": "part.p_partkey = l_partkey"},
            "supplier": {"target": "supplier", "on": "supplier.s_suppkey = l_suppkey"},
        }
    },
    "events": {"elements": {"event_id": {"type": "Integer64", "key": True}, "ts": "Timestamp", "user_id": "Integer64", "event_type": "String", "value": "Double", "props": "LargeString"}},
    "orders_above": {
        "elements": {"o_orderkey": {"type": "Integer64", "key": True}, "o_totalprice": "Double", "o_custkey": "Integer64", "customer": {"target": "customer", "on": "customer.c_custkey = o_custkey"}},
        "query": "SELECT from orders { o_orderkey, o_totalprice, o_custkey } where o_totalprice > :least",
        "params": {"least": "Double"},
    },
    "big_orders": {
        "elements": {"o_orderkey": {"type": "Integer64", "key": True}, "nation": "String", "o_totalprice": "Double"},
        "query": "SELECT from orders { o_orderkey, customer.nation.n_name as nation, o_totalprice } where o_totalprice > 300000",
    },
    "buyers": {
        "elements": {
            "id": {"type": "Integer64", "key": True},
            "address": {"elements": {"nation": "Integer", "balance": "Double"}},
            "other": {"elements": {"nation": "Integer", "balance": "Double"}},
            "home": {"target": "nation", "keys": {"n_nationkey": "key"}},
        },
        "query": "SELECT from customer { c_custkey as id, c_nationkey as address_nation, c_acctbal as address_balance, c_nationkey as other_nation, abs(c_acctbal) as other_balance, c_nationkey as home_key }",
    },
    "books": {
        "elements": {
            "ID": {"type": "Integer", "key": True},
            "title": {"type": "String", "localized": True},
            "descr": {"type": "String", "localized": True},
            "author_ID": "Integer",
            "price": "Decimal",
            "author": {"target": "authors", "on": "author.ID = author_ID"},
        },
        "texts": "books_texts",
    },
    "books_texts": {"elements": {"text_ID": {"type": "Integer64", "key": True}, "ID": "Integer", "locale": "String", "title": "String", "descr": "String"}},
    "authors": {"elements": {"ID": {"type": "Integer", "key": True}, "name": "String", "city": "String", "books": {"target": "books", "many": True, "on": "books.author_ID = ID"}}},
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def engine(spark: SparkSession, d: str, **session) -> Engine:
    e = Engine(spark, Model.from_dict(SPEC), Session(**session) if session else None)
    e.bind_parquet(d, *TABLES)
    # deliveries repeat rows: one per key
    e.bind("books", spark.read.parquet(f"{d}/books.parquet").dropDuplicates(["ID"]))
    e.bind("authors", spark.read.parquet(f"{d}/authors.parquet").groupBy("ID").agg(F.min("name").alias("name"), F.min("city").alias("city")))
    texts = spark.read.parquet(f"{d}/books_texts.parquet").groupBy("ID", "locale").agg(F.min(F.struct("text_ID", "title", "descr")).alias("t"))
    e.bind("books_texts", texts.select("t.text_ID", "ID", "locale", "t.title", "t.descr"))
    return e


#: name -> (query of the language, SQL)
PAIRS: dict[str, tuple[str, str]] = {
    "flagship": (
        """SELECT from lineitem { order.customer.nation.region.r_name as region, round(sum(net), 2) as revenue, count(*) as n }
        where order.o_orderdate >= cast('1996-01-01' as Timestamp) group by order.customer.nation.region.r_name order by revenue desc""",
        """select r_name as region, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem left join orders on o_orderkey = l_orderkey
        left join customer on c_custkey = o_custkey left join nation on n_nationkey = c_nationkey left join region on r_regionkey = n_regionkey
        where o_orderdate >= timestamp '1996-01-01' group by r_name""",
    ),
    "scan_filter": ("SELECT from lineitem { l_orderkey, l_linenumber, l_quantity } where l_quantity >= 45 and l_discount < 0.05", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity >= 45 and l_discount < 0.05"),
    "project_expr": ("SELECT from part { p_partkey, p_retailprice * 1.1 as gross, p_size + 1 as size1, p_brand || '/' || p_type as label }", "select p_partkey, p_retailprice * 1.1e0 as gross, p_size + 1 as size1, p_brand || '/' || p_type as label from part"),
    "wildcard_excluding": ("SELECT from customer { *, 'x' as c_name } excluding { c_acctbal }", "select c_custkey, 'x' as c_name, c_nationkey, c_mktsegment, c_acctbal > 5000 as rich from customer"),
    "cast_expr": ("SELECT from part { p_partkey, cast(p_retailprice as Integer) as whole, cast(p_size as String) as s }", "select p_partkey, cast(trunc(p_retailprice) as integer) as whole, cast(p_size as varchar) as s from part"),
    "case_expr": ("SELECT from orders { o_orderkey, case when o_totalprice > 200000 then 'high' when o_totalprice > 100000 then 'mid' else 'low' end as band, o_orderstatus = 'O' ? 1 : 0 as is_open }", "select o_orderkey, case when o_totalprice > 200000 then 'high' when o_totalprice > 100000 then 'mid' else 'low' end as band, case when o_orderstatus = 'O' then 1 else 0 end as is_open from orders"),
    "eq_null_literal": ("SELECT from (SELECT from orders { o_orderkey, nullif(o_orderstatus, 'F') as st }) as o { o_orderkey } where st = null", "select o_orderkey from orders where nullif(o_orderstatus, 'F') is null"),
    "null_safe_eq": ("SELECT from (SELECT from orders { o_orderkey, nullif(o_orderstatus, 'F') as st, nullif(o_orderpriority, '1-URGENT') as pr }) as o { o_orderkey, st == pr as same, st == 'O' as open_ }", "select o_orderkey, nullif(o_orderstatus, 'F') is not distinct from nullif(o_orderpriority, '1-URGENT') as same, nullif(o_orderstatus, 'F') is not distinct from 'O' as open_ from orders"),
    "null_safe_ne": ("SELECT from (SELECT from orders { o_orderkey, nullif(o_orderstatus, 'F') as st }) as o { o_orderkey } where st != 'O'", "select o_orderkey from orders where nullif(o_orderstatus, 'F') is distinct from 'O'"),
    "ne_three_valued": ("SELECT from (SELECT from orders { o_orderkey, nullif(o_orderstatus, 'F') as st }) as o { o_orderkey } where st <> 'O'", "select o_orderkey from orders where nullif(o_orderstatus, 'F') <> 'O'"),
    "in_list": ("SELECT from orders { o_orderkey } where o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderstatus not in ('P')", "select o_orderkey from orders where o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderstatus not in ('P')"),
    "row_in_list": ("SELECT from lineitem { l_orderkey, l_linenumber } where (l_returnflag, l_linestatus) in (('A', 'F'), ('N', 'O'))", "select l_orderkey, l_linenumber from lineitem where (l_returnflag, l_linestatus) in (('A', 'F'), ('N', 'O'))"),
    "in_empty": ("SELECT from (SELECT from orders { o_orderkey, nullif(o_orderstatus, 'F') as st }) as o { o_orderkey } where st in []", "select o_orderkey from orders where nullif(o_orderstatus, 'F') is null"),
    "not_in_empty": ("SELECT from (SELECT from orders { o_orderkey, nullif(o_orderstatus, 'F') as st }) as o { o_orderkey } where st not in []", "select o_orderkey from orders where nullif(o_orderstatus, 'F') is not null"),
    "in_subquery": ("SELECT from orders { o_orderkey } where o_custkey in (SELECT from customer { c_custkey } where c_mktsegment = 'BUILDING')", "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')"),
    "not_in_subquery": ("SELECT from customer { c_custkey } where c_custkey not in (SELECT from orders { o_custkey } where o_totalprice > 100000)", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 100000)"),
    "between_like": ("SELECT from part { p_partkey, p_name } where p_size between 10 and 20 and p_type not like '%MED%' and p_size not between 12 and 13", "select p_partkey, p_name from part where p_size between 10 and 20 and p_type not like '%MED%' and p_size not between 12 and 13"),
    "like_regex": ("SELECT from customer { c_custkey } where c_name like /0[0-4]$/", "select c_custkey from customer where regexp_matches(c_name, '0[0-4]$')"),
    "path_left_join": ("SELECT from customer { c_custkey, nation.n_name }", "select c_custkey, n_name as nation_n_name from customer left join nation on n_nationkey = c_nationkey"),
    "path_deep_4hop": ("SELECT from lineitem { l_orderkey, l_linenumber, order.customer.nation.region.r_name as region } where order.customer.nation.region.r_name = 'ASIA'", "select l_orderkey, l_linenumber, r_name as region from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey where r_name = 'ASIA'"),
    "path_dedup": ("SELECT from orders { o_orderkey, customer.c_name as name, customer.c_mktsegment as seg } where customer.c_acctbal > 0", "select o_orderkey, c_name as name, c_mktsegment as seg from orders left join customer on c_custkey = o_custkey where c_acctbal > 0"),
    "fk_access_no_join": ("SELECT from buyers { id, home.n_nationkey as nation_key }", "select c_custkey as id, c_nationkey as nation_key from customer"),
    "managed_path": ("SELECT from buyers { id, home.n_name as nation, home.region.r_name as region }", "select c_custkey as id, n_name as nation, r_name as region from customer left join nation on n_nationkey = c_nationkey left join region on r_regionkey = n_regionkey"),
    "path_infix_filter": ("SELECT from orders { o_orderkey, customer[c_acctbal > 0].c_name as name }", "select o_orderkey, c_name as name from orders left join customer on c_custkey = o_custkey and c_acctbal > 0"),
    "path_filter_with_path": ("SELECT from orders { o_orderkey, customer[nation.n_name = 'FRANCE'].c_name as name }", "select o_orderkey, c_name as name from orders left join (select c.* from customer c join nation on n_nationkey = c_nationkey where n_name = 'FRANCE') on c_custkey = o_custkey"),
    "path_unmanaged": ("SELECT from supplier { s_suppkey, richer.s_suppkey as richer_key }", "select a.s_suppkey, b.s_suppkey as richer_key from supplier a left join supplier b on b.s_nationkey = a.s_nationkey and b.s_acctbal > a.s_acctbal"),
    "to_many_path": ("SELECT from nation { n_name, customers.c_custkey as cust }", "select n_name, c_custkey as cust from nation left join customer on c_nationkey = n_nationkey"),
    "explicit_inner_join": ("SELECT from orders as o inner join customer as c on o.o_custkey = c.c_custkey { o.o_orderkey, c.c_name }", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey"),
    "explicit_left_join": ("SELECT from customer as c left join orders as o on o.o_custkey = c.c_custkey and o.o_totalprice > 300000 { c.c_custkey, o.o_orderkey }", "select c_custkey, o_orderkey from customer left join orders on o_custkey = c_custkey and o_totalprice > 300000"),
    "cross_join": ("SELECT from region as a cross join nation as b { a.r_name, b.n_name }", "select r_name, n_name from region, nation"),
    "theta_join": ("SELECT from nation as a inner join nation as b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey { a.n_name as x, b.n_name as y }", "select a.n_name as x, b.n_name as y from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey"),
    "exists_path": ("SELECT from customer { c_custkey } where exists orders", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey)"),
    "not_exists_path": ("SELECT from customer { c_custkey } where not exists orders[o_totalprice > 200000]", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 200000)"),
    "exists_nested_filter": ("SELECT from nation { n_name } where exists customers.orders[exists items[l_quantity > 49 and part.p_size < 5]]", "select n_name from nation where exists (select 1 from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey where c_nationkey = n_nationkey and l_quantity > 49 and p_size < 5)"),
    "exists_in_case": ("SELECT from customer { c_custkey, exists orders[o_orderstatus = 'P'] ? 'yes' : 'no' as partly }", "select c_custkey, case when exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P') then 'yes' else 'no' end as partly from customer"),
    "exists_or": ("SELECT from customer { c_custkey } where exists orders[o_totalprice > 400000] or c_acctbal < 0", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000) or c_acctbal < 0"),
    "exists_subquery": ("SELECT from customer as c { c_custkey } where exists (SELECT from orders as o { o_orderkey } where o.o_custkey = c.c_custkey and o.o_orderstatus = 'P')", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')"),
    "path_in_from": ("SELECT from region[r_name = 'EUROPE']:nations.customers { c_custkey, c_name }", "select c_custkey, c_name from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey where r_name = 'EUROPE'"),
    "from_filter_key": ("SELECT from nation[7] { n_name }", "select n_name from nation where n_nationkey = 7"),
    "scalar_subquery": ("SELECT from nation as n { n_name, (SELECT from customer as c { count(*) as k } where c.c_nationkey = n.n_nationkey) as customers }", "select n_name, (select count(*) from customer where c_nationkey = n_nationkey) as customers from nation"),
    "derived_table": ("SELECT from (SELECT from orders { o_custkey, sum(o_totalprice) as total } group by o_custkey) as t { o_custkey, round(total, 2) as total } where total > 1000000", "select o_custkey, round(total, 2) as total from (select o_custkey, sum(o_totalprice) as total from orders group by o_custkey) where total > 1000000"),
    "cte": ("WITH t as (SELECT from orders { o_custkey, count(*) as n } group by o_custkey) SELECT from t { n, count(*) as customers } group by n", "with t as (select o_custkey, count(*) as n from orders group by o_custkey) select n, count(*) as customers from t group by n"),
    "group_by_path": ("SELECT from orders { customer.nation.n_name as nation, count(*) as n, round(avg(o_totalprice), 4) as mean } group by customer.nation.n_name", "select n_name as nation, count(*) as n, round(avg(o_totalprice), 4) as mean from orders left join customer on c_custkey = o_custkey left join nation on n_nationkey = c_nationkey group by n_name"),
    "having": ("SELECT from orders { o_custkey, count(*) as n } group by o_custkey having count(*) > 15 and max(o_totalprice) > 200000", "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 15 and max(o_totalprice) > 200000"),
    "count_distinct": ("SELECT from lineitem { l_returnflag, countdistinct(l_partkey) as parts, count(distinct l_suppkey) as suppliers, average(l_quantity) as mean } group by l_returnflag", "select l_returnflag, count(distinct l_partkey) as parts, count(distinct l_suppkey) as suppliers, avg(l_quantity) as mean from lineitem group by l_returnflag"),
    "string_agg": ("SELECT from nation { n_regionkey, string_agg(n_name, ', ') as names } group by n_regionkey", "select n_regionkey, string_agg(n_name, ', ' order by n_name) as names from nation group by n_regionkey"),
    "distinct": ("SELECT distinct from lineitem { l_returnflag, l_linestatus }", "select distinct l_returnflag, l_linestatus from lineitem"),
    "group_by_expand": ("SELECT from orders { customer { c_mktsegment }, count(*) as n } group by customer.c_mktsegment", "select c_mktsegment as seg, count(*) as n from orders left join customer on c_custkey = o_custkey group by c_mktsegment"),
    "order_nulls": ("SELECT from (SELECT from orders { o_orderkey, nullif(o_orderpriority, '1-URGENT') as pr }) as o { o_orderkey, pr } order by pr, o_orderkey limit 50", "select o_orderkey, nullif(o_orderpriority, '1-URGENT') as pr from orders order by pr asc nulls first, o_orderkey limit 50"),
    "limit_offset": ("SELECT from orders { o_orderkey, o_totalprice } order by o_totalprice desc, o_orderkey limit 20 offset 10", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20 offset 10"),
    "one_row": ("SELECT one from orders { o_orderkey } order by o_totalprice desc, o_orderkey limit 5 offset 2", "select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 1 offset 2"),
    "win_row_number": ("SELECT from orders { o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rn }", "select o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rn from orders"),
    "win_rank_family": ("SELECT from supplier { s_suppkey, rank() over (order by s_nationkey) as r, dense_rank() over (order by s_nationkey) as dr, percent_rank() over (order by s_nationkey) as pr, cume_dist() over (order by s_nationkey) as cd, ntile(4) over (order by s_suppkey) as nt }", "select s_suppkey, rank() over (order by s_nationkey) as r, dense_rank() over (order by s_nationkey) as dr, percent_rank() over (order by s_nationkey) as pr, cume_dist() over (order by s_nationkey) as cd, ntile(4) over (order by s_suppkey) as nt from supplier"),
    "win_lag_lead": ("SELECT from orders { o_orderkey, lag(o_totalprice) over (partition by o_custkey order by o_orderkey) as before, lead(o_totalprice, 2, 0.0) over (partition by o_custkey order by o_orderkey) as after2 }", "select o_orderkey, lag(o_totalprice) over (partition by o_custkey order by o_orderkey) as before, lead(o_totalprice, 2, 0.0) over (partition by o_custkey order by o_orderkey) as after2 from orders"),
    "win_first_last_nth": ("SELECT from orders { o_orderkey, first_value(o_orderkey) over (partition by o_custkey order by o_orderkey) as f, last_value(o_orderkey) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and unbounded following) as l, nth_value(o_orderkey, 2) over (partition by o_custkey order by o_orderkey) as n2 }", "select o_orderkey, first_value(o_orderkey) over w as f, last_value(o_orderkey) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and unbounded following) as l, nth_value(o_orderkey, 2) over w as n2 from orders window w as (partition by o_custkey order by o_orderkey)"),
    "win_agg_partition": ("SELECT from orders { o_orderkey, count(*) over (partition by o_custkey) as n, max(o_totalprice) over (partition by o_custkey) as top }", "select o_orderkey, count(*) over (partition by o_custkey) as n, max(o_totalprice) over (partition by o_custkey) as top from orders"),
    "fn_string": ("SELECT from part { p_partkey, length(p_name) as len, tolower(p_brand) as lo, toupper(p_name) as up, concat(p_brand, '-', p_type) as cc, indexof(p_name, 'a') as ix, startswith(p_type, 'PROMO') as sw, endswith(p_type, 'UM') as ew, trim('  x ') as tr }", "select p_partkey, length(p_name) as len, lower(p_brand) as lo, upper(p_name) as up, p_brand || '-' || p_type as cc, instr(p_name, 'a') - 1 as ix, starts_with(p_type, 'PROMO') as sw, suffix(p_type, 'UM') as ew, 'x' as tr from part"),
    "fn_substring_neg": ("SELECT from part { p_partkey, substring(p_type, 1, 2) as a, substring(p_type, 5) as b, substring(p_type, -3) as c, substring(p_type, 0, 1) as d }", "select p_partkey, substr(p_type, 2, 2) as a, substr(p_type, 6) as b, right(p_type, 3) as c, left(p_type, 1) as d from part"),
    "fn_contains_null": ("SELECT from (SELECT from orders { o_orderkey, nullif(o_orderpriority, '1-URGENT') as pr }) as o { o_orderkey, contains(pr, 'HIGH') as high } where not startswith(pr, '2')", "select o_orderkey, coalesce(contains(nullif(o_orderpriority, '1-URGENT'), 'HIGH'), false) as high from orders where not coalesce(starts_with(nullif(o_orderpriority, '1-URGENT'), '2'), false)"),
    "fn_math_round": ("SELECT from lineitem { l_orderkey, l_linenumber, round(l_extendedprice, 1) as r1, floor(l_extendedprice) as fl, ceiling(l_extendedprice) as ce, abs(l_tax - 0.05) as ab, sqrt(l_quantity) as sq }", "select l_orderkey, l_linenumber, round(l_extendedprice, 1) as r1, cast(floor(l_extendedprice) as bigint) as fl, cast(ceil(l_extendedprice) as bigint) as ce, abs(l_tax - 0.05) as ab, sqrt(l_quantity) as sq from lineitem"),
    "fn_date_parts": ("SELECT from orders { o_orderkey, year(o_orderdate) as y, month(o_orderdate) as m, day(o_orderdate) as d, hour(o_orderdate) as h, date(o_orderdate) as dt }", "select o_orderkey, year(o_orderdate) as y, month(o_orderdate) as m, day(o_orderdate) as d, hour(o_orderdate) as h, cast(o_orderdate as date) as dt from orders"),
    "fn_between_family": (
        "SELECT from lineitem { l_orderkey, l_linenumber, days_between(order.o_orderdate, l_shipdate) as days, seconds_between(order.o_orderdate, l_shipdate) as secs, months_between(order.o_orderdate, l_shipdate) as months, years_between(order.o_orderdate, l_shipdate) as years, nano100_between(order.o_orderdate, l_shipdate) as ticks }",
        """select l_orderkey, l_linenumber, cast(trunc((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000) as integer) as days, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 1e6 as secs,
        months, cast(trunc(months / 12) as integer) as years, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) * 10 as ticks from (select *, case when ym2 < ym1 then ym2 - ym1 + case when dt2 > dt1 then 1 else 0 end else ym2 - ym1 - case when dt2 < dt1 then 1 else 0 end end as months from
        (select *, year(o_orderdate) * 12 + month(o_orderdate) as ym1, year(l_shipdate) * 12 + month(l_shipdate) as ym2, day(o_orderdate) * 86400000000 + epoch_us(o_orderdate) - epoch_us(date_trunc('day', o_orderdate)) as dt1,
        day(l_shipdate) * 86400000000 + epoch_us(l_shipdate) - epoch_us(date_trunc('day', l_shipdate)) as dt2 from lineitem join orders on o_orderkey = l_orderkey))""",
    ),
    "search_default": ("SELECT from customer { c_custkey } search 'building'", "select c_custkey from customer where contains(lower(c_name), 'building') or contains(lower(c_mktsegment), 'building')"),
    "search_function": ("SELECT from part { p_partkey } where search((p_name, p_type), 'small')", "select p_partkey from part where contains(lower(p_name), 'small') or contains(lower(p_type), 'small')"),
    "inline_assoc": ("SELECT from customer { c_custkey, nation.{ n_name, n_regionkey } }", "select c_custkey, n_name as nation_n_name, n_regionkey as nation_n_regionkey from customer left join nation on n_nationkey = c_nationkey"),
    "expand_to_one": ("SELECT from customer { c_custkey, nation { n_name, n_regionkey } }", "select c_custkey, n_name, n_regionkey from customer left join nation on n_nationkey = c_nationkey"),
    "expand_to_many": ("SELECT from nation { n_name, customers[c_acctbal > 9000] { c_custkey } order by c_custkey as top }", "select n_name, row_number() over (partition by n_nationkey order by c_custkey) - 1 as pos, c_custkey from nation join customer on c_nationkey = n_nationkey and c_acctbal > 9000 union all select n_name, null, null from nation where not exists (select 1 from customer where c_nationkey = n_nationkey and c_acctbal > 9000)"),
    "expand_topk": ("SELECT from customer { c_custkey, orders { o_orderkey, o_totalprice } order by o_totalprice desc, o_orderkey limit 3 as best }", "select c_custkey, rn - 1 as pos, o_orderkey, o_totalprice from customer left join (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from orders) on o_custkey = c_custkey and rn <= 3"),
    "expand_nested": (
        "SELECT from customer { c_custkey, orders { o_orderkey, items { l_linenumber, part.p_name as part } order by l_linenumber } order by o_orderkey }",
        "select c_custkey, o_orderkey, l_linenumber, p_name as part from customer left join orders on o_custkey = c_custkey left join lineitem on l_orderkey = o_orderkey left join part on p_partkey = l_partkey",
    ),
    "expand_count": ("SELECT from customer { c_custkey, $count(orders) as n, $count(orders[o_orderstatus = 'O']) as open_ }", "select c_custkey, (select count(*) from orders where o_custkey = c_custkey) as n, (select count(*) from orders where o_custkey = c_custkey and o_orderstatus = 'O') as open_ from customer"),
    "calc_element": ("SELECT from lineitem { l_orderkey, l_linenumber, net, net * 2 as twice } where net > 90000", "select l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) as net, l_extendedprice * (1 - l_discount) * 2 as twice from lineitem where l_extendedprice * (1 - l_discount) > 90000"),
    "calc_through_path": ("SELECT from orders { o_orderkey, customer.rich as rich }", "select o_orderkey, c_acctbal > 5000 as rich from orders left join customer on c_custkey = o_custkey"),
    "self_reference": ("SELECT from lineitem { l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) as price, $self.price * (1 + l_tax) as charge }", "select l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) as price, l_extendedprice * (1 - l_discount) * (1 + l_tax) as charge from lineitem"),
    "enum_filter": ("SELECT from orders { o_orderkey } where o_orderstatus = #open or o_orderstatus in (#partial)", "select o_orderkey from orders where o_orderstatus in ('O', 'P')"),
    "struct_column": ("SELECT from buyers { id, address }", "select c_custkey as id, c_nationkey as address_nation, c_acctbal as address_balance from customer"),
    "struct_compare": ("SELECT from buyers { id } where not address = other", "select c_custkey as id from customer where not (c_nationkey = c_nationkey and c_acctbal = abs(c_acctbal))"),
    "param_view": ("SELECT from orders_above(least: 350000) { o_orderkey, customer.c_name as name }", "select o_orderkey, c_name as name from orders left join customer on c_custkey = o_custkey where o_totalprice > 350000"),
    "runtime_view": ("SELECT from big_orders { nation, count(*) as n } group by nation", "select n_name as nation, count(*) as n from orders left join customer on c_custkey = o_custkey left join nation on n_nationkey = c_nationkey where o_totalprice > 300000 group by n_name"),
    "union_all": ("SELECT from customer { c_nationkey as k } union all SELECT from supplier { s_nationkey as k }", "select c_nationkey as k from customer union all select s_nationkey from supplier"),
    "no_source": ("SELECT 1 + 1 as two, 'a' || 'b' as ab, maxdatetime() as last", "select 2 as two, 'ab' as ab, '9999-12-31T23:59:59.999Z' as last"),
}

#: Nested results are compared flat.
FLAT = {
    "group_by_expand": lambda df: df.selectExpr("customer.c_mktsegment as seg", "n"),
    "expand_to_one": lambda df: df.selectExpr("c_custkey", "nation.n_name", "nation.n_regionkey"),
    "expand_to_many": lambda df: df.selectExpr("n_name", "posexplode_outer(top) as (pos, x)").selectExpr("n_name", "pos", "x.c_custkey"),
    "expand_topk": lambda df: df.selectExpr("c_custkey", "posexplode_outer(best) as (pos, x)").selectExpr("c_custkey", "pos", "x.o_orderkey", "x.o_totalprice"),
    "expand_nested": lambda df: df.selectExpr("c_custkey", "explode_outer(orders) as o").selectExpr("c_custkey", "o.o_orderkey", "explode_outer(o.items) as i").selectExpr("c_custkey", "o_orderkey", "i.l_linenumber", "i.part"),
}

_TREE = "(select p_partkey as id, case when p_partkey < 1 then null else (p_partkey - 1) // 10 end as parent from part)"
_WALK = f"with recursive nodes as {_TREE}, up as (select id, id as anc, 0 as dist, parent from nodes union all select u.id, n.id, dist + 1, n.parent from up u join nodes n on n.id = u.parent)"


def _run(name: str, text: str):
    flat = FLAT.get(name, lambda df: df)
    return lambda spark, d: flat(engine(spark, d).run(text))


def parts_tree(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    return spark.read.parquet(f"{d}/part.parquet").select(p.alias("id"), F.when(p >= 1, F.floor((p - 1) / 10).cast("bigint")).alias("parent"))


def hier_levels(spark, d):
    return T.levels(parts_tree(spark, d), "id", "parent").select("id", "level", "root", "parent")


def hier_ranks(spark, d):
    return T.hierarchy(parts_tree(spark, d), "id", "parent").select("id", "rank", "tree_size")


def hier_descendants(spark, d):
    return T.descendants(T.hierarchy(parts_tree(spark, d), "id", "parent"), F.col("level") == 2, 1, None).select("id", "distance")


def hier_ancestors(spark, d):
    return T.ancestors(T.hierarchy(parts_tree(spark, d), "id", "parent"), F.col("tree_size") == 1).select("id", "distance")


def hier_top_levels(spark, d):
    return T.top_levels(T.hierarchy(parts_tree(spark, d), "id", "parent"), 2).select("id", "level", "drill_state", "limited_rank")


def localized_view(spark, d):
    return engine(spark, d, locale="de").run("SELECT localized from books { ID, title }")


def temporal_slice(spark, d):
    e = engine(spark, d)
    cut = spark.read.parquet(f"{d}/events.parquet").agg(F.min("ts").alias("a")).first().a
    import datetime as dt

    e.session.valid_from, e.session.valid_to = cut, cut + dt.timedelta(days=2)
    e.bind("events", e.rows("events").withColumn("ends", F.col("ts") + F.expr("interval 1 day")))
    e.model.entity("events").valid = ("ts", "ends")
    return e.run("SELECT from events { event_id, event_type }")


def search_deep(spark, d):
    e = engine(spark, d)
    e.model.entity("orders").elements["customer"].searchable = True
    return e.run("SELECT from orders { o_orderkey } search 'machinery'")


def search_all_terms(spark, d):
    e = engine(spark, d)
    e.search_all_terms = True
    return e.run("SELECT from part { p_partkey } search 'promo widget'")


def query_count(spark, d):
    e = engine(spark, d)
    n = e.count("SELECT from orders { customer.c_mktsegment as seg, count(*) as n } group by customer.c_mktsegment limit 1")
    return spark.createDataFrame([(n,)], "n bigint")


def parameters(spark, d):
    return engine(spark, d).run("SELECT from part { p_partkey } where p_size > ? and p_brand = :brand", 30, brand="Brand#12")


def plain_sql(spark, d):
    return engine(spark, d).sql("select c_mktsegment, count(*) as n from customer where c_acctbal > ? group by c_mktsegment", [0.0])


QUERIES = {n: _run(n, q) for n, (q, _) in PAIRS.items()}
QUERIES |= {f.__name__: f for f in (hier_levels, hier_ranks, hier_descendants, hier_ancestors, hier_top_levels, localized_view, temporal_slice, search_deep, search_all_terms, query_count, parameters, plain_sql)}
ORACLE = {n: s for n, (_, s) in PAIRS.items()}
ORACLE |= {
    "hier_levels": f"{_WALK} select u.id, max(dist) + 1 as level, max_by(anc, dist) as root, any_value(n.parent) as parent from up u join nodes n on n.id = u.id group by u.id",
    "hier_ranks": f"""with recursive nodes as {_TREE}, p as (select id, [id] as path from nodes where parent is null union all select n.id, list_append(p.path, n.id) from nodes n join p on n.parent = p.id),
    s as (select a, count(*) as tree_size from (select unnest(path) as a from p) group by a) select id, row_number() over (order by path) as rank, tree_size from p join s on a = id""",
    "hier_descendants": f"{_WALK}, l as (select id, max(dist) + 1 as level from up group by id) select up.id, min(dist) as distance from up join l on l.id = anc where level = 2 and dist >= 1 group by up.id",
    "hier_ancestors": f"{_WALK} select anc as id, min(-dist) as distance from up where id not in (select parent from nodes where parent is not null) group by anc",
    "hier_top_levels": f"""{_WALK}, l as (select id, max(dist) + 1 as level from up group by id), s as (select anc, count(*) as n from up group by anc),
    o as (select id, [id] as path from nodes where parent is null), p as (select id, [id] as path from nodes where parent is null union all select n.id, list_append(p.path, n.id) from nodes n join p on n.parent = p.id)
    select l.id, level, case when s.n = 1 then 'leaf' when level < 2 then 'expanded' else 'collapsed' end as drill_state, row_number() over (order by path) - 1 as limited_rank from l join s on s.anc = l.id join p on p.id = l.id where level <= 2""",
    "localized_view": "with t as (select ID, min(row(text_ID, title)) as r from books_texts where locale = 'de' group by ID) select b.ID, coalesce(r[2], title) as title from (select distinct ID, title from books) b left join t on t.ID = b.ID",
    "temporal_slice": "select event_id, event_type from events where ts < (select min(ts) from events) + interval 2 day and ts + interval 1 day > (select min(ts) from events)",
    "search_deep": "select o_orderkey from orders left join customer on c_custkey = o_custkey where contains(lower(o_orderstatus), 'machinery') or contains(lower(o_orderpriority), 'machinery') or contains(lower(c_name), 'machinery') or contains(lower(c_mktsegment), 'machinery')",
    "search_all_terms": "select p_partkey from part where (contains(lower(p_name), 'promo') or contains(lower(p_brand), 'promo') or contains(lower(p_type), 'promo')) and (contains(lower(p_name), 'widget') or contains(lower(p_brand), 'widget') or contains(lower(p_type), 'widget'))",
    "query_count": "select count(distinct c_mktsegment) as n from orders join customer on c_custkey = o_custkey",
    "parameters": "select p_partkey from part where p_size > 30 and p_brand = 'Brand#12'",
    "plain_sql": "select c_mktsegment, count(*) as n from customer where c_acctbal > 0 group by c_mktsegment",
}

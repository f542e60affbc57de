"""Registered queries for writes, sources, sinks, functions, recursion and the rarer forms of the query language, with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..model import Model
from ..operators.writes import Writer
from ..runtime import scratch
from ..sources import files
from ..sources.store import Store
from .analytics import engine

#: name -> (query of the language, SQL)
PAIRS: dict[str, tuple[str, str]] = {
    "not_in_nulls": (
        "SELECT from customer { c_custkey } where c_custkey not in (SELECT from orders { nullif(o_custkey, 7) as k } where o_totalprice > 100000)",
        "select c_custkey from customer where c_custkey not in (select nullif(o_custkey, 7) from orders where o_totalprice > 100000)",
    ),
    "not_in_empty_subquery": (
        "SELECT from (SELECT from orders { o_orderkey, nullif(o_orderstatus, 'F') as st }) as o { o_orderkey } where st not in (SELECT from nation { n_name } where n_nationkey < 0)",
        "select o_orderkey from orders",
    ),
    "not_in_left_nulls": (
        "SELECT from (SELECT from orders { o_orderkey, nullif(o_orderstatus, 'F') as st }) as o { o_orderkey } where st not in (SELECT from orders { o_orderstatus } where o_orderstatus = 'P')",
        "select o_orderkey from orders where nullif(o_orderstatus, 'F') not in (select o_orderstatus from orders where o_orderstatus = 'P')",
    ),
    "not_not_in": (
        "SELECT from orders { o_orderkey } where not (o_orderstatus not in (SELECT from orders as x { nullif(x.o_orderstatus, 'F') as s } where x.o_orderkey < 50))",
        "select o_orderkey from orders where not (o_orderstatus not in (select nullif(o_orderstatus, 'F') from orders where o_orderkey < 50))",
    ),
    "row_in_subquery": (
        "SELECT from supplier { s_suppkey } where (s_suppkey, s_nationkey) in (SELECT from customer { c_custkey, c_nationkey })",
        "select s_suppkey from supplier where (s_suppkey, s_nationkey) in (select c_custkey, c_nationkey from customer)",
    ),
    "like_hits": ("SELECT from part { p_partkey, p_name } where p_type like '%MO%' and p_name not like '%widget'", "select p_partkey, p_name from part where p_type like '%MO%' and p_name not like '%widget'"),
    "source_limit": (
        "SELECT from orders[o_orderstatus = 'O' order by o_totalprice desc, o_orderkey limit 7] { o_orderkey, o_totalprice } where o_orderkey > 100",
        "select o_orderkey, o_totalprice from orders where o_orderstatus = 'O' and o_orderkey > 100 order by o_totalprice desc, o_orderkey limit 7",
    ),
    "row_lock": ("SELECT from nation { n_name } where n_regionkey = 1 for update of n_name wait 5", "select n_name from nation where n_regionkey = 1"),
    "cte_recursive": (
        "WITH recursive r as (SELECT from part { p_partkey as id, 0 as depth } where p_partkey = 0 union all SELECT from part as p inner join r as r on p.p_partkey > 0 and cast(floor((p.p_partkey - 1) / 10) as Integer64) = r.id { p.p_partkey as id, r.depth + 1 as depth }) SELECT from r { depth, count(*) as n, max(id) as last } group by depth",
        "with recursive r as (select p_partkey as id, 0 as depth from part where p_partkey = 0 union all select p_partkey, depth + 1 from part join r on p_partkey > 0 and (p_partkey - 1) // 10 = r.id) select depth, count(*) as n, max(id) as last from r group by depth",
    ),
    "cte_recursive_distinct": (
        "WITH r as (SELECT from nation { n_nationkey as k } where n_nationkey = 3 union SELECT from nation as n inner join r as r on n.n_nationkey = (r.k * 2) % 25 { n.n_nationkey as k }) SELECT from r { k }",
        "with recursive r as (select n_nationkey as k from nation where n_nationkey = 3 union select n_nationkey from nation join r on n_nationkey = (r.k * 2) % 25) select k from r",
    ),
    "expand_grouped": (
        "SELECT from customer { c_custkey, orders { o_orderstatus, count(*) as n, max(o_totalprice) as top } group by o_orderstatus }",
        "select c_custkey, o_orderstatus, n, top from customer left join (select o_custkey, o_orderstatus, count(*) as n, max(o_totalprice) as top from orders group by all) on o_custkey = c_custkey",
    ),
    "expand_having": (
        "SELECT from customer { c_custkey, orders { o_orderpriority, count(*) as n } where o_totalprice > 50000 group by o_orderpriority having count(*) > 2 order by n desc, o_orderpriority limit 2 }",
        """select c_custkey, pos, o_orderpriority, n from customer left join (select *, row_number() over (partition by o_custkey order by n desc, o_orderpriority) - 1 as pos from
        (select o_custkey, o_orderpriority, count(*) as n from orders where o_totalprice > 50000 group by all having count(*) > 2)) on o_custkey = c_custkey and pos < 2""",
    ),
    "expand_search": (
        "SELECT from nation { n_name, customers { c_custkey } search 'building' }",
        "select n_name, c_custkey from nation left join customer on c_nationkey = n_nationkey and (contains(lower(c_name), 'building') or contains(lower(c_mktsegment), 'building'))",
    ),
    "expand_two_step": (
        "SELECT from customer { c_custkey, orders.items { l_orderkey, l_linenumber } }",
        "select c_custkey, l_orderkey, l_linenumber from customer left join (select o_custkey, l_orderkey, l_linenumber from orders join lineitem on l_orderkey = o_orderkey) on o_custkey = c_custkey",
    ),
    "expand_through_one": (
        "SELECT from orders { o_orderkey, customer.nation.customers { c_custkey } order by c_custkey limit 2 as neighbours }",
        """select o_orderkey, n.c_custkey from orders left join customer c on c.c_custkey = o_custkey
        left join (select c_custkey, c_nationkey, row_number() over (partition by c_nationkey order by c_custkey) as rn from customer) n on n.c_nationkey = c.c_nationkey and rn <= 2""",
    ),
    "expand_many_in_one": (
        "SELECT from orders { o_orderkey, customer { c_name, orders { o_orderkey } order by o_totalprice desc, o_orderkey limit 2 } }",
        """select o.o_orderkey, c_name, x.o_orderkey as other from orders o left join customer on c_custkey = o_custkey
        left join (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from orders) x on x.o_custkey = c_custkey and rn <= 2""",
    ),
    "expand_unequal": (
        "SELECT from supplier { s_suppkey, richer { s_suppkey } order by s_acctbal, s_suppkey limit 1 }",
        """select a.s_suppkey, b.s_suppkey as next from supplier a left join (select a.s_suppkey as k, b.s_suppkey, row_number() over (partition by a.s_suppkey order by b.s_acctbal, b.s_suppkey) as rn
        from supplier a join supplier b on b.s_nationkey = a.s_nationkey and b.s_acctbal > a.s_acctbal) b on b.k = a.s_suppkey and rn = 1""",
    ),
    "expand_struct": ("SELECT from buyers { id, address { nation } }", "select c_custkey as id, c_nationkey as address_nation from customer"),
    "expand_anonymous": ("SELECT from customer { c_custkey, { c_name as name, nation.n_name as nation } as who }", "select c_custkey, c_name as name, n_name as nation from customer left join nation on n_nationkey = c_nationkey"),
    "inline_wildcard": ("SELECT from customer { c_custkey, nation.* excluding { n_regionkey } }", "select c_custkey, n_nationkey as nation_n_nationkey, n_name as nation_n_name from customer left join nation on n_nationkey = c_nationkey"),
    "group_by_assoc": ("SELECT from buyers { home, count(*) as n } group by home", "select c_nationkey as home_n_nationkey, count(*) as n from customer group by 1"),
    "group_by_struct": ("SELECT from buyers { address, count(*) as n } group by address", "select c_nationkey as address_nation, c_acctbal as address_balance, count(*) as n from customer group by all"),
    "struct_against_null": ("SELECT from buyers { id } where home = 3 and address != null", "select c_custkey as id from customer where c_nationkey = 3 and (c_nationkey is not null or c_acctbal is not null)"),
    "order_by_one_leaf": ("SELECT from buyers { id } order by home desc, id limit 9", "select c_custkey as id from customer order by c_nationkey desc, c_custkey limit 9"),
    "self_join_path": (
        "SELECT from genres { ID, parent.name as up, parent.parent.name as up2 }",
        "with g as (select ID, min(name) as name, min(parent_ID) as parent_ID from genres group by ID) select g.ID, a.name as up, b.name as up2 from g left join g a on a.ID = g.parent_ID left join g b on b.ID = a.parent_ID",
    ),
    "composite_key_path": (
        "SELECT from notes { id, line.l_quantity as q }",
        "select a.l_orderkey * 10 + a.l_linenumber as id, b.l_quantity as q from lineitem a left join lineitem b on b.l_orderkey = a.l_orderkey and b.l_linenumber = a.l_linenumber",
    ),
    "main_reference": (
        "SELECT from nation as n { n_name, (SELECT from customer as c { count(*) as k } where c.c_nationkey = $main.n_nationkey and c.c_acctbal > 0) as rich }",
        "select n_name, (select count(*) from customer where c_nationkey = n_nationkey and c_acctbal > 0) as rich from nation",
    ),
    "quoted_names": ('SELECT from orders as "order by" { "order by".o_orderkey as ![select], o_orderstatus as "a b" } where "order by".o_orderkey < 9', 'select o_orderkey as "select", o_orderstatus as "a b" from orders where o_orderkey < 9'),
    "alias_scope": ("SELECT from orders as o { o.o_custkey as o_orderkey, o_totalprice * -1 as minus } order by minus, o_orderkey limit 5", "select o_custkey as o_orderkey, o_totalprice * -1 as minus from orders order by minus, 1 limit 5"),
    "named_arguments": ("SELECT from part { p_partkey, substring(p_name, length => 3, start => 1) as s, days_between(end => cast('2024-03-01' as Date), start => cast('2024-02-01' as Date)) as d }", "select p_partkey, substr(p_name, 2, 3) as s, 29 as d from part"),
    "fn_time_parts": (
        "SELECT from events { event_id, minute(ts) as mi, second(ts) as se, fractionalseconds(ts) as fr, time(ts) as ti, hour('03:04:05') as h }",
        "select event_id, minute(ts) as mi, second(ts) as se, (epoch_us(ts) % 1000000) / 1e6 as fr, strftime(ts, '%H:%M:%S') as ti, 3 as h from events",
    ),
    "fn_round_modes": (
        "SELECT from lineitem { l_orderkey, l_linenumber, round(l_extendedprice, 0, 'half_even') as he, round(l_extendedprice, 1, 'up') as up, round(l_extendedprice, 1, 'down') as dn, round(l_extendedprice, 0, 'ceiling') as ce, round(l_extendedprice, 0, 'floor') as fl, round(l_extendedprice, 0, 'half_down') as hd }",
        "select l_orderkey, l_linenumber, round_even(l_extendedprice, 0) as he, ceil(l_extendedprice * 10.0e0) / 10.0e0 as up, floor(l_extendedprice * 10.0e0) / 10.0e0 as dn, ceil(l_extendedprice) as ce, floor(l_extendedprice) as fl, ceil(l_extendedprice - 0.5e0) as hd from lineitem",
    ),
    "fn_error": ("SELECT from nation { n_nationkey, error('E1', n_name, null) as e }", "select n_nationkey, '{\"message\":\"E1\",\"args\":\"' || n_name || '\",\"targets\":null}' as e from nation"),
    "fn_matches": ("SELECT from part { p_partkey, matchesPattern(p_name, '^s.*t$') as m }", "select p_partkey, regexp_matches(p_name, '^s.*t$') as m from part"),
    "fn_native": ("SELECT from lineitem { l_orderkey, l_linenumber, power(l_quantity, 2) as p, mod(l_linenumber, 3) as m, coalesce(nullif(l_returnflag, 'A'), '-') as c, sign(l_tax - 0.04) as s, ln(l_quantity) as l }", "select l_orderkey, l_linenumber, power(l_quantity, 2) as p, l_linenumber % 3 as m, coalesce(nullif(l_returnflag, 'A'), '-') as c, cast(sign(l_tax - 0.04e0) as double) as s, ln(l_quantity) as l from lineitem"),
    "fn_ends": ("SELECT from part { p_partkey, endswith(p_type, 'ARD') as ew, contains(p_name, 'ing') as co, indexof(p_name, 'zz') as ix }", "select p_partkey, suffix(p_type, 'ARD') as ew, contains(p_name, 'ing') as co, instr(p_name, 'zz') - 1 as ix from part"),
    "fn_fixed_times": ("SELECT mindatetime() as lo, maxdatetime() as hi, now() = $now as same, year(current_date()) > 2000 as now_, session_context('$user.locale') as loc, length(sysuuid()) as u", "select '0001-01-01T00:00:00.000Z' as lo, '9999-12-31T23:59:59.999Z' as hi, true as same, true as now_, 'en' as loc, 36 as u"),
    "session_refs": ("SELECT from nation { n_nationkey, $user as u, $user.locale as l } where n_name != $user.id", "select n_nationkey, 'anonymous' as u, 'en' as l from nation"),
    "win_aggregates": (
        "SELECT from orders { o_orderkey, sum(o_totalprice) over (partition by o_custkey order by o_orderkey rows between 1 preceding and current row) as s, avg(o_totalprice) over (partition by o_custkey order by o_orderkey rows between 1 preceding and 1 following) as a, min(o_totalprice) over (partition by o_custkey) as m, sum(o_orderkey) over (partition by o_custkey order by o_orderkey range between 500 preceding and current row) as r }",
        "select o_orderkey, sum(o_totalprice) over (partition by o_custkey order by o_orderkey rows between 1 preceding and current row) as s, avg(o_totalprice) over (partition by o_custkey order by o_orderkey rows between 1 preceding and 1 following) as a, min(o_totalprice) over (partition by o_custkey) as m, cast(sum(o_orderkey) over (partition by o_custkey order by o_orderkey range between 500 preceding and current row) as bigint) as r from orders",
    ),
    "aggregates": ("SELECT from lineitem { l_returnflag, sum(l_quantity) as s, min(l_shipdate) as lo, max(l_shipdate) as hi, avg(l_quantity) as a, count(l_tax) as c, count() as n } group by l_returnflag", "select l_returnflag, sum(l_quantity) as s, min(l_shipdate) as lo, max(l_shipdate) as hi, avg(l_quantity) as a, count(l_tax) as c, count(*) as n from lineitem group by l_returnflag"),
    "search_hits": ("SELECT from part { p_partkey } where search((p_name, p_type), 'promo')", "select p_partkey from part where contains(lower(p_name), 'promo') or contains(lower(p_type), 'promo')"),
    "search_grouped": (
        "SELECT from part { p_type, max(p_name) as top, count(*) as n } group by p_type search 'ring'",
        "select * from (select p_type, max(p_name) as top, count(*) as n from part group by p_type) where contains(lower(p_type), 'ring') or contains(lower(top), 'ring')",
    ),
    "search_grouped_key": ("SELECT from part { p_type, count(*) as n } group by p_type search 'STAND'", "select p_type, count(*) as n from part group by p_type having contains(lower(p_type), 'stand')"),
    "search_score": (
        "SELECT from part { p_partkey, score((p_name, p_type), 'promo') as s } where score((p_name, p_type), 'promo') > 0.3",
        """select * from (select p_partkey, greatest(case when contains(lower(p_name), 'promo') then 1.0 else list_max([1.0 - levenshtein(w, 'promo') / greatest(len(w), 5)::double for w in regexp_split_to_array(lower(p_name), '\\W+')]) end * 0.5e0,
        case when contains(lower(p_type), 'promo') then 1.0 else list_max([1.0 - levenshtein(w, 'promo') / greatest(len(w), 5)::double for w in regexp_split_to_array(lower(p_type), '\\W+')]) end * 0.5e0) as s from part) where s > 0.3""",
    ),
    "collation_order": ("SELECT from (SELECT from part { case when p_partkey % 2 = 0 then toupper(p_name) else p_name end as name, p_partkey }) as p { name, p_partkey } where p_partkey < 200 order by p_partkey limit 20", "select case when p_partkey % 2 = 0 then upper(p_name) else p_name end as name, p_partkey from part where p_partkey < 200 order by p_partkey limit 20"),
    "path_in_exists_filter": ("SELECT from nation { n_name } where exists customers[nation.region.r_name = 'ASIA' and c_acctbal > 9900]", "select n_name from nation join region on r_regionkey = n_regionkey where r_name = 'ASIA' and exists (select 1 from customer where c_nationkey = n_nationkey and c_acctbal > 9900)"),
    "left_out_target": ("SELECT from parcels { id, carrier.name, carrier.code as code, carrier { name } as c }", "select o_orderkey as id, o_orderstatus as code from orders"),
    "recurse_children": (
        "SELECT from pieces { id, RANK, DistanceFromRoot, DrillState, LimitedDescendantCount } recurse parent where DistanceTo(3, 1)",
        "TREE select id, rk - 1 as \"RANK\", level - 1 as \"DistanceFromRoot\", case when size = 1 then 'leaf' else 'collapsed' end as \"DrillState\", size - 1 as \"LimitedDescendantCount\" from h where parent = 3",
    ),
    "recurse_below": ("SELECT from pieces { id, Distance } recurse parent where DistanceTo(3, null)", "TREE select id, cast(len(path) - list_position(path, 3) as integer) as \"Distance\" from h where list_contains(path, 3) and id <> 3"),
    "recurse_levels": (
        "SELECT from pieces { id, DrillState, LimitedRank } recurse parent where DistanceFromRoot <= 1",
        "TREE select id, case when size = 1 then 'leaf' when level <> 2 then 'expanded' else 'collapsed' end as \"DrillState\", row_number() over (order by rk) - 1 as \"LimitedRank\" from h where level <= 2",
    ),
    "recurse_collapsed": (
        "SELECT from pieces { id, DrillState, LimitedRank } recurse parent where DistanceFromRoot <= 2 and not DistanceTo(3, null) or DistanceTo(15, 1)",
        """TREE select id, case when size = 1 then 'leaf' when id = 3 then 'collapsed' when id = 15 then 'expanded' when parent = 15 then 'collapsed' when level <> 3 then 'expanded' else 'expanded' end as "DrillState",
        row_number() over (order by rk) - 1 as "LimitedRank" from h where (level <= 3 and not (list_contains(path, 3) and id <> 3)) or parent = 15""",
    ),
    "recurse_search": (
        "SELECT from pieces { id, DrillState, DistanceFromRoot } where p_size = 7 and label like '%ring' recurse parent",
        """TREE, d as (select unnest(path) as a, len(path) - generate_subscripts(path, 1) as up from h where p_size = 7 and label like '%ring'), m as (select a, min(-up) as distance from d group by a)
        select id, case when size = 1 or distance = 0 then 'leaf' else 'expanded' end as "DrillState", cast(level - 1 as integer) as "DistanceFromRoot" from h join m on a = id""",
    ),
    "recurse_siblings": (
        "SELECT from pieces { id, RANK } order by label desc, id recurse parent",
        """with recursive nodes as (select p_partkey as id, case when p_partkey >= 1 then (p_partkey - 1) // 10 end as parent, row_number() over (order by p_name desc, p_partkey) as s from part),
        p as (select id, [s] as path from nodes where parent is null union all select n.id, list_append(p.path, n.s) from nodes n join p on n.parent = p.id) select id, row_number() over (order by path) - 1 as "RANK" from p""",
    ),
    "recurse_composite": (
        "SELECT from pieces2 { a, b, DistanceFromRoot } recurse parent where DistanceTo((0, 3), 1)",
        "select p_partkey // 100 as a, p_partkey % 100 as b, 2 as \"DistanceFromRoot\" from part where p_partkey >= 1 and (p_partkey - 1) // 10 = 3",
    ),
    "recurse_name_clash": (
        "SELECT from ranked { id, rank, level, DistanceFromRoot } recurse parent where DistanceFromRoot <= 1",
        "TREE select id, p_size as rank, label as level, cast(level - 1 as integer) as \"DistanceFromRoot\" from h where level <= 2",
    ),
}

_H = """with recursive nodes as (select p_partkey as id, case when p_partkey >= 1 then (p_partkey - 1) // 10 end as parent, p_size, p_name as label from part),
p as (select id, [id] as path from nodes where parent is null union all select n.id, list_append(p.path, n.id) from nodes n join p on n.parent = p.id),
s as (select a, count(*) as size from (select unnest(path) as a from p) group by a),
h as (select n.*, path, len(path) as level, row_number() over (order by path) as rk, size from nodes n join p on p.id = n.id join s on s.a = n.id)"""

#: Nested results are compared flat.
FLAT = {
    "expand_grouped": lambda df: df.selectExpr("c_custkey", "explode_outer(orders) as o").selectExpr("c_custkey", "o.o_orderstatus", "o.n", "o.top"),
    "expand_having": lambda df: df.selectExpr("c_custkey", "posexplode_outer(orders) as (pos, o)").selectExpr("c_custkey", "pos", "o.o_orderpriority", "o.n"),
    "expand_search": lambda df: df.selectExpr("n_name", "explode_outer(customers) as o").selectExpr("n_name", "o.c_custkey"),
    "expand_two_step": lambda df: df.selectExpr("c_custkey", "explode_outer(orders_items) as o").selectExpr("c_custkey", "o.l_orderkey", "o.l_linenumber"),
    "expand_through_one": lambda df: df.selectExpr("o_orderkey", "explode_outer(neighbours) as o").selectExpr("o_orderkey", "o.c_custkey"),
    "expand_many_in_one": lambda df: df.selectExpr("o_orderkey", "customer.c_name", "explode_outer(customer.orders) as o").selectExpr("o_orderkey", "c_name", "o.o_orderkey as other"),
    "expand_unequal": lambda df: df.selectExpr("s_suppkey", "explode_outer(richer) as r").selectExpr("s_suppkey", "r.s_suppkey as next"),
    "expand_anonymous": lambda df: df.selectExpr("c_custkey", "who.name", "who.nation"),
}

MORE = {
    "genres": {"elements": {"ID": {"type": "Integer", "key": True}, "name": "String", "parent_ID": "Integer", "parent": {"target": "genres", "on": "parent.ID = parent_ID"}}},
    "notes": {"elements": {"id": {"type": "Integer64", "key": True}, "line": {"target": "lineitem", "keys": {"l_orderkey": "order", "l_linenumber": "no"}}}},
    "pieces": {"elements": {"id": {"type": "Integer64", "key": True}, "label": "String", "p_size": "Integer", "parent": {"target": "pieces"}}},
    "pieces2": {"elements": {"a": {"type": "Integer64", "key": True}, "b": {"type": "Integer64", "key": True}, "parent": {"target": "pieces2"}}},
    "ranked": {"elements": {"id": {"type": "Integer64", "key": True}, "rank": "Integer", "level": "String", "parent": {"target": "ranked"}}},
    "carriers": {"elements": {"code": {"type": "String", "key": True}, "name": "String"}, "persisted": False},
    "parcels": {"elements": {"id": {"type": "Integer64", "key": True}, "carrier": {"target": "carriers"}}},
}


def wide(spark: SparkSession, d: str) -> Engine:
    """The star schema with entities of other shapes beside it."""
    e = engine(spark, d)
    e.model.entities.update(Model.from_dict({**MORE, "lineitem": {"elements": {"l_orderkey": {"type": "Integer64", "key": True}, "l_linenumber": {"type": "Integer", "key": True}}}}).entities | {"lineitem": e.model.entities["lineitem"]})
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    e.bind("genres", read("genres").groupBy("ID").agg(F.min("name").alias("name"), F.min("parent_ID").alias("parent_ID")))
    k = F.col("p_partkey")
    up = F.when(k >= 1, F.floor((k - 1) / 10).cast("bigint"))
    e.bind("pieces", read("part").select(k.alias("id"), F.col("p_name").alias("label"), "p_size", up.alias("parent_id")))
    e.bind("ranked", read("part").select(k.alias("id"), F.col("p_size").alias("rank"), F.col("p_name").alias("level"), up.alias("parent_id")))
    parts = lambda c, n: [F.floor(c / 100).cast("bigint").alias(n[0]), (c % 100).alias(n[1])]
    e.bind("pieces2", read("part").select(*parts(k, ("a", "b")), *parts(up, ("parent_a", "parent_b"))))
    e.bind("notes", read("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("line_order"), F.col("l_linenumber").alias("line_no")))
    e.bind("parcels", read("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("carrier_code")))
    return e


def _run(name: str, text: str):
    flat = FLAT.get(name, lambda df: df)
    return lambda spark, d: flat(wide(spark, d).run(text))


# sources and sinks -----------------------------------------------------------------------------------------------------


def function_source(spark, d):
    e = engine(spark, d)
    e.functions["dear"] = lambda e, least: e.rows("part").where(F.col("p_retailprice") >= least)
    return e.run("SELECT from dear(least: 1000) as x { x.p_brand, count(*) as n } group by x.p_brand")


def hierarchy_source(spark, d):
    return wide(spark, d).run("SELECT from hierarchy(entity: 'pieces', parent: 'parent_id') { id, level, tree_size } where tree_size > 1")


def catalog(spark, d):
    return engine(spark, d).catalog()


def procedure(spark, d):
    e = engine(spark, d)
    e.procedures["rich"] = lambda e, least: e.run("SELECT from customer { c_custkey } where c_acctbal > :least", least=least)
    return e.call("rich", 9000)


def row_results(spark, d):
    """The first row, a page with its total, and all rows one by one."""
    e = engine(spark, d)
    first = e.first("SELECT one from nation { n_nationkey } order by n_nationkey desc")
    rows, total = e.page("SELECT from nation { n_nationkey } order by n_nationkey limit 4 offset 2")
    seen: list[int] = []
    e.foreach("SELECT from region { r_regionkey }", lambda r: seen.append(r.r_regionkey))
    return spark.createDataFrame([(first.n_nationkey, sum(r.n_nationkey for r in rows), total, sum(seen))], "last int, page_sum int, total int, seen int")


def json_out(spark, d):
    """JSON text in chunks, read again."""
    text = "".join(engine(spark, d).json("SELECT from nation { n_nationkey, nullif(n_name, 'NATION_3') as n_name }", chunk=256))
    return spark.createDataFrame([(r["n_nationkey"], r["n_name"]) for r in json.loads(text)], "n_nationkey int, n_name string")


def json_in(spark, d):
    e, path = engine(spark, d), scratch(spark, "json")
    files.write_json(e.rows("customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"), "c_acctbal"), path)
    return files.read_json(spark, path, e.model.entity("customer")).select("c_custkey", "c_mktsegment", "c_acctbal", "c_name")


def csv_in(spark, d):
    e, path = engine(spark, d), scratch(spark, "csv")
    e.rows("supplier").select("s_name", "s_suppkey", F.lit("x").alias("other"), "s_acctbal").write.option("sep", ";").option("header", True).csv(path)
    return files.read_csv(spark, path, e.model.entity("supplier"))


def count_text(spark, d):
    e = engine(spark, d)
    e.count_as_text = True
    return e.run("SELECT from orders { o_orderstatus, count(*) as n } group by o_orderstatus")


def own_function(spark, d):
    e = engine(spark, d)
    e.own_functions["twice"] = lambda x: x * 2
    return e.run("SELECT from part { p_partkey, twice(p_size) as t }")


def collation(spark, d):
    e = engine(spark, d)
    e.collation = "UNICODE_CI"
    return e.run("SELECT from (SELECT from part { case when p_partkey % 2 = 0 then toupper(p_name) else p_name end as name, p_partkey }) as p { name, p_partkey } order by name, p_partkey limit 40")


def search_nested(spark, d):
    e = engine(spark, d)
    e.model.entity("orders").elements["customer"].searchable = True
    e.model.entity("customer").elements["nation"].searchable = True
    e.model.entity("nation").elements["n_name"].searchable = True
    return e.run("SELECT from orders { o_orderkey } search 'nation_7'")


def search_terms(spark, d):
    e = engine(spark, d)
    e.search_all_terms = True
    return e.run("SELECT from part { p_partkey } search 'promo ring'")


def search_fuzzy(spark, d):
    e = engine(spark, d)
    e.fuzzy = 0.7
    return e.run("SELECT from part { p_partkey } search 'promoo'")


# writes ----------------------------------------------------------------------------------------------------------------

SHOP = {
    "heads": {
        "elements": {
            "id": {"type": "Integer64", "key": True},
            "status": {"type": "String", "default": "N"},
            "total": "Double",
            "cust": "Integer64",
            "made": {"type": "String", "on_insert": "$user"},
            "changed": {"type": "String", "on_update": "$user"},
            "buyer": {"target": "customer", "on": "buyer.c_custkey = cust"},
            "lines": {"target": "lines", "many": True, "on": "lines.head = id", "composition": True},
        }
    },
    "lines": {"elements": {"uid": {"type": "UUID", "key": True}, "head": "Integer64", "no": "Integer", "quantity": "Double"}},
    "open_heads": {"elements": {"no": {"type": "Integer64", "key": True}, "state": "String"}, "query": "SELECT from heads { id as no, status as state } where status = 'O'"},
}


def shop(spark: SparkSession, d: str, lines: bool = False) -> Writer:
    """A store of its own with the orders as heads, and their items as lines."""
    e = engine(spark, d)
    e.model.entities.update({k: v for k, v in Model.from_dict({**SHOP, "customer": {"elements": {"c_custkey": {"type": "Integer64", "key": True}}}}).entities.items() if k in SHOP})
    w = Writer(e, Store(spark, scratch(spark, "store")))
    for n in ("heads", "lines"):
        w.create(n)
    w.insert("heads", "SELECT from orders { o_orderkey as id, o_orderstatus as status, o_totalprice as total, o_custkey as cust }")
    if lines:
        w.insert("lines", "SELECT from lineitem { l_orderkey as head, l_linenumber as no, l_quantity as quantity }")
    return w


def insert_select(spark, d):
    return shop(spark, d).engine.run("SELECT from heads { id, status, total, made, changed }")


def insert_rows(spark, d):
    w = shop(spark, d)
    n = w.insert_rows("heads", ["id", "total"], [(-1, 1.5), (-2, None)])
    assert n == 2 and n.keys.count() == 2
    w.insert("heads", [{"id": -3, "status": None}])
    return w.engine.run("SELECT from heads { id, status, total, made } where id < 3")


def insert_keys(spark, d):
    """Generated keys: one for each row, none twice."""
    w = shop(spark, d)
    done = w.insert("lines", "SELECT from lineitem { l_orderkey as head, l_linenumber as no }")
    return done.keys.agg(F.count_distinct("uid").alias("n"), F.min(F.length("uid")).alias("length"))


def upsert(spark, d):
    w = shop(spark, d)
    w.upsert("heads", w.engine.run("SELECT from orders { o_orderkey as id, 'U' as status } where o_totalprice > 300000 union all SELECT from nation { n_nationkey - 100 as id, 'new' as status }"))
    return w.engine.run("SELECT from heads { id, status, total, made, changed }")


def upsert_last_wins(spark, d):
    w = shop(spark, d)
    w.upsert("heads", [{"id": 1, "status": "z"}, {"id": 1, "status": "a"}, {"id": -5, "status": "q"}])
    return w.engine.run("SELECT from heads { id, status } where id < 3")


def update(spark, d):
    w = shop(spark, d)
    w.update("heads", "status = 'O' and total > 100000", data={"status": "X"}, exprs={"total": "total * 2"})
    return w.engine.run("SELECT from heads { id, status, total, changed }")


def update_path(spark, d):
    w = shop(spark, d)
    w.update("heads", "buyer.nation.n_name = 'NATION_3'", data={"status": "X"})
    return w.engine.run("SELECT from heads { id, status }")


def delete(spark, d):
    w = shop(spark, d)
    w.delete("heads", "exists buyer[c_acctbal < 0] or status = 'P'")
    return w.engine.run("SELECT from heads { id }")


def delete_deep(spark, d):
    w = shop(spark, d, lines=True)
    w.delete("heads", "total > 200000")
    return w.engine.run("SELECT from lines { head, no }")


def write_view(spark, d):
    w = shop(spark, d)
    w.update("open_heads", "no < 1000", data={"state": "V"})
    w.delete("open_heads", "no > 2000")
    return w.engine.run("SELECT from heads { id, status }")


def insert_deep(spark, d):
    w = shop(spark, d)
    w.insert_deep("heads", [{"id": -i, "lines": [{"no": k, "quantity": i * k} for k in range(i)]} for i in range(1, 5)])
    w.upsert_deep("heads", [{"id": -4, "status": "U", "lines": [{"no": 9, "quantity": 1.0}]}])
    return w.engine.run("SELECT from lines { head, no, quantity }")


def transaction(spark, d):
    """What is rolled back was never there; what is committed is seen by a store that is opened later."""
    w = shop(spark, d)
    w.begin()
    w.delete("heads")
    w.rollback()
    w.begin()
    w.delete("heads", "status = 'F'")
    w.commit()
    return Store(spark, w.store.root).read("heads").select("id", "status")


def create_drop(spark, d):
    w = shop(spark, d)
    w.create("heads", if_not_exists=True)
    w.create_view("dear_heads", "SELECT from heads { id, total } where total > 400000")
    w.drop("lines")
    w.drop("lines", if_exists=True)
    return w.engine.run("SELECT from dear_heads { id, total }")


def bulk_insert(spark, d):
    """2^23 generated rows into a store; for the bench."""
    w = Writer(Engine(spark, Model.from_dict({"heads": {"elements": {"id": {"type": "Integer64", "key": True}, "title": "String", "stock": "Integer"}}})), Store(spark, scratch(spark, "store")))
    w.create("heads")
    n = w.insert("heads", spark.range(1 << 23).selectExpr("id", "concat('title ', id) as title", "cast(id % 1000 as int) as stock"))
    return spark.createDataFrame([(int(n),)], "n bigint")


_FUNCTIONS = (
    function_source, hierarchy_source, catalog, procedure, row_results, json_out, json_in, csv_in, count_text, own_function, collation, search_nested, search_terms, search_fuzzy,
    insert_select, insert_rows, insert_keys, upsert, upsert_last_wins, update, update_path, delete, delete_deep, write_view, insert_deep, transaction, create_drop,
)

QUERIES = {n: _run(n, q) for n, (q, _) in PAIRS.items()}
QUERIES |= {f.__name__: f for f in _FUNCTIONS}
ORACLE: dict[str, str] = {n: _H + s.removeprefix("TREE") if s.startswith("TREE") else s for n, (_, s) in PAIRS.items()}
ORACLE |= {
    "function_source": "select p_brand, count(*) as n from part where p_retailprice >= 1000 group by p_brand",
    "hierarchy_source": _H + " select id, level, size as tree_size from h where size > 1",
    "catalog": "select unnest(['region','nation','customer','supplier','part','orders','lineitem','events','orders_above','big_orders','buyers','books','books_texts','authors']) as name, unnest(['table','table','table','table','table','table','table','table','view','view','view','table','table','table']) as kind",
    "procedure": "select c_custkey from customer where c_acctbal > 9000",
    "row_results": "select 24 as last, 2 + 3 + 4 + 5 as page_sum, (select count(*) from nation)::integer as total, (select sum(r_regionkey) from region)::integer as seen",
    "json_out": "select n_nationkey, nullif(n_name, 'NATION_3') as n_name from nation",
    "json_in": "select c_custkey, nullif(c_mktsegment, 'BUILDING') as c_mktsegment, c_acctbal, cast(null as varchar) as c_name from customer",
    "csv_in": "select s_name, s_suppkey, s_acctbal from supplier",
    "count_text": "select o_orderstatus, cast(count(*) as varchar) as n from orders group by o_orderstatus",
    "own_function": "select p_partkey, p_size * 2 as t from part",
    "collation": "select case when p_partkey % 2 = 0 then upper(p_name) else p_name end as name, p_partkey from part order by lower(p_name), p_partkey limit 40",
    "search_nested": "select o_orderkey from orders left join customer on c_custkey = o_custkey left join nation on n_nationkey = c_nationkey where contains(lower(n_name), 'nation_7') or contains(lower(o_orderstatus), 'nation_7') or contains(lower(o_orderpriority), 'nation_7') or contains(lower(c_name), 'nation_7') or contains(lower(c_mktsegment), 'nation_7')",
    "search_terms": "select p_partkey from part where (contains(lower(p_name), 'promo') or contains(lower(p_brand), 'promo') or contains(lower(p_type), 'promo')) and (contains(lower(p_name), 'ring') or contains(lower(p_brand), 'ring') or contains(lower(p_type), 'ring'))",
    "search_fuzzy": "select p_partkey from part where p_type = 'PROMO'",
    "insert_select": "select o_orderkey as id, o_orderstatus as status, o_totalprice as total, 'anonymous' as made, cast(null as varchar) as changed from orders",
    "insert_rows": "select o_orderkey as id, o_orderstatus as status, o_totalprice as total, 'anonymous' as made from orders where o_orderkey < 3 union all values (-1, 'N', 1.5, 'anonymous'), (-2, 'N', null, 'anonymous'), (-3, null, null, 'anonymous')",
    "insert_keys": "select count(*) as n, 36 as length from lineitem",
    "upsert": "select o_orderkey as id, case when o_totalprice > 300000 then 'U' else o_orderstatus end as status, o_totalprice as total, 'anonymous' as made, case when o_totalprice > 300000 then 'anonymous' end as changed from orders union all select n_nationkey - 100, 'new', null, 'anonymous', null from nation",
    "upsert_last_wins": "select o_orderkey as id, case when o_orderkey = 1 then 'a' else o_orderstatus end as status from orders where o_orderkey < 3 union all select -5, 'q'",
    "update": "select o_orderkey as id, case when hit then 'X' else o_orderstatus end as status, case when hit then o_totalprice * 2 else o_totalprice end as total, case when hit then 'anonymous' end as changed from (select *, o_orderstatus = 'O' and o_totalprice > 100000 as hit from orders)",
    "update_path": "select o_orderkey as id, case when n_name = 'NATION_3' then 'X' else o_orderstatus end as status from orders left join customer on c_custkey = o_custkey left join nation on n_nationkey = c_nationkey",
    "delete": "select o_orderkey as id from orders where o_orderstatus <> 'P' and not exists (select 1 from customer where c_custkey = o_custkey and c_acctbal < 0)",
    "delete_deep": "select l_orderkey as head, l_linenumber as no from lineitem where l_orderkey not in (select o_orderkey from orders where o_totalprice > 200000)",
    "write_view": "select o_orderkey as id, case when o_orderstatus = 'O' and o_orderkey < 1000 then 'V' else o_orderstatus end as status from orders where not (o_orderstatus = 'O' and o_orderkey > 2000)",
    "insert_deep": "select -i as head, cast(k as integer) as no, cast(i * k as double) as quantity from (select unnest([1, 2, 3]) as i), range(0, 3) r(k) where k < i union all select -4, 9, 1.0",
    "transaction": "select o_orderkey as id, o_orderstatus as status from orders where o_orderstatus <> 'F'",
    "create_drop": "select o_orderkey as id, o_totalprice as total from orders where o_totalprice > 400000",
}

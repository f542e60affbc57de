"""Queries p1, p3 and p5: the general operators over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import NUMBER, UUID
from ..operators import hierarchy_links as H
from ..operators.incremental import Feed, IncrementalLoad
from ..operators.orphans import Integrity, Keyed, Reference, per_period
from ..runtime import scratch


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark, d):
    return H.path_text(H.resolve(_t(spark, d, "genres"), "ID", "parent_ID")).withColumnRenamed("id", "ID")


def p1_tree(spark, d):
    r = H.resolve(_t(spark, d, "genres"), "ID", "parent_ID")
    n = H.descendant_counts(r)
    return r.join(n, "id").select(F.col("id").alias("ID"), "depth", "root", "cycle", F.col("descendants").cast("bigint").alias("descendants"))


def p1_descendants(spark, d):
    return H.descendants(H.resolve(_t(spark, d, "genres"), "ID", "parent_ID"))


FEEDS = (("travel", "TravelUUID"), ("booking", "BookingUUID"), ("booking_supplement", "BookSupplUUID"))


def p3_found(spark, d):
    """The runs in two batches: the second finds all files in the manifest, reads none, and goes on from what the first left."""
    load = IncrementalLoad(spark, scratch(spark, "p3"), [Feed(t, f"{d}/{t}.parquet", k, UUID) for t, k in FEEDS])
    runs = sorted((r.run_no, r.cut_at) for r in _t(spark, d, "load_runs").where("status = 'ok'").select("run_no", "cut_at").collect())  # one row per run
    load.run(runs[: len(runs) // 2])
    load.run(runs)
    return load.committed().select("run_no", "tab", "rec_key")


def integrity(spark, d) -> Integrity:
    tables = [Keyed(t, _t(spark, d, t), k, UUID) for t, k in FEEDS] + [Keyed(t, _t(spark, d, t), "ID", NUMBER) for t in ("books", "authors")]
    refs = [
        Reference("booking", "to_Travel_TravelUUID", "travel"),
        Reference("booking_supplement", "to_Travel_TravelUUID", "travel"),
        Reference("booking_supplement", "to_Booking_BookingUUID", "booking"),
        Reference("books", "author_ID", "authors"),
    ]
    return Integrity(tables, refs, _t(spark, d, "removals"))


def p5_found(spark, d):
    return integrity(spark, d).found()


def p5_per_period(spark, d):
    return per_period(integrity(spark, d).found())


QUERIES = {f.__name__: f for f in (p1_found, p1_tree, p1_descendants, p3_found, p5_found, p5_per_period)}

_LINKS = """
nodes as (select distinct ID as id from genres where ID is not null),
links as (select g.ID as id, min(case when n.id is not null then g.parent_ID end) as parent
          from genres g left join nodes n on n.id = g.parent_ID where g.ID is not null group by g.ID),
tree as (select id, id as root, 0 as depth, cast(id as varchar) as path, [id] as ids from links where parent is null
         union all select l.id, t.root, t.depth + 1, t.path || '/' || cast(l.id as varchar), list_append(t.ids, l.id) from links l join tree t on l.parent = t.id),
loose as (select * from links where id not in (select id from tree)),
above as (select id, parent as a from loose union select x.id, l.parent from above x join loose l on l.id = x.a),
rings as (select id from above where id = a),
least as (select x.id, min(x.a) as cycle from above x join rings r on r.id = x.id join rings s on s.id = x.a group by x.id),
below as (select id, cycle, id as door, 0 as depth, '@' || cast(cycle as varchar) as path, cast([] as integer[]) as ids from least
          union all select l.id, b.cycle, b.door, b.depth + 1, b.path || '/' || cast(l.id as varchar), list_append(b.ids, l.id)
          from loose l join below b on l.parent = b.id where l.id not in (select id from rings)),
whole as (select id, depth, root, cast(null as integer) as cycle, cast(null as integer) as door, path, ids from tree union all select id, depth, null, cycle, door, path, ids from below),
-- steps up along the cycles: from every node of one to the others
steps as (select id, id as at_id, 0 as n from least union all select s.id, l.parent, s.n + 1 from steps s join links l on l.id = s.at_id where l.parent <> s.id),
pairs as (select unnest(ids) as ancestor, len(ids) - generate_subscripts(ids, 1) as distance, id from whole
          union all select s.at_id, w.depth + s.n, w.id from whole w join steps s on s.id = w.door where s.at_id <> w.id)
"""

_VALS = {
    "travel": "TravelID, to_Agency_AgencyID, to_Customer_CustomerID, BeginDate, EndDate, BookingFee, TotalPrice, CurrencyCode_code, Description, TravelStatus_code",
    "booking": "to_Travel_TravelUUID, BookingID, BookingDate, to_Customer_CustomerID, to_Carrier_AirlineID, ConnectionID, FlightDate, FlightPrice, CurrencyCode_code, BookingStatus_code",
    "booking_supplement": "to_Travel_TravelUUID, to_Booking_BookingUUID, BookingSupplementID, to_Supplement_SupplementID, Price, CurrencyCode_code",
}
_UUID = "case when regexp_matches(upper(replace(trim({0}), '-', '')), '^0*$') then null else upper(replace(trim({0}), '-', '')) end"
_P3 = (
    "with seen as ("
    + " union all ".join(
        f"""select '{t}' as tab, {_UUID.format(k)} as rec_key, coalesce(LastChangedAt, createdAt) as changed, arrived_at as arrived,
        cast(row({k}, {_VALS[t]}, createdBy, createdAt, LastChangedBy, LastChangedAt) as varchar) as vals from {t}"""
        for t, k in FEEDS
    )
    + """), tagged as (select s.*, (select min(run_no) from load_runs r where r.status = 'ok' and r.cut_at >= s.arrived) as run_no from seen s),
newest as (select tab, rec_key, run_no, max(row(coalesce(changed, timestamp '0001-01-01'), arrived, vals)) as n from tagged where run_no is not null and rec_key is not null group by all),
flat as (select tab, rec_key, run_no, n[1] as changed, n[3] as vals from newest),
f as (select *, max(row(changed, run_no, vals)) over (partition by tab, rec_key order by run_no rows between unbounded preceding and 1 preceding) as l from flat)
select run_no, tab, rec_key from f where l is null or changed > l[1] or (changed = l[1] and vals <> l[3])"""
)

_INT = "cast(try_cast(trim(cast({0} as varchar)) as bigint) as varchar)"
_REC = " union all ".join(
    [f"select '{t}' as tab, {_UUID.format(k)} as k, min(arrived_at) as first, max(createdAt) as created from {t} group by all" for t, k in FEEDS]
    + [f"select '{t}' as tab, {_INT.format('ID')} as k, min(arrived_at) as first, max(createdAt) as created from {t} group by all" for t in ("books", "authors")]
)
_P5 = f"""with rec as (select * from ({_REC}) where k is not null),
gone as (select tab, case when tab in ('books', 'authors') then {_INT.format('rec_key')} else {_UUID.format('rec_key')} end as k, max(removed_at) as removed from removals group by all),
dead as (select g.tab, g.k from gone g left join rec r on r.tab = g.tab and r.k = g.k where r.k is null or r.created is null or g.removed >= r.created),
refs as (
 select distinct 'booking' as tab, 'to_Travel_TravelUUID' as ref_field, {_UUID.format('BookingUUID')} as rec_key, 'travel' as ptab, {_UUID.format('to_Travel_TravelUUID')} as k from booking
 union select 'booking_supplement', 'to_Travel_TravelUUID', {_UUID.format('BookSupplUUID')}, 'travel', {_UUID.format('to_Travel_TravelUUID')} from booking_supplement
 union select 'booking_supplement', 'to_Booking_BookingUUID', {_UUID.format('BookSupplUUID')}, 'booking', {_UUID.format('to_Booking_BookingUUID')} from booking_supplement
 union select 'books', 'author_ID', {_INT.format('ID')}, 'authors', {_INT.format('author_ID')} from books),
hits as (select f.tab, strftime(c.first, '%Y-%m') as ym, f.ref_field, f.rec_key,
  case when d.k is not null then 'deleted' when p.k is null then 'missing' when p.first > c.first then 'late' end as reason
  from refs f join rec c on c.tab = f.tab and c.k = f.rec_key left join rec p on p.tab = f.ptab and p.k = f.k left join dead d on d.tab = f.ptab and d.k = f.k
  where f.k is not null and not exists (select 1 from dead x where x.tab = f.tab and x.k = f.rec_key))
select * from hits where reason is not null"""

ORACLE = {
    "p1_found": f"with recursive {_LINKS} select id as ID, path from whole",
    "p1_tree": f"""with recursive {_LINKS}, n as (select ancestor as id, count(*) as descendants from pairs where distance > 0 group by ancestor)
    select w.id as ID, w.depth, w.root, w.cycle, coalesce(n.descendants, 0) as descendants from whole w left join n on n.id = w.id""",
    "p1_descendants": f"with recursive {_LINKS} select ancestor, id, cast(distance as integer) as distance from pairs where distance > 0",
    "p3_found": _P3,
    "p5_found": _P5,
    "p5_per_period": f"select tab, ref_field, ym, reason, count(*) as n from ({_P5}) group by all",
}

"""A query for each interval operator over the driver tables, and the SQL that gives the same rows.

Orders are intervals in days by customer, events intervals in seconds by user; the sides of a
join are split by order status or event type.
"""

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import operators as ops
from .model import SPEC, Spec
from .operators.joins import OTHER
from .plans.shared import shared_folder
from .sources import event_intervals, order_intervals
from .streaming import drained, overlaps_with_static, stream_tiles

STRANDED = SPEC.with_strand("neg")
FORWARD = SPEC.with_strand("fwd")


def sides(df: DataFrame, left: str, right: str) -> tuple[DataFrame, DataFrame]:
    return df.where(left), df.where(right).withColumnsRenamed({"idx": "idx2", "s": "s2", "e": "e2"})


def order_sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return sides(order_intervals(spark, folder), "o_orderstatus = 'F'", "o_orderstatus <> 'F'")


def event_sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return sides(event_intervals(spark, folder), "event_type = 'purchase'", "event_type <> 'purchase'")


def of_orders(operator, *args, **options):
    return lambda spark, folder: operator(order_intervals(spark, folder), *args, **options)


def of_order_sides(operator, **options):
    return lambda spark, folder: operator(*order_sides(spark, folder), **options)


def complement(spark: SparkSession, folder: str) -> DataFrame:
    orders = order_intervals(spark, folder)
    lengths = orders.groupBy("grp").agg(F.max("e").alias("top")).select("grp", (F.col("top") + F.col("grp") % 3).alias("length"))
    return ops.complement(orders, lengths, include_first=True)


def group_cumsum(spark: SparkSession, folder: str) -> DataFrame:
    return ops.group_cumsum(order_intervals(spark, folder).withColumn("fwd", ~F.col("neg")), FORWARD)


def spliced(spark: SparkSession, folder: str) -> DataFrame:
    return ops.spliced_subsequence(order_intervals(spark, folder).withColumn("fwd", F.col("grp") % 2 == 0), 20, -30, spec=FORWARD)


def spliced_slices(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Both strands in a group, and a slice from columns."""
    rows = order_intervals(spark, folder).withColumns({"fwd": ~F.col("neg"), "low": F.col("idx") % 30, "high": F.when(F.col("idx") % 4 != 0, -(F.col("idx") % 20) - 1)})
    return ops.spliced_subsequence(rows, "low", "high", spec=FORWARD, **options)


def overlaps_carry(spark: SparkSession, folder: str) -> DataFrame:
    left, right = order_sides(spark, folder)
    right = right.withColumnsRenamed({"o_orderpriority": "priority2"})
    return ops.overlaps(left, right, SPEC.with_carry("o_orderpriority", "neg"), replace(OTHER, carry=("priority2",)), sort_output=True)


def genome_bounds(spark: SparkSession, folder: str, **options) -> DataFrame:
    return ops.genome_bounds(order_intervals(spark, folder).withColumn("length", F.lit(2400) + F.col("grp") % 100), "length", **options)


def map_to_global(spark: SparkSession, folder: str) -> DataFrame:
    """Orders laid end to end in local coordinates as exons; events of the same customers' numbers as queries."""
    orders = order_intervals(spark, folder)
    local = ops.group_cumsum(orders).select("idx", F.col("start").alias("ls"), F.col("end").alias("le"))
    exons = orders.join(local, "idx").select(F.col("grp").alias("tx"), "ls", "le", F.col("s").alias("gs"), F.col("e").alias("ge"), (F.col("grp") % 2 == 0).alias("fwd"))
    events = event_intervals(spark, folder)
    queries = events.select("idx", F.col("grp").alias("tx"), (F.col("s") % 300).alias("qs"), (F.col("s") % 300 + F.col("e") - F.col("s")).alias("qe"), (F.col("idx") % 3 == 0).alias("fwd"))
    return ops.map_to_global(exons, queries)


def shared_place(spark: SparkSession) -> str:
    """A new name in the shared folder."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def streamed_tiles(spark: SparkSession, folder: str) -> DataFrame:
    return drained(stream_tiles(order_intervals(spark, folder, stream=True), 50), shared_place(spark))


def streamed_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """The stream of one side of the orders against the other side as it stands."""
    left, _ = sides(order_intervals(spark, folder, stream=True), "o_orderstatus = 'F'", "false")
    _, right = order_sides(spark, folder)
    return drained(overlaps_with_static(left, right, 60), shared_place(spark))


QUERIES = {
    "stream_tiles": streamed_tiles,
    "overlaps_with_static": streamed_overlaps,
    "overlaps": lambda spark, folder: ops.overlaps(*event_sides(spark, folder)),
    "overlaps_orders_slack": of_order_sides(ops.overlaps, slack=10),
    "overlaps_contained": of_order_sides(ops.overlaps, contained=True),
    "overlaps_first": of_order_sides(ops.overlaps, multiple="first"),
    "overlaps_last": of_order_sides(ops.overlaps, multiple="last"),
    "overlaps_simple": of_order_sides(ops.overlaps_simple, slack=3),
    "overlaps_simple_contained": of_order_sides(ops.overlaps_simple, contained=True, multiple="first"),
    "nearest": of_order_sides(ops.nearest, k=2),
    "nearest_forward": of_order_sides(ops.nearest, k=1, include_overlaps=False, direction="forward"),
    "nearest_backward": of_order_sides(ops.nearest, k=1, direction="backward", slack=2),
    "subtract": of_order_sides(ops.subtract),
    "complement_overlaps": of_order_sides(ops.complement_overlaps),
    "semi_overlaps": of_order_sides(ops.semi_overlaps),
    "count_overlaps": of_order_sides(ops.count_overlaps),
    "sort_intervals": of_orders(ops.sort_intervals, STRANDED),
    "sort_groups": of_orders(ops.sort_groups),
    "sort_positions": of_orders(ops.sort_positions),
    "cluster": of_orders(ops.cluster),
    "merge": of_orders(ops.merge, slack=5),
    "max_disjoint": of_orders(ops.max_disjoint, slack=1),
    "complement": complement,
    "boundary": of_orders(ops.boundary),
    "window": of_orders(ops.window, 40, STRANDED),
    "tile": of_orders(ops.tile, 50),
    "spliced_subsequence": spliced,
    "split": of_orders(ops.split),
    "split_between": of_orders(ops.split, between=True, slack=2),
    "extend": of_orders(ops.extend, 3, 5, STRANDED),
    "group_cumsum": group_cumsum,
    "genome_bounds": genome_bounds,
    "genome_bounds_clip": lambda spark, folder: genome_bounds(spark, folder, clip=True),
    "map_to_global": map_to_global,
    "overlaps_contained_slack": of_order_sides(ops.overlaps, contained=True, slack=3),
    "overlaps_carry": overlaps_carry,
    "nearest_carry": lambda spark, folder: ops.nearest(*order_sides(spark, folder), SPEC.with_carry("neg")),
    "merge_carry": of_orders(ops.merge, SPEC.with_carry("o_orderpriority"), slack=5),
    "max_disjoint_carry": of_orders(ops.max_disjoint, SPEC.with_carry("o_orderstatus", "neg")),
    "cluster_slack": of_orders(ops.cluster, slack=7),
    "complement_slack": of_orders(ops.complement, slack=2),
    "window_rows": of_orders(ops.window, 40, Spec(by=(), strand="neg")),
    "spliced_slices": spliced_slices,
    "spliced_force_plus": lambda spark, folder: spliced_slices(spark, folder, force_plus=True),
    "group_cumsum_walk": of_orders(ops.group_cumsum, sort=False),
    "genome_bounds_right": lambda spark, folder: genome_bounds(spark, folder, only_right=True),
    "genome_bounds_clip_right": lambda spark, folder: genome_bounds(spark, folder, clip=True, only_right=True),
}

ORDERS = """o as (select o_orderkey as idx, o_custkey as grp, date_diff('day', timestamp '1995-01-01 00:00:00', o_orderdate) as s,
  date_diff('day', timestamp '1995-01-01 00:00:00', o_orderdate) + 1 + cast(floor(o_totalprice / 2000) as bigint) as e,
  o_orderkey % 2 = 1 as neg, o_orderstatus as st, o_orderpriority as pr from orders)"""
EVENTS = """v as (select event_id as idx, user_id as grp, date_diff('second', timestamp '2024-01-01 00:00:00', ts) as s,
  date_diff('second', timestamp '2024-01-01 00:00:00', ts) + 1 + cast(floor(value * 60) as bigint) as e, event_type from events)"""
SIDES = f"{ORDERS}, a as (select * from o where st = 'F'), b as (select idx as idx2, grp, s as s2, e as e2 from o where st <> 'F')"
ISLANDS = """r as (select *, max(e) over (partition by grp order by s, e, idx rows between unbounded preceding and 1 preceding) as pm from {rows}),
  isl as (select *, sum(case when pm is null or s >= pm + {slack} then 1 else 0 end) over (partition by grp order by s, e, idx rows unbounded preceding) as island from r)"""
MERGED = "m as (select grp, island, min(s) as s, max(e) as e, count(*) as n, max_by(idx, row(e, idx)) as idx from isl group by grp, island)"
NEAREST = """select idx, idx2, distance from (select *, dense_rank() over (partition by idx order by distance) as r from ({candidates}) c) d where r <= {k}"""
LEFT = "select idx, idx2, s - {k} - e2 + 1 as distance from a join b using (grp) where e2 <= s - {k}"
RIGHT = "select idx, idx2, s2 - (e - {k}) + 1 as distance from a join b using (grp) where s2 >= e - {k}"
MEET = "select idx, idx2, 0 as distance from a join b using (grp) where s - {k} < e2 and s2 < e - {k}"


def islands(slack: int, rows: str = "o") -> str:
    return ISLANDS.format(slack=slack, rows=rows)


def one_of(condition: str, order: str) -> str:
    return f"with {SIDES} select idx, idx2 from (select idx, idx2, row_number() over (partition by idx order by {order}) as n from a join b using (grp) where {condition}) t where n = 1"


def split_sql(slack: int, keep: str) -> str:
    return f"""with {ORDERS}, ev as (select grp, s as p, 1 as d, 1 as o, idx from o union all select grp, e + {slack}, -1, 0, idx from o),
  sp as (select grp, p, sum(d) as d, min_by(idx, row(o, idx)) as idx from ev group by grp, p),
  c as (select *, sum(d) over (partition by grp order by p) as cover, lead(p) over (partition by grp order by p) as nx from sp)
  select idx, p as start, nx as "end" from c where nx is not null and {keep}"""


def spliced_sql(force_plus: bool) -> str:
    plain = "true" if force_plus else "fwd"
    walk = "(partition by grp order by fwd, case when fwd then s else -s end, case when fwd then e else -e end, idx"
    return f"""with {ORDERS}, k as (select *, not neg as fwd, idx % 30 as a, case when idx % 4 <> 0 then -(idx % 20) - 1 end as b from o),
  w as (select *, sum(e - s) over {walk} rows unbounded preceding) as upto, sum(e - s) over (partition by grp) as total, first_value(a) over {walk}) as a1, first_value(b) over {walk}) as b1 from k),
  t as (select *, greatest(a1 - (upto - (e - s)), 0) as l, greatest(upto - coalesce(case when b1 < 0 then total + b1 else b1 end, total), 0) as r from w),
  c as (select idx, cast(s + case when {plain} then l else r end as bigint) as start, cast(e - case when {plain} then r else l end as bigint) as "end" from t)
  select * from c where start < "end" """


def cluster_sql(slack: int) -> str:
    return f"""with {ORDERS}, {islands(slack)}, n as (select grp, max(island) as n from isl group by grp),
  base as (select grp, coalesce(sum(n) over (order by grp rows between unbounded preceding and 1 preceding), 0) + row_number() over (order by grp) - 1 as base from n)
  select cast(base + island - 1 as bigint) as cluster_id, idx from isl join base using (grp)"""


def max_disjoint_sql(slack: int, columns: str = "idx") -> str:
    return f"""with recursive {ORDERS}, q as (select *, row_number() over (partition by grp order by s, e, idx) as n from o),
  t(grp, n, idx, taken, last) as (select grp, n, idx, true, e from q where n = 1
    union all select q.grp, q.n, q.idx, q.s > t.last + {3 * slack}, case when q.s > t.last + {3 * slack} then q.e else t.last end from t join q on q.grp = t.grp and q.n = t.n + 1)
  select {columns} from t join o using (idx) where taken"""


MEETS = "greatest(s - {k}, 0) < e2 and s2 < e + {k}"
ORACLES = {
    "overlaps": f"""with {EVENTS}, a as (select * from v where event_type = 'purchase'), b as (select idx as idx2, grp, s as s2, e as e2 from v where event_type <> 'purchase')
  select idx, idx2 from a join b using (grp) where {MEETS.format(k=0)}""",
    "overlaps_orders_slack": f"with {SIDES} select idx, idx2 from a join b using (grp) where {MEETS.format(k=10)}",
    "overlaps_contained": f"with {SIDES} select idx, idx2 from a join b using (grp) where s >= s2 and e <= e2",
    "overlaps_first": one_of(MEETS.format(k=0), "s2, idx2"),
    "overlaps_last": one_of(MEETS.format(k=0), "s2 desc, idx2 desc"),
    "overlaps_simple": f"with {SIDES} select idx, idx2 from a join b using (grp) where s < e2 + 3 and s2 < e + 3",
    "overlaps_simple_contained": one_of("((s <= s2 and e2 <= e) or (s2 <= s and e <= e2))", "s2, idx2"),
    "nearest": f"with {SIDES} " + NEAREST.format(k=2, candidates=" union all ".join(x.format(k=0) for x in (LEFT, RIGHT, MEET))),
    "nearest_forward": f"with {SIDES} " + NEAREST.format(k=1, candidates=RIGHT.format(k=0)),
    "nearest_backward": f"with {SIDES} " + NEAREST.format(k=1, candidates=" union all ".join(x.format(k=2) for x in (LEFT, MEET))),
    "subtract": f"""with {SIDES}, bb as (select idx2 as idx, grp, s2 as s, e2 as e from b), {islands(0, "bb")}, {MERGED},
  j as (select a.idx, a.s, m.s as s2, m.e as e2 from a join m on a.grp = m.grp and a.s < m.e and m.s < a.e union all select idx, s, e, e from a),
  p as (select idx, coalesce(lag(e2) over (partition by idx order by s2, e2), s) as start, s2 as "end" from j)
  select idx, start, "end" from p where start < "end" """,
    "complement_overlaps": f"with {SIDES} select idx from a where not exists (select 1 from b where b.grp = a.grp and s < e2 and s2 < e)",
    "semi_overlaps": f"with {SIDES} select idx from a where exists (select 1 from b where b.grp = a.grp and s < e2 and s2 < e)",
    "count_overlaps": f"with {SIDES} select a.idx, count(b.idx2) as count from a left join b on a.grp = b.grp and {MEETS.format(k=0)} group by a.idx",
    "sort_intervals": f"with {ORDERS} select row_number() over (order by grp, case when neg then -s else s end, case when neg then -e else e end, idx) - 1 as pos, idx from o",
    "sort_groups": f"with {ORDERS} select row_number() over (order by grp, idx) - 1 as pos, idx from o",
    "cluster": cluster_sql(0),
    "merge": f'with {ORDERS}, {islands(5)}, {MERGED} select idx, s as start, e as "end", n as count from m',
    "max_disjoint": max_disjoint_sql(1),
    "complement": f"""with {ORDERS}, {islands(0)}, {MERGED}, l as (select grp, max(e) + grp % 3 as length from o group by grp),
  f as (select grp, min(s) as s, case when row_number() over (order by grp) = 1 then 0 else min_by(idx, row(s, idx)) end as idx from o group by grp),
  g as (select grp, e as start, coalesce(lead(s) over (partition by grp order by s), length) as "end" from m join l using (grp) union all select grp, 0, s from f where s > 0)
  select grp, start, "end", idx from g join f using (grp) where start < "end" """,
    "boundary": f'with {ORDERS} select max_by(idx, row(e, idx)) as idx, min(s) as start, max(e) as "end", count(*) as count from o group by grp',
    "window": f"""with {ORDERS}, ch as (select *, case when lag(grp) over (order by idx) = grp then 0 else 1 end as c from o),
  ru as (select *, sum(c) over (order by idx rows unbounded preceding) as run from ch),
  x as (select *, coalesce(sum(e - s) over (partition by run, neg order by idx rows between unbounded preceding and 1 preceding), 0) as c0, sum(e - s) over (partition by run, neg) as total from ru),
  p as (select idx, s, e, cast(c0 - case when neg then total % 40 else 0 end as bigint) as p0 from x),
  j as (select *, unnest(generate_series(cast(floor(p0 / 40.0) as bigint), cast(floor((p0 + e - s - 1) / 40.0) as bigint))) as j from p)
  select idx, greatest(p0, j * 40) - p0 + s as start, least(p0 + e - s, (j + 1) * 40) - p0 + s as "end" from j""",
    "tile": f"""with {ORDERS}, j as (select *, unnest(generate_series(cast(floor(s / 50.0) as bigint), cast(floor((e - 1) / 50.0) as bigint))) as j from o)
  select idx, j * 50 as start, j * 50 + 50 as "end", (least(j * 50 + 50, e) - greatest(j * 50, s)) / 50.0::double as fraction from j""",
    "spliced_subsequence": f"""with {ORDERS}, k as (select *, grp % 2 = 0 as fwd from o), w as (select *, sum(e - s) over (partition by grp order by case when fwd then s else -s end, case when fwd then e else -e end, idx rows unbounded preceding) as upto, sum(e - s) over (partition by grp) as total from k),
  t as (select *, greatest(20 - (upto - (e - s)), 0) as l, greatest(upto - (total - 30), 0) as r from w),
  c as (select idx, cast(s + case when fwd then l else r end as bigint) as start, cast(e - case when fwd then r else l end as bigint) as "end" from t)
  select * from c where start < "end" """,
    "split": split_sql(0, "cover > 0"),
    "split_between": split_sql(2, "true"),
    "extend": f"""with {ORDERS}, w as (select *, row_number() over (partition by grp order by s, idx) = 1 as lo, row_number() over (partition by grp order by e desc, idx) = 1 as hi,
    first_value(neg) over (partition by grp order by s, idx) as n0 from o)
  select idx, s - case when not lo then 0 when n0 then 3 else 5 end as start, e + case when not hi then 0 when n0 then 5 else 3 end as "end" from w""",
    "group_cumsum": f"""with {ORDERS}, w as (select idx, e - s as n, sum(e - s) over (partition by grp order by case when neg then -s else s end, idx rows unbounded preceding) as c from o)
  select idx, cast(c - n as bigint) as start, cast(c as bigint) as "end" from w""",
    "genome_bounds": f'with {ORDERS} select idx, s as start, e as "end" from o where e <= 2400 + grp % 100 and s >= 0',
    "genome_bounds_clip": f'with {ORDERS} select idx, greatest(s, 0) as start, least(e, 2400 + grp % 100) as "end" from o where s < 2400 + grp % 100 and e > 0',
    "map_to_global": f"""with {ORDERS}, {EVENTS}, w as (select *, sum(e - s) over (partition by grp order by s, idx rows unbounded preceding) as le from o),
  x as (select grp, cast(le - (e - s) as bigint) as ls, cast(le as bigint) as le, s as gs, e as ge, grp % 2 = 0 as xf from w), q as (select idx, grp, s % 300 as qs, s % 300 + e - s as qe, idx % 3 = 0 as qf from v),
  j as (select *, greatest(qs, ls) - ls as o1, least(qe, le) - ls as o2 from q join x using (grp) where ls < qe and qs < le)
  select idx, case when xf then gs + o1 else ge - o2 end as start, case when xf then gs + o2 else ge - o1 end as "end", qf = xf as strand from j""",
    "sort_positions": f"with {ORDERS} select row_number() over (order by grp, s, e, idx) - 1 as pos, idx from o",
    "overlaps_contained_slack": f"with {SIDES} select idx, idx2 from a join b using (grp) where s - 3 >= s2 and e + 3 <= e2",
    "overlaps_carry": f"""with {ORDERS} select a.idx, a.pr as o_orderpriority, a.neg, b.idx as idx2, b.pr as priority2 from o a join o b on a.grp = b.grp and greatest(a.s, 0) < b.e and b.s < a.e
  where a.st = 'F' and b.st <> 'F'""",
    "nearest_carry": f"with {SIDES} select idx, neg, idx2, distance from (" + NEAREST.format(k=1, candidates=" union all ".join(x.format(k=0) for x in (LEFT, RIGHT, MEET))) + ") n join (select idx, neg from a) using (idx)",
    "merge_carry": f'with {ORDERS}, {islands(5)}, {MERGED} select m.idx, o.pr as o_orderpriority, m.s as start, m.e as "end", n as count from m join o using (idx)',
    "max_disjoint_carry": max_disjoint_sql(0, "idx, st as o_orderstatus, neg"),
    "cluster_slack": cluster_sql(7),
    "complement_slack": f"""with {ORDERS}, {islands(2)}, {MERGED}, f as (select grp, case when row_number() over (order by grp) = 1 then 0 else min_by(idx, row(s, idx)) end as idx from o group by grp),
  g as (select grp, e + 2 as start, lead(s) over (partition by grp order by s) as "end" from m)
  select grp, start, "end", idx from g join f using (grp) where start < "end" """,
    "window_rows": f"""with {ORDERS}, p as (select idx, s, e, cast(case when neg then -((e - s) % 40) else 0 end as bigint) as p0 from o),
  j as (select *, unnest(generate_series(cast(floor(p0 / 40.0) as bigint), cast(floor((p0 + e - s - 1) / 40.0) as bigint))) as j from p)
  select idx, greatest(p0, j * 40) - p0 + s as start, least(p0 + e - s, (j + 1) * 40) - p0 + s as "end" from j""",
    "spliced_slices": spliced_sql(False),
    "spliced_force_plus": spliced_sql(True),
    "group_cumsum_walk": f"""with {ORDERS}, w as (select idx, e - s as n, sum(e - s) over (partition by grp order by s, idx rows unbounded preceding) as c from o) select idx, cast(c - n as bigint) as start, cast(c as bigint) as "end" from w""",
    "genome_bounds_right": f'with {ORDERS} select idx, s as start, e as "end" from o where e <= 2400 + grp % 100',
    "genome_bounds_clip_right": f'with {ORDERS} select idx, s as start, least(e, 2400 + grp % 100) as "end" from o where s < 2400 + grp % 100',
}
ORACLES["stream_tiles"] = ORACLES["tile"]
ORACLES["overlaps_with_static"] = f"with {SIDES} select idx, idx2 from a join b using (grp) where s < e2 and s2 < e"

"""Stretches and bin levels, which small inputs don't need, give the rows of the plain plans."""

import random

import pytest
from pyspark.sql import functions as F

import spanweave as sw
from helpers import rows_of
from spanweave.operators.joins import OTHER
from spanweave.plans import prefix
from spanweave.streaming import overlaps_with_static, stream_tiles

STRANDED = sw.Spec(strand="neg")


@pytest.fixture(scope="module")
def sides(spark):
    draw = random.Random(5)
    rows = []
    for i in range(600):
        s = draw.randint(-50, 400)
        long = draw.random() < 0.03
        rows.append((i, "hot" if draw.random() < 0.7 else draw.choice("ab"), s, s + (draw.randint(5_000, 40_000) if long else draw.randint(1, 9)), draw.random() < 0.5))
    df = spark.createDataFrame(rows, "idx long, grp string, s long, e long, neg boolean").cache()
    return df.where("idx < 350"), df.where("idx >= 350").withColumnsRenamed({"idx": "idx2", "s": "s2", "e": "e2"})


def stretch_sizes(laid):
    return [r["count"] for r in laid.df.where("g = 'hot'").groupBy("__b").count().collect()]


def test_stretches_of_a_skewed_group_are_even(spark, monkeypatch):
    monkeypatch.setattr(prefix, "STRETCH_ROWS", 500)
    draw = random.Random(1)
    rows = [("hot", int(draw.paretovariate(0.5))) for _ in range(9000)] + [("hot", 10**15), ("hot", -(10**15))] + [(draw.choice("abc"), draw.randint(0, 99)) for _ in range(1000)]
    df = spark.createDataFrame(rows, "g string, p long").withColumn("p", F.col("p") * 1000 + F.monotonically_increasing_id() % 1000)
    laid = prefix.Stretches(df, "p")
    sizes = stretch_sizes(laid)
    assert sum(sizes) == 9002 and max(sizes) < 2 * 500 and len(sizes) >= 16
    bounds = laid.df.where("g = 'hot'").groupBy("__b").agg(F.min("p").alias("a"), F.max("p").alias("z")).orderBy("__b").collect()
    assert all(x.z < y.a for x, y in zip(bounds, bounds[1:]))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_rows_at_one_position_are_cut(spark, monkeypatch, kind):
    """Nine of ten rows start at 7: the stretches are still even, and counts and islands are those of the plain plan."""
    rows = spark.range(6000).select(F.col("id").cast(kind).alias("idx"), F.lit("hot").alias("grp"), F.when(F.col("id") % 10 > 0, 7).otherwise(F.col("id")).cast("long").alias("s"))
    rows = rows.withColumn("e", F.col("s") + 1 + F.length(F.col("idx").cast("string")))
    other = rows.withColumnsRenamed({"idx": "idx2", "s": "s2", "e": "e2"})
    run = lambda: (rows_of(sw.count_overlaps(rows, other)), rows_of(sw.merge(rows)), rows_of(sw.cluster(rows)))
    plain = run()
    monkeypatch.setattr(prefix, "STRETCH_ROWS", 300)
    sizes = stretch_sizes(prefix.Stretches(rows.select(F.col("idx").alias("i"), F.col("grp").alias("g"), "s", "e"), "s", "e", "i"))
    assert len(sizes) > 15 and max(sizes) < 2 * sum(sizes) / len(sizes)
    assert run() == plain


@pytest.mark.parametrize("name", ["sort_intervals", "sort_groups"])
def test_a_sort_is_one_exchange_by_ranges(spark, monkeypatch, name):
    """A group of nine tenths of the rows, with ids of text and a carried column, is many partitions."""
    rows = spark.range(20_000).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("idx"), F.when(F.col("id") % 10 > 0, "hot").otherwise("b").alias("grp"), F.lit(5).cast("long").alias("s"), (F.col("id") % 7 + 6).alias("e"), (F.col("id") % 3).alias("more"))
    monkeypatch.setattr(prefix, "kept", lambda df: df)
    plan = getattr(sw, name)(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") >= 1
    monkeypatch.undo()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = getattr(sw, name)(rows, sw.Spec(carry=("more",)))
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert "rangepartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    assert len(sizes) == 4 and max(sizes) < 2 * 5000
    taken = [(r.idx, r.pos) for r in got.select("idx", "pos").collect()]
    key = (lambda r: (r.grp, r.idx)) if name == "sort_groups" else (lambda r: (r.grp, r.s, r.e, r.idx))
    assert taken == [(r.idx, n) for n, r in enumerate(sorted(rows.collect(), key=key))]


def test_strands_of_a_large_group_are_cut_apart(spark, monkeypatch):
    rows = [(i, "hot", 10 * i, 10 * i + 5, i % 2 == 0) for i in range(2000)]
    df = spark.createDataFrame(rows, "idx long, grp string, s long, e long, neg boolean")
    plain = rows_of(sw.spliced_subsequence(df, 100, -100, spec=STRANDED))
    monkeypatch.setattr(prefix, "STRETCH_ROWS", 60)
    assert rows_of(sw.spliced_subsequence(df, 100, -100, spec=STRANDED)) == plain


@pytest.mark.parametrize("kind", ["long", "string"])
def test_groups_before_many_groups(spark, monkeypatch, kind):
    monkeypatch.setattr(prefix, "WINDOW_GROUPS", 100)
    rows = spark.range(2000).select((F.col("id") * 7919 % 100_003).cast(kind).alias("g"), (F.col("id") % 5).alias("n"))
    want, upto = {}, 0
    for r in sorted(rows.collect()):
        want[r.g] = (upto, len(want))
        upto += r.n
    got = {r.g: (r.a, r.b) for r in prefix.before_groups(rows, 2000, a=F.col("n"), b=F.lit(1)).collect()}
    assert got == want


UNARY = {
    "merge": lambda x: sw.merge(x, slack=1),
    "cluster": sw.cluster,
    "complement": lambda x: sw.complement(x, include_first=True),
    "split": lambda x: sw.split(x, slack=1),
    "max_disjoint": sw.max_disjoint,
    "window": lambda x: sw.window(x, 700, STRANDED),
    "group_cumsum": lambda x: sw.group_cumsum(x, STRANDED),
    "sort_intervals": lambda x: sw.sort_intervals(x, STRANDED),
    "sort_groups": sw.sort_groups,
    "carried": lambda x: sw.cluster(x, sw.Spec(strand="neg", carry=("neg", "grp"))),
    "spliced": lambda x: sw.spliced_subsequence(x, 10, -10, spec=STRANDED),
}
BINARY = {
    "subtract": sw.subtract,
    "count": lambda x, y: sw.count_overlaps(x, y, slack=2),
    "nearest": lambda x, y: sw.nearest(x, y, k=3),
    "first": lambda x, y: sw.overlaps(x, y, multiple="first"),
    "last": lambda x, y: sw.overlaps(x, y, multiple="last", slack=1),
    "either": lambda x, y: sw.overlaps_simple(x, y, multiple="first", contained=True, slack=2),
}


@pytest.mark.parametrize("name", [*UNARY, *BINARY])
def test_stretches(spark, sides, monkeypatch, name):
    run = (lambda: UNARY[name](sides[0])) if name in UNARY else (lambda: BINARY[name](*sides))
    plain = rows_of(run())
    monkeypatch.setattr(prefix, "STRETCH_ROWS", 60)
    assert rows_of(run()) == plain


@pytest.mark.parametrize("width", [1, 7, 100_000])
def test_bin_levels(sides, width):
    left, right = (x.collect() for x in sides)
    want = sorted(((p.idx, q.idx2) for p in left for q in right if p.grp == q.grp and max(p.s, 0) < q.e2 and q.s2 < p.e), key=repr)
    assert rows_of(sw.overlaps(*sides, bin_width=width), "idx", "idx2") == want


def test_counts_agree_with_pairs(sides):
    pairs = sw.overlaps(*sides).groupBy("idx").count()
    counted = sw.count_overlaps(*sides)
    assert rows_of(pairs, "idx", "count") == rows_of(counted.where("count > 0"), "idx", "count")
    assert counted.count() == sides[0].count()


def test_merge_again_changes_nothing(sides):
    once = sides[0].withColumn("grp", sides[0].grp)
    merged = sw.merge(once.where("grp = 'hot'").drop("grp"), sw.Spec(by=()))
    again = sw.merge(merged, sw.Spec(by=(), start="start", end="end"))
    assert rows_of(merged.drop("count")) == rows_of(again.drop("count"))


def test_streams(spark, sides, tmp_path):
    left, right = sides
    left.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(left.schema).parquet(str(tmp_path / "in"))
    found = {}
    for name, df in (("tiles", stream_tiles(stream, 1000)), ("pairs", overlaps_with_static(stream, right, 500)), ("median", overlaps_with_static(stream, right))):
        query = df.writeStream.format("memory").queryName(name).start()
        query.processAllAvailable()
        query.stop()
        found[name] = spark.table(name)
    assert rows_of(found["tiles"]) == rows_of(sw.tile(left, 1000))
    simple = sw.overlaps_simple(left, right, other=OTHER)
    assert rows_of(found["pairs"]) == rows_of(simple) == rows_of(found["median"])


def test_a_long_interval_of_a_stream(spark, tmp_path):
    """It becomes a few bins of each level, and so do the short ones of the other side."""
    rows = spark.createDataFrame([(0, "a", -(10**17), 10**17), (1, "a", 5, 6), (2, "b", 0, 10**9)], "idx long, grp string, s long, e long")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    right = spark.createDataFrame([(k, "a" if k % 2 else "b", 10**k, 10**k + k) for k in range(1, 18)], "idx2 long, grp string, s2 long, e2 long")
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = overlaps_with_static(stream, right, 1).writeStream.format("memory").queryName("long").start()
    query.processAllAvailable()
    query.stop()
    assert rows_of(spark.table("long")) == rows_of(sw.overlaps_simple(rows, right, other=OTHER))
    assert spark.table("long").count() == 8 + 4

"""Results against plain definitions, and plans that don't grow with the number of pairs."""

import random

import pytest
from pyspark.sql import functions as F

import spanweave as sw
from helpers import rows_of
from spanweave.operators import setops
from spanweave.plans import dyadic, prefix



@pytest.fixture(scope="module")
def drawn(spark):
    draw = random.Random(8)

    def side(n, first):
        return [(first + i, draw.choice("aaab"), s, s + draw.choice([1, 2, 3, 9, 40])) for i in range(n) for s in [draw.randint(-20, 90)]]

    left, right = side(70, 0), side(90, 1000)
    x = spark.createDataFrame(left, "idx long, grp string, s long, e long").cache()
    y = spark.createDataFrame(right, "idx2 long, grp string, s2 long, e2 long").cache()
    return left, right, x, y


def fits(function, contained, slack, a, b):
    (_, _, s, e), (_, _, s2, e2) = a, b
    if function == "overlaps":
        return s - slack >= s2 and e + slack <= e2 if contained else max(s - slack, 0) < e2 and s2 < e + slack
    if contained:
        return (s - slack <= s2 and e2 <= e + slack) or (s2 - slack <= s and e <= e2 + slack)
    return s < e2 + slack and s2 < e + slack


@pytest.mark.parametrize("radix", [4, 64])
@pytest.mark.parametrize("multiple", ["first", "last"])
@pytest.mark.parametrize("function", ["overlaps", "overlaps_simple"])
def test_first_and_last(drawn, monkeypatch, function, multiple, radix):
    """With blocks of four the tree is four levels high."""
    monkeypatch.setattr(dyadic, "RADIX", radix)
    left, right, x, y = drawn
    pick = min if multiple == "first" else max
    for contained, slack in ((False, 0), (True, 2)) if radix == 4 else ((False, 0), (False, 5), (True, 0), (True, 3)):
        want = []
        for a in left:
            met = [(b[2], b[0]) for b in right if a[1] == b[1] and fits(function, contained, slack, a, b)]
            want += [(a[0], pick(met)[1])] if met else []
        got = getattr(sw, function)(x, y, multiple=multiple, contained=contained, slack=slack)
        assert rows_of(got, "idx", "idx2") == sorted(want, key=repr)


def most_rows(spark, before):
    """The most rows that a step of a query after ``before`` put out or shuffled."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found, executions = 0, store.executionsList()
    for i in range(before, executions.size()):
        execution = executions.apply(i)
        values = store.executionMetrics(execution.executionId())
        metrics = execution.metrics()
        for j in range(metrics.size()):
            m = metrics.apply(j)
            if m.name() in ("number of output rows", "shuffle records written", "records read") and values.contains(m.accumulatorId()):
                found = max(found, int(values.apply(m.accumulatorId()).split("\n")[-1].split(" ")[0].replace(",", "")))
    return found


@pytest.mark.parametrize("multiple", ["first", "last"])
def test_no_pairs_are_made(spark, multiple):
    """Each of 200 left rows meets 10,000 right ones: two million pairs that no step makes."""
    x = spark.range(200).select(F.col("id").alias("idx"), F.lit(1).alias("grp"), F.col("id").alias("s"), (F.col("id") + 20_000).alias("e"))
    y = spark.range(10_000).select(F.col("id").alias("idx2"), F.lit(1).alias("grp"), (F.col("id") + 200).alias("s2"), (F.col("id") + 201).alias("e2"))
    before = spark._jsparkSession.sharedState().statusStore().executionsList().size()
    got = sw.overlaps(x, y, multiple=multiple).collect()
    assert {r.idx2 for r in got} == {0 if multiple == "first" else 9999} and len(got) == 200
    assert 10_000 <= most_rows(spark, before) <= 4 * 10_200


@pytest.mark.parametrize("direction", ["any", "forward", "backward"])
def test_nearest(drawn, direction):
    left, right, x, y = drawn
    for k, slack, include in ((1, 0, True), (3, 0, True), (2, 4, False)):
        want = []
        for i, g, s, e in left:
            s, e = s - slack, e - slack
            met = []
            for j, h, s2, e2 in right:
                if g == h:
                    if e2 <= s and direction != "forward":
                        met.append((s - e2 + 1, j))
                    elif s2 >= e and direction != "backward":
                        met.append((s2 - e + 1, j))
                    elif s < e2 and s2 < e and include:
                        met.append((0, j))
            least = sorted({d for d, _ in met})[:k]
            want += [(i, j, d) for d, j in met if d in least]
        got = sw.nearest(x, y, k=k, slack=slack, include_overlaps=include, direction=direction)
        assert rows_of(got, "idx", "idx2", "distance") == sorted(want, key=repr)


def test_subtract(drawn):
    left, right, x, y = drawn
    want = []
    for i, g, s, e in left:
        free = [p for p in range(s, e) if not any(g == h and s2 <= p < e2 for _, h, s2, e2 in right)]
        starts = [p for p in free if p - 1 not in free]
        want += [(i, p, next(q for q in range(p, e + 1) if q not in free)) for p in starts]
    assert rows_of(sw.subtract(x, y), "idx", "start", "end") == sorted(want, key=repr)
    assert rows_of(sw.subtract(x, y.where("false")), "idx", "start", "end") == sorted(((i, s, e) for i, _, s, e in left), key=repr)
    assert sw.subtract(x.where("false"), y).collect() == []


def greedy(rows, slack):
    last, taken = {}, []
    for i, g, s, e in sorted(rows, key=lambda r: (r[1], r[2], r[3], r[0])):
        if g not in last or s > last[g] + 3 * slack:
            last[g] = e
            taken.append((i,))
    return sorted(taken, key=repr)


@pytest.mark.parametrize("slack", [0, 1])
def test_max_disjoint_by_chains(spark, drawn, monkeypatch, slack):
    left, _, x, _ = drawn
    assert rows_of(sw.max_disjoint(x, slack=slack)) == greedy(left, slack)
    monkeypatch.setattr(setops, "FOLDED", 3)
    assert rows_of(sw.max_disjoint(x, slack=slack)) == greedy(left, slack)


def test_one_long_island(spark, monkeypatch):
    """A chain through thousands of rows of one island, which no task holds."""
    draw = random.Random(2)
    rows = [(i, "a", s, s + draw.randint(2, 30)) for i in range(3000) for s in [draw.randint(0, 9000)]]
    df = spark.createDataFrame(rows, "idx long, grp string, s long, e long")
    monkeypatch.setattr(prefix, "STRETCH_ROWS", 1000)
    monkeypatch.setattr(setops, "FOLDED", 100)
    got = sw.max_disjoint(df)
    assert rows_of(got) == greedy(rows, 0) and len(greedy(rows, 0)) > 400
    assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()


def test_rows_left_out_of_tiles_and_bounds(spark):
    """Rows with a null id, group, bound or length, empty intervals, and parts that are empty."""
    rows = [(0, "a", 5, 20, 10), (None, "a", 5, 9, 10), (1, None, 5, 9, 10), (2, "a", None, 9, 10), (3, "a", 5, None, 10), (4, "a", 5, 5, 10), (5, "a", -4, 3, 0), (6, "a", 2, 4, None), (7, "a", 2, 4, 10)]
    df = spark.createDataFrame(rows, "idx long, grp string, s long, e long, n long")
    assert rows_of(sw.tile(df, 10), "idx", "start", "end") == [(0, 0, 10), (0, 10, 20), (5, -10, 0), (5, 0, 10), (6, 0, 10), (7, 0, 10)]
    assert rows_of(sw.genome_bounds(df, "n"), "idx", "start", "end") == [(7, 2, 4)]
    assert rows_of(sw.genome_bounds(df, "n", clip=True), "idx", "start", "end") == [(0, 5, 10), (7, 2, 4)]
    assert rows_of(sw.genome_bounds(df, "n", clip=True, only_right=True), "idx", "start", "end") == [(0, 5, 10), (5, -4, 0), (7, 2, 4)]
    assert rows_of(sw.tile(df.drop("grp"), 10), "idx", "start").count((1, 0)) == 1


def test_values_after_a_row_take_linear_time(spark):
    """The gap after each of 200,000 islands of one group, which a frame to the end of the group would fold anew for each."""
    df = spark.range(200_000).select(F.col("id").alias("idx"), F.lit(1).alias("grp"), (F.col("id") * 10).alias("s"), (F.col("id") * 10 + 4).alias("e"))
    gaps = sw.complement(df)
    assert gaps.agg(F.count("*"), F.sum(F.col("end") - F.col("start"))).first()[:2] == (199_999, 6 * 199_999)

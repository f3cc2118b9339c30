"""Published examples of the interval functions."""

import pytest

import spanweave as sw
from helpers import rows_of
from spanweave.model import SPEC, Spec
from spanweave.operators.joins import OTHER

ONE, TWO = Spec(by=()), Spec(idx="idx2", by=(), start="s2", end="e2")


def a(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "idx long, s long, e long" if len((rows or [(0, 0)])[0]) == 2 else "idx long, grp string, s long, e long")


def b(spark, *rows):
    return a(spark, *rows).withColumnsRenamed({"idx": "idx2", "s": "s2", "e": "e2"})


def test_overlaps_by_chromosome_and_strand(spark):
    left = a(spark, ("1+", 1, 5), ("1+", 10, 15), ("2-", 30, 35))
    right = b(spark, ("1+", 3, 6), ("2-", -50, 50), ("2-", 0, 2))
    assert rows_of(sw.overlaps(left, right)) == [(0, 0), (2, 1)]


def test_nearest_two(spark):
    got = sw.nearest(a(spark, (1, 5), (10, 15), (30, 35)), b(spark, (3, 6), (20, 25), (28, 32)), ONE, TWO, k=2, include_overlaps=False)
    assert rows_of(got, "idx", "idx2", "distance") == [(0, 1, 16), (0, 2, 24), (1, 0, 5), (1, 1, 6), (2, 0, 25), (2, 1, 6)]


def test_subtract(spark):
    got = sw.subtract(a(spark, (0, 10), (10, 20)), b(spark, (5, 15), (12, 18)), ONE, TWO)
    assert rows_of(got, "idx", "start", "end") == [(0, 0, 5), (1, 18, 20)]


def test_overlaps_without_and_with_groups(spark):
    assert rows_of(sw.overlaps(a(spark, (1, 5), (10, 15)), b(spark, (3, 6), (20, 25)), ONE, TWO)) == [(0, 0)]
    assert rows_of(sw.overlaps(a(spark, ("1", 1, 5), ("2", 1, 5)), b(spark, ("1", 3, 6), ("2", 20, 25)))) == [(0, 0)]


def test_overlaps_simple(spark):
    got = sw.overlaps_simple(a(spark, (0, 100), (10, 12), (20, 25)), b(spark, (1, 2), (5, 8), (11, 13), (24, 30), (99, 101)), ONE, TWO)
    assert rows_of(got) == [(0, 0), (0, 1), (0, 2), (0, 3), (0, 4), (1, 2), (2, 3)]
    assert rows_of(sw.overlaps_simple(a(spark, (0, 5), (5, 10)), b(spark, (5, 6), (10, 11)), ONE, TWO)) == [(1, 0)]
    assert [rows_of(sw.overlaps_simple(a(spark, (0, 5)), b(spark, (6, 7)), ONE, TWO, slack=k)) for k in (0, 2)] == [[], [(0, 0)]]


def test_overlaps_of_nothing(spark):
    empty = a(spark, (0, 1)).where("false")
    assert rows_of(sw.overlaps_simple(empty, b(spark, (0, 2), (1, 3)), ONE, TWO)) == []
    assert rows_of(sw.complement_overlaps(a(spark, (0, 2)), b(spark, (0, 2)).where("false"), ONE, TWO)) == [(0,)]


def test_complement_overlaps(spark):
    assert rows_of(sw.complement_overlaps(a(spark, (1, 5), (10, 15), (30, 35)), b(spark, (3, 6), (20, 25)), ONE, TWO)) == [(1,), (2,)]


def test_tile(spark):
    got = rows_of(sw.tile(a(spark, (99, 100), (100, 250)), 100), "idx", "start", "end", "fraction")
    assert got == [(0, 0, 100, 0.01), (1, 100, 200, 1.0), (1, 200, 300, 0.5)]


def test_merge_and_cluster(spark):
    rows = a(spark, ("0", 0, 5), ("0", 5, 9))
    assert rows_of(sw.merge(rows), "idx", "start", "end", "count") == [(0, 0, 5, 1), (1, 5, 9, 1)]
    assert rows_of(sw.merge(rows, slack=1), "idx", "start", "end", "count") == [(1, 0, 9, 2)]
    assert rows_of(sw.cluster(a(spark, ("0", 0, 5), ("0", 5, 9), ("1", 0, 5))), "cluster_id", "idx") == [(0, 0), (1, 1), (3, 2)]


def test_max_disjoint_and_complement(spark):
    assert rows_of(sw.max_disjoint(a(spark, (0, 100), (1, 2), (3, 4)), ONE)) == [(0,)]
    assert rows_of(sw.complement(a(spark, (0, 5), (10, 12)), spec=ONE, slack=2), "start", "end") == [(7, 10)]


def test_arguments_are_checked(spark):
    one, two = a(spark, (0, 1)), b(spark, (0, 1))
    for call in (
        lambda: sw.overlaps(one, two, ONE, TWO, multiple="contained"),
        lambda: sw.nearest(one, two, ONE, TWO, direction="up"),
        lambda: sw.overlaps(one, two, ONE, OTHER),
        lambda: sw.tile(one, 0),
        lambda: sw.window(one, 0, ONE),
    ):
        with pytest.raises(ValueError):
            call()


def test_rows_without_id_or_bounds_are_left_out(spark):
    rows = spark.createDataFrame([(0, "x", 1, 5), (None, "x", 1, 5), (2, None, 1, 5), (3, "x", None, 5), (4, "x", 5, 5)], "idx long, grp string, s long, e long")
    assert rows_of(sw.merge(rows, SPEC), "idx", "start", "end", "count") == [(0, 1, 5, 1)]


def test_several_group_columns(spark):
    spec, other = Spec(by=("grp", "neg")), Spec(idx="idx2", by=("grp", "neg"), start="s2", end="e2")
    left = spark.createDataFrame([(0, "x", True, 1, 5), (1, "x", False, 1, 5)], "idx long, grp string, neg boolean, s long, e long")
    right = left.withColumnsRenamed({"idx": "idx2", "s": "s2", "e": "e2"})
    assert rows_of(sw.overlaps(left, right, spec, other)) == [(0, 0), (1, 1)]
    assert rows_of(sw.complement(left, spec=spec, include_first=True), "grp", "neg", "start", "end") == [("x", False, 0, 1), ("x", True, 0, 1)]

"""Hard negatives against all products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import rows_of
from spanweave.llm import negatives
from spanweave.llm.negatives import Scale, Tree, hard_negatives

COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def plain(rows, asks, positives=5, negatives=5, least=80, most=100, factor=256.0):
    clip = lambda x: min(max(x, -(1 << 63)), (1 << 63) - 1)
    valid = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        valid[i] = min(valid.get(i, (label, v)), (label, v))
    vectors = {i: (label, [clip(math.floor(factor * x)) for x in v]) for i, (label, v) in valid.items()}
    found = []
    for a in filter(asks, vectors):
        score = {i: clip(sum(x * y for x, y in zip(vectors[a][1], vectors[i][1]))) for i in vectors if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if vectors[i][0] == vectors[a][0]][:positives]:
            near = [i for i in order if vectors[i][0] != vectors[a][0] and least * score[p] <= 100 * score[i] <= most * score[p]]
            found += [(a, p, r + 1, n, score[p], score[n]) for r, n in enumerate(near[:negatives])]
    return sorted(found, key=repr)


def vectors_of(n, seed, clusters=12, width=6):
    draw = np.random.default_rng(seed)
    centers = draw.normal(size=(clusters, width))
    return [(i, [float(np.float32(x)) for x in centers[c] + 0.2 * draw.normal(size=width)], int(draw.integers(3))) for i, c in enumerate(draw.integers(clusters, size=n))]


@pytest.mark.parametrize("small", [False, True])
def test_against_all_products(spark, monkeypatch, small):
    """With small leaves, blocks and parts, node pairs are pruned, and blocks and parts are many."""
    if small:
        for name, value in (("LEAF_ROWS", 20), ("BLOCK_ROWS", 16), ("PART_ROWS", 8), ("SCORES", 100), ("SAMPLE", 200)):
            monkeypatch.setattr(negatives, name, value)
    rows = vectors_of(600, 1)
    # Copies: many equal scores.
    rows += [(1000 + i, rows[5][1], i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for options in ({}, {"positives": 2, "negatives": 7, "least": 50, "most": 95}):
        got = hard_negatives(df, F.col("vec_id") % 10 == 0, **options)
        assert rows_of(got, *COLUMNS) == plain(rows, lambda i: i % 10 == 0, **options)


def test_pruned_pairs_hold_no_wanted_score():
    draw = np.random.default_rng(2)
    points = np.floor(256 * np.array([v for _, v, _ in vectors_of(900, 2)]))
    tree, scale = Tree(points, 40), Scale(points.shape[1], 5000)
    leaf, away = tree.leaf(points)
    assert (tree.left[leaf] < 0).all() and len(set(leaf)) == 40
    asks = draw.choice(900, 90, replace=False)
    score = scale.products(points[asks], points)
    low = np.sort(score, axis=1)[:, -6]
    radius = {x: away[leaf == x].max() for x in set(leaf.tolist())}
    groups = {x: (away[asks][leaf[asks] == x].max(), low[leaf[asks] == x].min(), np.inf) for x in set(leaf[asks].tolist())}
    kept = set(zip(*(x.tolist() for x in tree.pairs(groups, radius))))
    wanted = {(leaf[asks[i]], leaf[j]) for i, j in zip(*np.nonzero(score >= low[:, None]))}
    assert wanted <= kept
    assert len(kept) < 0.5 * len(groups) * len(radius)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (None, [1.0, 0.0], 1),
        (0, [1.0, 0.5], 1),
        (0, [1.0, 0.5], 1),
        (0, [0.5, 0.5], 2),
        (10, [1.0], 1),
        (11, [0.9, 0.1, 0.3], 2),
        (12, [], 2),
        (20, None, 1),
        (21, [1.0, None], 1),
        (22, [1.0, nan], 1),
        (23, [inf, 1.0], 2),
        (24, [1.0, 1.0], None),
        (30, [-1.0, 0.1], 1),
        (31, [-0.9, 0.1], 2),
        (32, [0.95, 0.4], 2),
        (33, [0.95, 0.4], 2),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("clash") for c in ("id", "q", "v", "leaf", "anchor", "score", "low", "rank", "w")})
    got = hard_negatives(df, F.col("vec_id") % 10 == 0)
    want = plain(rows, lambda i: i % 10 == 0)
    assert want and rows_of(got, *COLUMNS) == want
    for empty in (df.where("false"), df.where("vec_id = 20"), df.where("vec_id = 11"), df.where("vec_id = 10")):
        assert hard_negatives(empty, F.col("vec_id") % 10 == 0).select(*COLUMNS).collect() == []


@pytest.mark.parametrize("size", [1.0, 1e4, 1e8, 1e12, 1e30])
def test_sizes_of_components(spark, size):
    """Products beyond doubles are exact, and beyond longs are the nearest long."""
    draw = random.Random(4)
    rows = [(i, [size * draw.random(), size * draw.random() / 3], i % 2) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = hard_negatives(df, F.col("vec_id") % 10 == 0, least=10)
    assert rows_of(got, *COLUMNS) == plain(rows, lambda i: i % 10 == 0, least=10)


def test_ids_of_text(spark):
    rows = [(f"x{i:03}", v, label) for i, v, label in vectors_of(80, 6)]
    df = spark.createDataFrame(rows, "key string, v array<float>, kind int")
    got = hard_negatives(df, F.col("key").endswith("0"), vec_id="key", embedding="v", label="kind")
    assert rows_of(got, *COLUMNS) == plain(rows, lambda i: i.endswith("0"))

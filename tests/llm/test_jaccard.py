"""The n-gram Jaccard join against all pairs."""

import random

import numpy as np
import pytest

from helpers import rows_of
from spanweave.llm import jaccard
from spanweave.llm.jaccard import CELLS, Index, frequencies, jaccard_groups, may_link, parity, unequal


def cell(x):
    return x // ((1 << 64) // CELLS)


@pytest.mark.parametrize("percent", [75, 85, 93, 100])
@pytest.mark.parametrize("common", [0.0, 0.5, 1.0])
def test_linked_sets_share_a_key(percent, common):
    """Whatever the frequencies are: tokens of all three classes in any mixture, and sizes of several levels."""
    draw = random.Random(percent)
    counts = np.zeros(CELLS, np.int64)
    frequent = [draw.getrandbits(64) for _ in range(4000)]
    for x in frequent:
        counts[cell(x)] = draw.choice([100, 1000, 10_000, 100_000])
    index = Index(counts, percent)
    linked = 0
    for _ in range(250):
        n = draw.choice([1, 2, 5, 6, 7, 8, 13, 14, 15, 16, 27, 31, 32, 54, 64, 100, 200, 220, 256, 300])
        x = {draw.choice(frequent) if draw.random() < common else draw.getrandbits(64) for _ in range(n)}
        most = max(0, int((100 - percent) * n / percent))
        y = set(draw.sample(sorted(x), len(x) - draw.randint(0, min(most, len(x) - 1)))) | {draw.choice(frequent) if draw.random() < common else draw.getrandbits(64) for _ in range(draw.randint(0, most))}
        one, two = (np.array(sorted(s), np.uint64) for s in (x, y))
        differing = np.array([len(x ^ y)])
        if x != y and 100 * len(x & y) >= percent * len(x | y):
            linked += 1
            assert np.intersect1d(index.keys(one), index.keys(two)).size
            assert may_link(np.array([len(x)]), len(y), differing, percent).all()
            bits = np.bitwise_count(np.frombuffer(parity(one), np.uint8) ^ np.frombuffer(parity(two), np.uint8)).sum(dtype=int)
            assert bits <= differing[0]
            assert unequal(parity(one, 4096), parity(two, 1024)) == bits
    assert linked > 20 or percent == 100


def words(draw, n, of=50_000):
    return [f"w{draw.randrange(of)}" for _ in range(n)]


def changed(draw, base, n):
    out = list(base)
    for _ in range(n):
        out[draw.randrange(len(out))] = f"x{draw.randrange(10**6)}"
    return " ".join(out)


def corpus():
    draw = random.Random(11)
    frame = words(draw, 90)
    texts = []
    # A large group of near copies, chains of them, pages of one frame that don't link, copies, and single texts.
    texts += [changed(draw, frame, draw.randint(0, 2)) for _ in range(120)]
    texts += [" ".join(frame + words(draw, draw.randint(3, 14))) for _ in range(120)]
    chain = words(draw, 160)
    for _ in range(12):
        chain = changed(draw, chain, 3).split()
        texts.append(" ".join(chain))
    texts += [" ".join(words(draw, draw.choice([1, 3, 4, 9, 30, 60]))) for _ in range(60)]
    for n in (6, 9, 10, 11, 20, 40, 80, 300):
        base = words(draw, n)
        texts += [" ".join(base), " ".join(base[1:]), " ".join(base[:-1]), " ".join(base), changed(draw, base, 1)]
    draw.shuffle(texts)
    return list(enumerate(texts))


def shingled(text, n):
    w = [x.lower() for x in text.split()]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def plain(rows, shingle=4, percent=85):
    sets = [(i, shingled(t or "", shingle)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                u, v = root(i), root(j)
                parent[max(u, v)] = min(u, v)
    return sorted(((i, len(x), root(i)) for i, x in sets), key=repr)


@pytest.mark.parametrize("settings", [{}, {"PAIRS_FROM": 3, "TRIPLES_FROM": 40, "BLOCK": 8, "QUERIES": 8, "PARITY": 1}])
def test_groups(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = rows_of(jaccard_groups(df), "doc_id", "n_shingles", "component_id")
    assert got == plain(rows)
    assert len({c for _, _, c in got}) < len(rows) - 120


def test_other_similarity_and_ids_of_text(spark):
    rows = [(f"d{i:04}", t) for i, t in corpus()]
    df = spark.createDataFrame(rows, "key string, body string")
    assert rows_of(jaccard_groups(df, 3, 75, "key", "body"), "doc_id", "n_shingles", "component_id") == plain(rows, 3, 75)
    with pytest.raises(ValueError):
        jaccard_groups(df, percent=60, doc_id="key", text="body")


def test_frequencies_count_each_document_once(spark):
    df = spark.createDataFrame([("a b c d e",), ("a b c d a b c d",), (None,), ("",)], "text string")
    counts = frequencies(df, "text", 4)
    assert counts.sum() == len(shingled("a b c d e", 4)) + len(shingled("a b c d a b c d", 4)) and counts.max() == 2


def test_odd_rows(spark, odd):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_groups(odd).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (5, 5, 4), (4, 5, 4), (6, 1, 6), (8, 1, 6), (None, 0, None)} <= got
    assert jaccard_groups(odd).count() == odd.count()
    assert jaccard_groups(odd.where("false")).collect() == []
    # Rows of one id and different texts tie their groups together.
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(1, base), (2, base + " x"), (2, "other text of the same id"), (3, "other text of the same id"), (4, "alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard_groups(df).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}

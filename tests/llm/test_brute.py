"""Operators that SQL can't express, against plain versions, the library and held-out rows."""

import collections
import hashlib
import random
import re
import zlib
from urllib.parse import urljoin
from math import floor, log, log2, log10

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from spanweave.llm.components import connected_components
from spanweave.llm.bpe import Encoder, WordBpe, bpe_encode
from spanweave.llm import maxent, toxicity
from spanweave.llm.maxent import lm_scores
from spanweave.llm.near import near_groups
from spanweave.llm.queries import QUERIES
from spanweave.llm.spans import LONE_WORDS, LONG_WORD, PAIR_WORDS, SEVERAL, span_report
from spanweave.llm.urls import url_verdicts
from spanweave.llm.text import BASE, BYTES, alnum_words, space_words

BPE = public_tokenizers.path("word_bpe_49k.json")


def library(texts):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(BPE)
    return [(np.array(x.ids, "<u4").tobytes(), tool.decode(x.ids, skip_special_tokens=False)) for x in tool.encode_batch(texts, add_special_tokens=False)]


def test_bpe_equals_the_library(spark, folder, texts):
    got = {r.doc_id: r for r in QUERIES["op9_bpe"](spark, folder).collect()}
    for (i, _), (ids, shown) in zip(texts, library([t for _, t in texts]), strict=True):
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(shown.encode()).hexdigest())


def test_bpe_on_odd_characters():
    draw = random.Random(3)
    signs = "aAbB éÉΣσ'stlm1٣漢🤷\x1c\x1f\x85\xa0　​\n\t.,-<|>_İı́ͅ"
    texts = ["".join(draw.choice(signs) for _ in range(draw.randint(0, 60))) for _ in range(2000)]
    texts += ["aaaa aaaaa aaa", "x<|endoftext|>Y <|startoftext|>", "<|ENDOFTEXT|>", "it's I'LL 'tis"]
    encoder = Encoder(WordBpe.load(BPE))
    raw = [t.encode() for t in texts]
    encoder.learn(raw)
    assert [encoder.encode(t) for t in raw] == [(i, d.encode()) for i, d in library(texts)]


def test_bpe_of_texts_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr("spanweave.llm.bpe.BATCH_BYTES", 200)
    monkeypatch.setattr("spanweave.llm.bpe.KEPT_WORDS", 20)
    monkeypatch.setattr("spanweave.llm.bpe.DECODED", 7)
    texts = ["", " \n", "It's a Text, cut\tinto parts. " * 40, "unspaced" * 60, "x " * 300 + "<|endoftext|>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r for r in bpe_encode(docs, BPE, keep=("doc_id", "ids")).collect()}
    for i, (ids, shown) in enumerate(library(texts)):
        assert np.array(got[i].ids, "<u4").tobytes() == ids and got[i].decoded == shown and got[i].n_tokens == len(ids) // 4


def test_near_copies_of_many_kinds(spark):
    draw = random.Random(7)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    docs = []
    for _ in range(12):
        base = [word() for _ in range(draw.randint(30, 90))]
        for _ in range(25):
            copy = list(base)
            for _ in range(draw.randint(0, 5)):
                copy[draw.randrange(len(copy))] = word()
            docs.append(" ".join(copy))
    draw.shuffle(docs)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (space_words(t.encode()) for t in docs)]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            m = len(sets[i] & sets[j])
            if 100 * m >= 75 * (len(sets[i]) + len(sets[j]) - m):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    got = {r.doc_id: r.component_id for r in near_groups(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    assert got == {i: root(i) for i in range(len(docs))}


def span_cuts(rows):
    """Of (place, text) rows: the sentences of each, and those that lie in any repeated run but its first occurrence."""
    split, found = {}, {}
    for i, t in rows:
        sentences = [x.decode() for x in re.findall(rb"(?s)\n|.+?(?:(?:[.!?]|\xd8\x9f|\xdb\x94|\xe0\xa5\xa4)+(?=\s)[ \t]*\n?|(?:\xe3\x80\x82|\xef\xbc[\x81\x9f])+[ \t]*\n?|\n|\Z)", t.encode())]
        words = [tuple(alnum_words(x.encode())) for x in sentences]
        size = [sum(len(w) * 2 // LONG_WORD if len(w) > LONG_WORD else 1 for w in x) for x in words]
        split[i] = sentences
        spoken = [k for k, w in enumerate(words) if w]
        for a in range(len(spoken)):
            n = 0
            # All runs, not only the shortest, of up to a few sentences.
            for b in range(a, min(len(spoken), a + 24)):
                n += size[spoken[b]]
                if sum(map(bool, words[spoken[a] : spoken[b] + 1])) >= SEVERAL or n >= (PAIR_WORDS if b > a else LONE_WORDS):
                    run = range(spoken[a], spoken[b] + 1)
                    found.setdefault(tuple(w for x in run for w in words[x]), []).append((i, run))
    cut = collections.defaultdict(set)
    for places in found.values():
        first = min((i, run.start) for i, run in places)
        for i, run in places:
            if (i, run.start) != first:
                cut[i].update(run)
    return split, cut


def test_spans(spark, folder, texts):
    split, cut = span_cuts(texts)
    got = {r.doc_id: r for r in QUERIES["op7_span_dedup"](spark, folder).collect()}
    for i, sentences in split.items():
        assert got[i].text == "".join(x for k, x in enumerate(sentences) if k not in cut[i])
        assert (got[i].n_sentences, got[i].n_removed) == (len(sentences), len(cut[i]))
    assert any(cut.values())


def test_short_runs_of_sentences(spark):
    texts = ["One came. Two went home. Three stayed there for long. Other end.", "A start. One came. Two went home. Three stayed there for long. All else.", "Two went home. Then nothing. One came. Two went home."]
    split, cut = span_cuts(list(enumerate(texts)))
    got = {r.doc_id: r for r in span_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {i: got[i].n_removed for i in got} == {i: len(cut[i]) for i in split} == {0: 0, 1: 3, 2: 0}
    assert got[1].text == "A start. All else."


def test_spans_of_rows_that_share_an_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(14)) + ". And so on. " for x in "abc")
    ends = "\u3042" * 20 + "\u3002" + "\u3044" * 30 + "\uff01"
    cases = [[(1, a + b), (1, None)], [(1, a + b), (1, "short one.")], [(1, a), (2, b + " " + a), (2, b)], [(1, a), (2, a), (2, b)], [(3, a + b), (3, c + a), (4, b + c), (4, "x " + a)], [(1, ends), (2, c + ends), (2, ends)]]
    for rows in cases:
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        key = {tuple(r)[:2]: r.row for r in docs.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) as row").collect()}
        split, cut = span_cuts([((i, key[i, t]), t or "") for i, t in rows])
        got = {(r.doc_id, r.text): r.n_removed for r in span_report(docs).collect()}
        want = {(i, None if t is None else "".join(x for k, x in enumerate(split[i, key[i, t]]) if k not in cut[i, key[i, t]])): len(cut[i, key[i, t]]) for i, t in rows}
        assert got == want


def test_scores(spark, folder, texts):
    got = {r.doc_id: r for r in QUERIES["op10_lm_scoring"](spark, folder).collect()}
    tokens = {i: [*space_words(t.encode()), b" end"] for i, t in texts}
    train = {i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2}
    counts = collections.Counter(w for i in train for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    base = model = 0
    for i, words in tokens.items():
        want = sum(log10((counts[w] + 1) / (n + v + 1)) for w in words)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in train, len(words), sum(counts[w] > 0 for w in words), n)
        assert abs(r.base_score - want) < 1e-6 * abs(want)
        if r.held_out:
            base, model = base + r.base_score, model + r.score
    assert model > base


def plain_scores(rows, train):
    """``score`` of every (doc_id, text, salt, later) row by the model's definition, token by token."""
    m64, fan = (1 << 64) - 1, maxent.FAN

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & m64
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & m64
        return x ^ (x >> 31)

    def word(x):
        return mix((sum(int(BYTES[b]) * pow(BASE, i, 1 << 64) for i, b in enumerate(x)) + len(x)) & m64)

    end, before = int(maxent.END), int(maxent.BEFORE)
    marks, factors = (list(map(int, x)) for x in (maxent.MARKS, maxent.FACTORS))
    docs = {i: [*map(word, space_words((t or "").encode())), end] for i, t, _, _ in rows}
    counts = collections.Counter(w for i in docs if i in train for w in docs[i])
    levels = min(maxent.LEVELS, 1 + (len(counts) > 24) + (len(counts) > 768))
    grades = collections.Counter(floor(log2(c) * 16) for c in counts.values())
    frequent = {g for g in grades if sum(n for x, n in grades.items() if x >= g) <= maxent.HEAD_WORDS}
    ranked = sorted((w for w in counts if floor(log2(counts[w]) * 16) in frequent), key=lambda w: (-counts[w], w))[: fan**levels * 3 // 4]
    digits = lambda place: [place // fan**k % fan for k in range(levels)]
    shared = fan**levels // 4
    path = {w: digits(r) for r, w in enumerate(ranked)}
    path_of = lambda w: path[w] if w in path else digits(fan**levels * 3 // 4 + (w >> (64 - shared.bit_length() + 1)))
    inside, mass = collections.defaultdict(float), collections.defaultdict(float)
    for k in range(shared):
        inside[tuple(digits(fan**levels * 3 // 4 + k))] += 1
    for w, c in counts.items():
        if w not in path:
            inside[tuple(path_of(w))] += c + 1
    for p, x in [*inside.items(), *((tuple(path[w]), counts[w] + 1) for w in path)]:
        for k in range(levels + 1):
            mass[p[:k]] += x
    bits = min(17, max(11, (len(counts) - 1).bit_length()))

    def share(node):
        return [max(log(mass[(*node, j)] / mass[node]), -60) if mass[(*node, j)] else -60 if mass[node] else -log(fan) for j in range(fan)]

    def steps(tokens):
        for at, w in enumerate(tokens):
            one, two = (tokens[at - k] if at >= k else before for k in (1, 2))
            one, two = mix(one), mix(two * 3 & m64)
            context = [mix(one ^ marks[0]), mix((one + two * 5 & m64) ^ marks[1]), mix(two ^ marks[2])]
            p = path_of(w)
            for k in range(levels):
                own = bits - 5 * k
                yield at, k, tuple(p[:k]), p[k], [(k, tuple(p[:k]), mix(c + factors[k] & m64) >> (64 - own)) for c in context], context

    weights = collections.defaultdict(lambda: np.zeros(fan))

    def softmax(node, cells):
        z = np.exp(np.array(share(node)) + sum(weights[c] for c in cells))
        return z / z.sum()

    rounded = lambda x: np.clip(x, -maxent.MOST, maxent.MOST).astype(np.float16).astype(float)
    for k in range(2):
        seen, drawn = (collections.defaultdict(lambda: np.zeros(fan)) for _ in range(2))
        for i, _, salt, later in rows:
            if i in train and (k == 0 or later):
                for at, level, node, member, cells, context in steps(docs[i]):
                    for c in cells:
                        seen[c][member] += 1
                    if k:
                        chance = (mix(mix(context[1] + salt + at * marks[0] & m64) ^ factors[level]) >> 40) / (1 << 24)
                        guess = min(int((np.cumsum(softmax(node, cells)) < chance).sum()), fan - 1)
                        for c in cells:
                            drawn[c][guess] += 1
        for c in seen:
            if k:
                weights[c] = rounded(weights[c] + maxent.LATER_RATE * np.log((seen[c] + maxent.LATER_PRIOR) / (drawn[c] + maxent.LATER_PRIOR)))
            else:
                weights[c] = rounded(maxent.RATE * np.log((seen[c] + maxent.PRIOR) / (seen[c].sum() * np.exp(share(c[1])) + maxent.PRIOR)))
    scores = {}
    for i, tokens in docs.items():
        scores[i] = sum(log10(softmax(node, cells)[member]) for _, _, node, member, cells, _ in steps(tokens))
        scores[i] += sum(log10((counts[w] + 1) / inside[tuple(path_of(w))]) for w in tokens if w not in path)
    return scores


@pytest.mark.parametrize(("words", "levels", "head"), [(15, 3, 8), (200, 3, 1000), (1500, 3, 2000), (1500, 2, 600)])
def test_scores_by_definition(spark, monkeypatch, words, levels, head):
    monkeypatch.setattr("spanweave.llm.maxent.LEVELS", levels)
    monkeypatch.setattr("spanweave.llm.maxent.HEAD_WORDS", head)
    monkeypatch.setattr("spanweave.llm.maxent.STEP_TOKENS", 64)
    draw = random.Random(words)
    vocabulary = [f"w{k}" for k in range(words)]
    texts = [" ".join(draw.choice(vocabulary[: 1 + int(words * draw.random() ** 2)]) for _ in range(draw.randint(0, 90))) for _ in range(60)]
    texts[3:6] = None, texts[7], texts[7] + " never met before"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    train = "doc_id % 5 <> 3"
    rows = [(r.doc_id, r.text, r.salt % (1 << 64), r.later) for r in docs.selectExpr("doc_id", "text", "xxhash64(doc_id) as salt", "true as later").collect()]
    want = plain_scores(rows, {i for i in range(len(texts)) if i % 5 != 3})
    got = {r.doc_id: r.score for r in lm_scores(docs, train=train).collect()}
    assert all(abs(got[i] - want[i]) < 2e-3 * abs(want[i]) for i in want)


@pytest.mark.parametrize("words", [15, 200])
def test_every_round_of_the_query_learns_from_all_training_rows(spark, tmp_path, words):
    draw = random.Random(words)
    vocabulary = [f"w{k}" for k in range(words)]
    texts = [" ".join(draw.choice(vocabulary[: 1 + int(words * draw.random() ** 2)]) for _ in range(draw.randint(0, 90))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r.doc_id, r.text, r.salt % (1 << 64), True) for r in docs.selectExpr("doc_id", "text", "xxhash64(doc_id) as salt").collect()]
    want = plain_scores(rows, {i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 7 != 2})
    got = {r.doc_id: r.score for r in QUERIES["op10_lm_scoring"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 2e-3 * abs(want[i]) for i in want)


def test_scores_sum_to_one(spark):
    known = ["a b c d e f g"] * 5 + ["a c"] * 3
    rows = [(k, x, True) for k, x in enumerate(known)] + [(100 + k, f"a {x}", False) for k, x in enumerate("abcdefg")]
    got = {r.doc_id: r.score for r in lm_scores(spark.createDataFrame(rows, "doc_id long, text string, learn boolean"), train="learn").collect()}
    assert 0.5 < sum(10 ** (got[100 + k] - got[100]) for k in range(7)) and sum(10 ** got[100 + k] for k in range(7)) < 1
    assert max(range(7), key=lambda k: got[100 + k]) in (1, 2)


def plain_models(texts):
    """p(word | before) of both classes over (toxic, text) rows by the definition, as a function of the class and two words."""
    pairs = [collections.Counter() for _ in range(2)]
    for toxic, t in texts:
        words = alnum_words(t.encode())
        pairs[toxic].update(zip([None, *words], words))
    ends = [collections.Counter(w for _, w in x) for x in pairs]
    stem = lambda w: w[: toxicity.STEM]
    stems = [collections.Counter() for _ in range(2)]
    for k in range(2):
        for w, n in ends[k].items():
            stems[k][stem(w)] += n
    kinds, all_stems, all_words = [len(x) for x in pairs], {*stems[0], *stems[1]}, {*ends[0], *ends[1]}
    d_pair, d_word, d_stem = (max(toxicity.LEAST_DISCOUNT, x * min(kinds) ** 0.5) for x in toxicity.DISCOUNTS)

    def p(k, u, w):
        s, add = stem(w), toxicity.ADDED
        of_stem = stems[0][s] + stems[1][s]
        low = (of_stem + add) / (sum(kinds) + add * (len(all_stems) + 1))
        low = max(stems[k][s] - d_stem, 0) / kinds[k] + sum(min(n, d_stem) for n in stems[k].values()) / kinds[k] * low
        low *= (ends[0][w] + ends[1][w] + add) / (of_stem + add * (sum(stem(x) == s for x in all_words) + 1))
        low = max(ends[k][w] - d_word, 0) / kinds[k] + sum(min(n, d_word) for n in ends[k].values()) / kinds[k] * low
        after = {x: n for (v, x), n in pairs[k].items() if v == u}
        if not after:
            return low
        return (max(after.get(w, 0) - d_pair, 0) + sum(min(n, d_pair) for n in after.values()) * low) / sum(after.values())

    return p, all_words


def test_toxicity_models_by_definition(spark, monkeypatch):
    monkeypatch.setattr("spanweave.llm.toxicity.DISCOUNTS", (0.15, 0.1, 0.25))
    draw = random.Random(5)
    vocabulary = ["".join(draw.choice("ab") for _ in range(draw.randint(2, 7))) for _ in range(40)]
    texts = [(draw.random() < 0.4, " ".join(draw.choice(vocabulary[: draw.randint(1, 40)]) for _ in range(draw.randint(1, 25)))) for _ in range(120)]
    p, known = plain_models(texts)
    rows = spark.createDataFrame([(k % toxicity.FOLDS, *x) for k, x in enumerate(texts)], "fold int, toxic boolean, text string")
    tables = toxicity.tables_of(toxicity.pair_counts(rows))
    model = toxicity.model_of(tables)
    words = toxicity.Words(alnum=True, stem=toxicity.STEM)
    for t in ["a", "zz new", *(" ".join(draw.choices([*vocabulary, "never"], k=12)) for _ in range(30))]:
        w, u, s, n = toxicity.tokens_of([t.encode()], words)
        split = alnum_words(t.encode())
        got = np.log(model.probabilities(w, u, s))
        want = [log(p(1, a, b)) - log(p(0, a, b)) for a, b in zip([None, *split], split)]
        assert np.abs(got[:, 0] - got[:, 1] - want).max() < 1e-9
        passages = [sum(want[i : i + 2]) / 2 for i in range(len(want) - 1)] or want
        assert abs(model.features(w, u, s, n)[0, 0] - max(passages)) < 1e-9
    left = plain_models([x for k, x in enumerate(texts) if k % toxicity.FOLDS != 1])[0]
    w, u, s, n = toxicity.tokens_of([b"aab ba"], words)
    (high, low), = np.log(toxicity.model_of(tables, 1).probabilities(w, u, s))[1:]
    assert abs(high - low - log(left(1, b"aab", b"ba")) + log(left(0, b"aab", b"ba"))) < 1e-9
    # A distribution: the known words, an unknown one for each stem, and unknown stems.
    new = [b"%s?" % x for x in {x[: toxicity.STEM] for x in known} if len(x) == toxicity.STEM]
    assert all(0.5 < sum(p(k, u, w) for w in [*known, *new, b"?"]) <= 1 + 1e-9 for k in (0, 1) for u in (None, vocabulary[0].encode()))


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    scores = QUERIES["op5_toxicity"](spark, folder)
    rows = scores.where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").select("toxic", "score", "predicted").collect()
    right = {k: [r.predicted == k for r in rows if r.toxic == k] for k in (0, 1)}
    assert sum(right[0]) >= 0.9 * len(right[0]) and sum(right[1]) >= 0.7 * len(right[1])
    pairs = [(a.score > b.score) for a in rows if a.toxic for b in rows if not b.toxic]
    assert sum(pairs) > 0.85 * len(pairs)


def test_quality_rejects_junk_and_keeps_prose(spark):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op6_quality_rules"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").groupBy("quality", F.expr("kept or (base_failed and quality = 1)").alias("kept")).count().collect()
    found = {(r.quality, r.kept): r["count"] for r in rows}
    assert found.get((1, False), 0) <= 0.01 * found[1, True] and found.get((0, True), 0) <= 0.05 * found[0, False]


def classes_of(pairs):
    """The least node that each node reaches."""
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def test_components_of_many_edges(spark):
    draw = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 3000)] + [(5000 + i, 5000 + (i + 1) % 2000) for i in range(2000)] + [(10_000, 20_000 + i) for i in range(60_000)]
    edges += [(draw.randrange(100_000, 140_000), draw.randrange(100_000, 140_000)) for _ in range(35_000)]
    draw.shuffle(edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(16)).collect()}
    assert got == classes_of([e for e in edges if e[0] != e[1]])


def test_verdicts_over_generated_links(spark):
    draw = random.Random(4)
    hosts = ["a.org", "b.net", "c.example.net", "d.com", "e.io"]
    urls = [f"http://{draw.choice(hosts)}/{draw.choice(['en', 'fr', 'x'])}/{draw.choice(['', 'y/'])}p{k}" for k in range(240)]
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("org", "/fr/", "allow"), ("d.com", "/x/", "block")]
    pages, links = [], []
    for k, url in enumerate(urls):
        html = ""
        for target in draw.choices([urls[draw.randrange(240)], urls[min(k + 1, 239)], urls[7], f"p{draw.randrange(240)}", f"../x/p{draw.randrange(240)}", f"/fr/p{draw.randrange(240)}"], k=draw.choice([0, 0, 1])):
            html += draw.choice(['<link rel="canonical" href="{}">', "<link href={} rel=canonical>", '<meta http-equiv="refresh" content="0; url={}">']).format(target)
            links.append((url, urljoin(url, target)))
        pages.append((k, draw.choice([url, url + "/", url + "?utm_m=1", url.replace("http:", "https:") + "#f"]), html))
    plain = lambda u: u.split("://")[1].rstrip("/")

    def rule(url):
        host, _, path = plain(url).partition("/")
        fits = [(len(h) + len(p), v) for h, p, v in rules if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        return max(fits)[1] if fits else None

    component = classes_of([(plain(a), plain(b)) for a, b in links] + [(plain(u), plain(u)) for u in urls])
    verdicts = collections.defaultdict(set)
    for u in urls:
        verdicts[component[plain(u)]].add(rule(u))
    want = {}
    for k, u in enumerate(urls):
        met = verdicts[component[plain(u)]]
        want[k] = rule(u) or ("block" if "block" in met and "allow" not in met else "allow")
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_verdicts(table, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert got == want and sum(rule(u) is None and want[k] == "block" for k, u in enumerate(urls)) > 5

"""Nulls, empty and very long texts, repeated rows, empty tables and clashing column names."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from spanweave.llm.bpe import bpe_decode, bpe_encode
from spanweave.llm.chat import adjacent_pairs, other_endings, preference_pairs, tagged_turns
from spanweave.llm.components import connected_components
from spanweave.llm.decontaminate import benchmark_hits, decontaminate, hit_digest
from spanweave.llm.licenses import license_scan
from spanweave.llm.maxent import lm_scores
from spanweave.llm.near import near_dedup, near_groups
from spanweave.llm.quality import quality_filter, quality_verdicts
from spanweave.llm.queries import QUERIES
from spanweave.llm.spans import span_dedup, span_report
from spanweave.llm.toxicity import toxicity_scores
from spanweave.llm.urls import alias_edges, url_verdicts

BPE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def benchmark(spark):
    rows = [("a", "lorem ipsum dolor sit amet lorem ipsum dolor sit"), ("b", "one"), (None, "one"), ("c", None), ("d", "")]
    return spark.createDataFrame(rows, "item_id string, text string")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(4, 1, 1), (6, 1, 0), (6, 1, 0), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")


def by_id(df):
    found = {}
    for r in df.collect():
        found.setdefault(r.doc_id, []).append(r)
    return found


ROWS = {1: 1, 2: 1, 3: 1, 4: 1, 5: 2, None: 2, 6: 1, 7: 1, 8: 1}


def test_hits(odd, benchmark):
    got = by_id(hit_digest(benchmark_hits(odd, benchmark)))
    assert {k: len(v) for k, v in got.items()} == ROWS
    assert (got[1][0].n_words, got[1][0].n_hit, got[1][0].n_items) == (0, 0, 0)
    assert (got[6][0].n_hit, got[6][0].n_items, got[6][0].contaminated) == (1, 1, False)
    assert (got[4][0].n_hit, got[4][0].n_words) == (14999, 15000)
    assert by_id(hit_digest(benchmark_hits(odd, benchmark, block_bytes=40))) == got
    assert by_id(hit_digest(benchmark_hits(odd, benchmark, block_windows=2))) == got


def test_a_block_of_windows_is_small(spark):
    import pickle

    from spanweave.llm.decontaminate import BLOCK_WINDOWS, Grams, blocks_of

    text = " ".join(str(i % 9973) for i in range(100_000)).encode()
    grams = Grams([(str(k), text) for k in range(3)], 8)
    windows = sum(len(x[2]) for x in grams.by_length.values())
    assert windows == 3 * 9973 and len(pickle.dumps(grams)) < 40 * windows + len(grams.text) + 1000
    rows = spark.createDataFrame([(str(k), "a b c " * 50) for k in range(30)], "item_id string, text string")
    blocks = blocks_of(rows, "item_id", "text", 1 << 20, 1000)
    assert len(blocks) == 5 and sum(b.count() for b in blocks) == 30 and len(blocks_of(rows, "item_id", "text", 1 << 20, BLOCK_WINDOWS)) == 1


def test_decontaminate(odd, benchmark):
    got = decontaminate(odd, benchmark)
    assert got.columns == odd.columns
    texts = {k: v[0].text for k, v in by_id(got).items()}
    assert texts[6] == "" and texts[1] is None and texts[7].startswith("ÉÀ漢字")
    assert "Lorem" not in texts[4]
    assert decontaminate(odd, benchmark.where("false")).exceptAll(odd).isEmpty()


def test_chat(spark):
    rows = [(1, 0, "user", "q"), (1, 0, "user", "q"), (1, 1, "assistant", "yes"), (2, 0, "user", "q"), (2, 1, "assistant", None), (3, None, None, None), (None, 0, "user", "q"), (4, 0, "user", "q"), (4, 1, "assistant", "yes")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("prompt", F.lit("clash"))
    pairs = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (1, 4), (1, 9), (None, 1)], "chosen_id long, rejected_id long")
    got = {r.rejected_id: r for r in preference_pairs(turns, pairs).collect()}
    assert sorted(got) == [2, 3, 4]
    assert got[2].prompt == "<|im_start|>user\nq<|im_end|>\n" and got[2].n_prompt_turns == 1
    x = got[2].chosen_spans[0]
    assert got[2].chosen[x.start : x.stop] == "yes" and got[2].usable
    assert got[3].n_prompt_turns == 0 and got[3].rejected == "<|im_start|>\n<|im_end|>\n" and not got[3].usable
    assert got[4].n_prompt_turns == 2 and got[4].chosen == got[4].rejected == ""
    assert preference_pairs(turns.where("false"), pairs).isEmpty()


def test_licenses(spark, odd):
    got = by_id(license_scan(odd))
    assert {k: len(v) for k, v in got.items()} == ROWS
    assert tuple(got[1][0])[1:] == (0, 0, None, None, "", "", 0.0)
    docs = spark.createDataFrame([(1, "x MIT License, mit license!\nsee cc by"), (2, "released under the\nMIT license"), (3, "Released (under) THE mit-LICENSE")], "doc_id long, text string")
    got = by_id(license_scan(docs))
    assert tuple(got[1][0])[1:6] == (8, 3, 1, 6, "cc-by,mit")
    assert got[2][0].labels == got[3][0].labels == "mit,mit-notice"
    assert license_scan(docs.where("false")).isEmpty()


def test_urls(spark, monkeypatch):
    pages = [
        (1, "http://A.com/x/", '<LINK href="https://b.org/y" rel=canonical>'),
        (2, "https://b.org/y#f", ""),
        (3, "http://c.net/z", '<meta http-equiv="refresh" content="0; url=//b.org/y">'),
        (4, None, None),
        (5, "zzz", "x"),
        (6, "http://d.example.net/en/q", '<link rel="canonical" href="http://c.net/z">'),
        (8, "http://q.io/fr/a", "<link rel=canonical href=http://c.net/zz>"),
        (9, "http://c.net/zz", ""),
        (9, "http://c.net/zz", ""),
        (10, "://", ""),
    ]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("verdict", F.lit("clash"))
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow")], "host string, path string, verdict string")
    got = sorted(tuple(r)[0:1] + tuple(r)[3:] for r in url_verdicts(table, rules).collect())
    # 6 is allowed by a rule, so nothing spreads in its component; 8 is an alias of a blocked page.
    assert got == [(1, None, "allow"), (2, None, "allow"), (3, "net/", "block"), (4, None, "allow"), (5, None, "allow"), (6, "example.net/en/", "allow"), (8, None, "block"), (9, "net/", "block"), (9, "net/", "block"), (10, None, "allow")]
    monkeypatch.setattr("spanweave.llm.urls.INLINE_RULES", 0)
    assert sorted(tuple(r)[0:1] + tuple(r)[3:] for r in url_verdicts(table, rules).collect()) == got
    assert url_verdicts(table.where("false"), rules).isEmpty()


def test_toxicity(odd, labels):
    got = by_id(toxicity_scores(odd, labels))
    assert {k: len(v) for k, v in got.items()} == ROWS
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for v in got.values() for r in v)
    for some in (labels.where("false"), labels.where("toxic = 1")):
        assert toxicity_scores(odd, some).count() == 11
    assert toxicity_scores(odd.where("false"), labels).isEmpty()


def test_quality(odd):
    got = by_id(quality_verdicts(odd))
    assert {k: len(v) for k, v in got.items()} == ROWS
    assert got[1][0].base_failed and not got[1][0].kept and got[4][0].n_repeat_words == 15000
    assert quality_filter(odd).columns == odd.columns
    assert quality_filter(odd).isEmpty() and quality_filter(odd.where("false")).isEmpty()
    prose = odd.sparkSession.createDataFrame([(i, " ".join(f"w{i * 7 + j}" for j in range(30))) for i in range(5)], "doc_id long, text string")
    assert quality_filter(prose).columns == prose.columns and quality_filter(prose).count() == 5
    assert quality_verdicts(prose.withColumn("lang", F.lit(3))).where("kept").count() == 5


def test_fences_of_small_groups_and_large_shares(spark):
    """A small group is judged mostly by its language, with its own share in it; values of any size keep their order."""
    usual = [(i, "en", "a", " ".join(f"w{i}x{j}" for j in range(40)) + " #" * (i % 3)) for i in range(400)]
    few = [(1000 + i, "en", "b", " ".join(f"v{i}x{j}" for j in range(40)) + "".join(" " + "#" * (5 + j) for j in range(5))) for i in range(3)]
    odd_ones = [(2000, "en", "a", " ".join(f"u{j}" for j in range(40)) + " " + "#" * 9000), (2001, "zz", None, " ".join("\u3042" * 200 + str(j) for j in range(12)))]
    docs = spark.createDataFrame(usual + few + odd_ones, "doc_id long, lang string, source string, text string")
    got = {r.doc_id: r for r in quality_verdicts(docs).collect()}
    assert got[2000].symbol_share == 1000 * 9000 // 41 and got[2001].word_length > 20_000
    kept = {i for i, r in got.items() if r.kept}
    # The mean of 12 words counts for 12/62 of its distance, which is still far out.
    assert kept == set(range(400)) and not any(got[i].base_failed for i in (1000, 2000, 2001))
    many = spark.createDataFrame([(i, "en", "b", t) for i, (_, _, _, t) in enumerate(few * 400)], docs.schema)
    assert quality_filter(many.unionByName(docs)).where("source = 'b'").count() == 1203


def test_spans(odd):
    got = by_id(span_report(odd))
    assert {k: len(v) for k, v in got.items()} == ROWS
    assert got[1][0].text is None and got[1][0].n_sentences == 0 and got[2][0].text == ""
    assert 0 < len(got[4][0].text) < 300 and got[5][0].text == got[5][1].text == ""
    assert got[None][0].n_removed == 0 and got[6][0].text == "one"
    kept = span_dedup(odd)
    assert kept.columns == odd.columns and sorted(by_id(kept), key=str) == [1, 2, 3, 4, 6, 7, 8, None]
    assert span_dedup(odd.where("false")).isEmpty()


def test_near(odd):
    got = by_id(near_groups(odd))
    assert {k: len(v) for k, v in got.items()} == ROWS
    assert [got[k][0].component_id for k in (1, 2, 3, 4, 5, 6, 7, 8, None)] == [1, 2, 3, 4, 4, 6, 7, 6, None]
    assert [r.kept for r in got[5]] == [False, False] and got[None][0].kept and got[2][0].n_shingles == 0
    kept = near_dedup(odd)
    assert kept.columns == odd.columns and sorted(by_id(kept), key=str) == [1, 2, 3, 4, 6, 7, None]
    assert near_groups(odd.where("false")).isEmpty()


def test_rows_of_one_id_are_one_document(spark):
    words = "a b c d e f g h"
    docs = spark.createDataFrame([(1, words), (2, words + " x"), (2, "z"), (3, "z"), (4, "w")], "doc_id long, text string")
    assert {k: {r.component_id for r in v} for k, v in by_id(near_groups(docs)).items()} == {1: {1}, 2: {1}, 3: {1}, 4: {4}}


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (100, 200), (7, 7), (None, 1), (300, 299)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100, 300: 299, 299: 299}
    assert connected_components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_bpe(odd):
    got = by_id(bpe_encode(odd, BPE))
    assert {k: len(v) for k, v in got.items()} == ROWS
    assert (got[1][0].n_tokens, got[1][0].ids, got[1][0].decoded) == (0, [], "")
    assert bpe_encode(odd.where("false"), BPE).isEmpty()
    decoded = by_id(bpe_decode(bpe_encode(odd, BPE).select("doc_id", "ids"), BPE))
    assert decoded[7][0].decoded == got[7][0].decoded and decoded[1][0].decoded == ""


def test_scores(odd):
    got = by_id(lm_scores(odd))
    assert {k: len(v) for k, v in got.items()} == ROWS
    assert got[1][0].n_tokens == 1 and got[4][0].n_tokens == 15001
    assert all(r.score < 0 and r.n_known <= r.n_tokens for v in got.values() for r in v)
    assert lm_scores(odd, train="false").agg(F.max("n_known")).first()[0] == 0
    assert lm_scores(odd.where("false")).isEmpty()


def test_rarer_words_are_scored_by_context(spark):
    common = [" ".join(f"w{i}" for i in range(1100))] * 6
    pairs = [f"a{i} b{i}" for i in range(40)] * 3
    held = ["a7 b7", "a7 b8", "z b7"]
    rows = [(i, t, i < 1000) for i, t in enumerate(common + pairs)] + [(1000 + i, t, False) for i, t in enumerate(held)]
    got = {r.doc_id: r for r in lm_scores(spark.createDataFrame(rows, "doc_id long, text string, learn boolean"), train="learn").collect()}
    met, other, new = (got[1000 + i] for i in range(3))
    assert met.base_score == other.base_score and met.score > other.score + 2
    assert (met.n_known, other.n_known, new.n_known) == (3, 3, 2) and all(r.score < 0 for r in got.values())


def test_licenses_over_wrapped_lines(spark):
    notices = [
        "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files",
        " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that",
        "# This program is free software: you can redistribute it\n# and/or modify it under the terms of the GNU\n# General Public License as published",
        "Permission is hereby granted, free of charge, to any person obtaining a copy\n\nof this software",
        "Permission is hereby granted, free of charge,\nno\nto any person obtaining a copy of this software",
        "Permission is hereby\ngranted, free of\ncharge, to any\nperson obtaining a\ncopy of this\nsoftware",
        "\n".join("permission is hereby granted free of charge to any person obtaining a copy of this software".split()),
    ]
    got = by_id(license_scan(spark.createDataFrame(list(enumerate(notices)), "doc_id long, text string")))
    assert [got[i][0].labels for i in range(7)] == ["mit-notice", "bsd", "gpl,gpl-notice", "", "mit-notice", "mit-notice", "mit-notice"]
    assert got[0][0].score == got[1][0].score == got[5][0].score == 1.0


def test_places_of_many_phrases(spark):
    texts = [" mit license" * 20_000, "mit mit license license cc by by", "cc\nby"]
    got = by_id(license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [(got[i][0].n_base, got[i][0].first_word, got[i][0].last_word) for i in range(3)] == [(20_000, 0, 39_998), (2, 1, 4), (1, 0, 0)]


def test_aliases_of_all_forms(spark):
    html = """<link rel=canonical href='next.html'><link href="?p=2" rel="canonical"><link rel="canonical" href="../up/./x">
    <meta content="0; url=/top" http-equiv=refresh><meta http-equiv="refresh" content="1;URL=deep/er?u=http://z.org/"><link rel="canonical" href="mailto:a@b">"""
    pages = [(1, "http://h.com/a/b/c", html), (2, "http://h.com", '<link rel="canonical" href="in">'), (3, "zzz", html), (4, "http://h.com/q", None)]
    got = sorted(map(tuple, alias_edges(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()))
    to = ["h.com/a/b/c?p=2", "h.com/a/b/deep/er?u=http://z.org/", "h.com/a/b/next.html", "h.com/a/up/x", "h.com/top"]
    assert got == [("h.com", "h.com/in"), *(("h.com/a/b/c", x) for x in to)]


def test_adjacent_conversations_with_a_prompt_of_several_turns(spark):
    shared = [("system", "s"), ("user", "q"), ("assistant", "a"), ("user", "more")]
    talks = {2: [*shared, ("assistant", "yes")], 3: [*shared, ("assistant", "no")], 5: shared, 6: shared}
    turns = spark.createDataFrame([(c, i, *t) for c, x in talks.items() for i, t in enumerate(x)], "conv_id long, turn int, role string, text string")
    (got,) = preference_pairs(tagged_turns(turns), adjacent_pairs(turns)).collect()
    assert (tuple(got.chosen_id), tuple(got.rejected_id), got.n_prompt_turns, got.usable) == ((2, False), (3, False), 4, True)
    assert got.prompt == "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in shared)
    assert (got.chosen, got.rejected) == tuple(f"<|im_start|>assistant\n{x}<|im_end|>\n" for x in ("yes", "no"))


def test_tracking_parameters_anywhere(spark):
    from spanweave.llm.urls import node_of

    urls = {"http://H/p?utm_source=x&a=1": "h/p?a=1", "http://h/p/?a=1&utm_x=2": "h/p?a=1", "https://h/p?a=1&utm_x&b=2#f": "h/p?a=1&b=2", "http://h/?utm_x": "h", "http://h/p?&a=1&": "h/p?a=1", "h/p?a": None}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.n for r in df.select("u", node_of(F.col("u")).alias("n")).collect()} == urls


def test_other_endings(spark):
    talks = {0: [("user", "q"), ("assistant", "a"), ("user", "r"), ("assistant", "b"), ("user", "bye")], 1: [("user", "s"), ("assistant", "c")], 2: [("user", "no answer")], 4: [("assistant", "alone")], 5: [("assistant", None)]}
    turns = spark.createDataFrame([(c, i, *t) for c, x in talks.items() for i, t in enumerate(x)] + [(None, 0, "assistant", "x")], "conv_id long, turn int, role string, text string")
    made, pairs = other_endings(turns)
    got = {r.chosen_id.id: r for r in preference_pairs(tagged_turns(turns).unionByName(made), pairs).collect()}
    assert {k: (tuple(r.rejected_id), r.n_prompt_turns, r.usable) for k, r in got.items()} == {0: ((0, True), 3, True), 4: ((4, True), 0, True)}
    assert got[0].rejected == "<|im_start|>assistant\nc<|im_end|>\n" and got[0].chosen.endswith("user\nbye<|im_end|>\n")
    assert got[4].rejected == "<|im_start|>assistant\n<|im_end|>\n"
    assert preference_pairs(*other_endings(turns.where("false"))).isEmpty()


def test_other_endings_beside_ids_below_zero(spark, tmp_path):
    """Conversations 4, 5 and -5: what is made from 4 has an id that none of them has."""
    talks = {4: [("user", "q"), ("assistant", "a")], 5: [("user", "s"), ("assistant", "b")], -5: [("user", "far"), ("assistant", "off")]}
    turns = spark.createDataFrame([(c, i, *t) for c, x in talks.items() for i, t in enumerate(x)], "conv_id long, turn int, role string, text string")
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.chosen_id, r.rejected_id, r.made): r for r in QUERIES["op2_chat_formatting"](spark, str(tmp_path)).collect()}
    assert got.keys() == {(4, 5, False), (4, 4, True)}
    assert got[4, 4, True].prompt == "<|im_start|>user\nq<|im_end|>\n" and got[4, 4, True].rejected == "<|im_start|>assistant\nb<|im_end|>\n"


def test_a_conversation_of_very_many_turns(spark):
    """Spans of 40,000 turns are found in linear time."""
    turns = spark.range(80_000).select((F.col("id") % 2).alias("conv_id"), F.expr("id div 2").alias("turn"), F.when(F.expr("id div 2 % 2 = 1"), "assistant").otherwise("user").alias("role"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    (got,) = preference_pairs(turns, spark.createDataFrame([(0, 1)], "chosen_id long, rejected_id long")).collect()
    assert got.n_prompt_turns == 0 and len(got.chosen_spans) == len(got.rejected_spans) == 20_000
    for x in (got.chosen_spans[0], got.chosen_spans[-1]):
        assert got.chosen[x.start : x.stop].startswith("text ") and got.chosen[: x.start].endswith("assistant\n")


@pytest.mark.parametrize("kind", ["date", "decimal(12,0)", "string"])
def test_near_groups_by_other_ids(spark, kind):
    words = [f"w{i}" for i in range(60)]
    docs = [" ".join(words), " ".join([*words, "x"]), "other words altogether here now", " ".join(["y", *words[2:]])]
    ids = spark.createDataFrame([(20200101 + i, t) for i, t in enumerate(docs)], "i long, text string").select(F.expr("to_date(cast(i as string), 'yyyyMMdd')" if kind == "date" else f"cast(i as {kind})").alias("doc_id"), "text")
    rows = sorted(near_groups(ids).collect(), key=lambda r: str(r.doc_id))
    first = rows[0].doc_id
    assert [r.component_id == first for r in rows] == [True, True, False, True] and [r.kept for r in rows] == [True, False, True, False]

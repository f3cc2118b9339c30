"""The pipeline's stages, each on what the one before kept."""

import re

import corpus_pipeline
import duckdb
import numpy as np
from spanweave.llm.oracles import ORACLES
from spanweave.llm.staging import staged
from spanweave.llm.text import alnum_words
from test_brute import library, span_cuts


def test_stages(spark, folder, documents):
    docs, kept = documents, [documents.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = staged(stage(spark, docs, folder))
        kept.append(docs.count())
        if i < 4:
            assert docs.columns == documents.columns
    assert kept[0] > kept[1] > kept[2] >= kept[3] >= kept[4] == kept[5] > 0
    assert corpus_pipeline.run(spark, folder).count() == kept[5]
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert not [r.doc_id for r in docs.select("doc_id").collect() if quality.get(r.doc_id) == 0]


def test_run_against_plain_versions(spark, folder):
    """Quality and near-duplicates by their SQL, sentence spans and benchmark windows by plain loops, tokens by the library."""
    con = duckdb.connect()
    con.execute(f"create table documents as select * from '{folder}/documents.parquet'")
    kept = [r[0] for r in con.execute(f"select doc_id from ({ORACLES['op6_quality_rules']}) where kept").fetchall()]
    con.execute("delete from documents where doc_id not in (select unnest(?))", [kept])
    firsts = {r[0] for r in con.execute(f"select doc_id from ({ORACLES['op8_near_dedup']}) where kept").fetchall()}
    rows = sorted((i, t) for i, t in con.execute("select doc_id, text from documents").fetchall() if i in firsts)
    split, cut = span_cuts(rows)
    texts = {i: "".join(x for k, x in enumerate(split[i]) if k not in cut[i]) for i, _ in rows}
    texts = {i: t for i, t in texts.items() if t.strip(" \n\r\t\v\f") or not cut[i]}
    grams = {}
    for item, text in con.execute(f"select item_id, text from '{folder}/benchmark.parquet'").fetchall():
        words = alnum_words(text.encode())
        for k in range(max(len(words) - 7, 1) if words else 0):
            grams.setdefault(tuple(words[k : k + 8]), set()).add(item)
    clean = {}
    for i, t in texts.items():
        raw, words = t.encode(), alnum_words(t.encode())
        places = [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw)]
        hit, items = set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(words) - n + 1):
                if found := grams.get(tuple(words[k : k + n])):
                    items |= found
                    hit.update(range(k, k + n))
        if len(items) < 2:
            for a in sorted((k for k in hit if k - 1 not in hit), reverse=True):
                b = next(k for k in range(a, len(words) + 1) if k not in hit)
                raw = raw[: places[a][0]] + raw[places[b - 1][1] :]
            clean[i] = raw.decode()
    want = {i: (t, ids, shown) for (i, t), (ids, shown) in zip(clean.items(), library(list(clean.values())), strict=True)}
    got = {r.doc_id: (r.text, np.array(r.ids, "<u4").tobytes(), r.decoded) for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == want and any(cut.values()) and any(clean[i] != texts[i] for i in clean)

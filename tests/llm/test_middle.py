"""Fill-in-middle against the units' patterns."""

import random
import re
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from helpers import rows_of
from spanweave.llm.middle import Runs, fill_in_middle, middle_digest, restored_text

UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+", "char": r"(?s)."}


@pytest.mark.parametrize("unit", sorted(UNITS))
def test_cuts_are_those_of_the_units(unit):
    draw = random.Random(3)
    texts = ["", "\n", "\n\n\n", "a", "a\n", "\na", " ", "é漢\U0001f600x", *("".join(draw.choices("aé漢\U0001f600 \n\t", k=draw.randint(1, 40))) for _ in range(300))]
    for text in texts:
        units = re.findall(UNITS[unit], text)
        runs = Runs(text.encode(), unit)
        assert len(runs) == len(units)
        assert [runs.byte(n) for n in range(len(units) + 1)] == [len("".join(units[:n]).encode()) for n in range(len(units) + 1)]


def plain(doc_id, text, unit="line", rate=100, spm=50):
    text = text or ""
    units = re.findall(UNITS[unit], text)
    n = len(units)
    h = sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    one, two, drawn, order = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or drawn % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((one % (n + 1), two % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if order % 100 < spm else (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("unit", sorted(UNITS))
def test_examples(documents, texts, unit):
    got = fill_in_middle(documents, unit, rate=70, spm=30)
    assert rows_of(got, "doc_id", "n", "form", "prefix_chars", "middle_chars", "output") == sorted((plain(i, t, unit, 70, 30) for i, t in texts), key=repr)
    back = got.select("doc_id", restored_text().alias("text"))
    assert rows_of(back, "doc_id", "text") == sorted(((i, t or "") for i, t in texts), key=repr)


def test_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = fill_in_middle(odd)
    assert rows_of(got, "doc_id", "n", "form", "prefix_chars", "middle_chars", "output") == sorted((plain(*r) for r in rows), key=repr)
    assert rows_of(middle_digest(got), "restored_sha256") == sorted((sha256((t or "").encode()).hexdigest(),) for _, t in rows)
    assert fill_in_middle(odd.where("false")).count() == 0
    with pytest.raises(ValueError):
        fill_in_middle(odd, "page")


def test_marks_and_borders(spark):
    """Texts with marks stay plain; borders that look like parts of marks are restored."""
    texts = ["<P>\n", "a<S>b\nc\n", "x<M>", "<\n<S\n>\nP>\n<P\n", "<<\n>>\nS>\n<S\n<M\n", "<P\n>"]
    df = spark.createDataFrame([(i, t) for i in range(40) for t in texts], "doc_id long, text string")
    made = fill_in_middle(df).select("doc_id", "form", "output", restored_text().alias("text"))
    assert rows_of(made.select("doc_id", "text")) == rows_of(df)
    assert {r.form for r in made.where(F.col("text").isin(texts[:3])).collect()} == {"plain"}
    assert {r.form for r in made.where(~F.col("text").isin(texts[:3])).collect()} == {"psm", "spm"}


def test_a_very_long_text(spark):
    text = "one line\n\n" * 300_000 + "end"
    df = spark.createDataFrame([(9, text)], "doc_id long, text string")
    assert rows_of(fill_in_middle(df).select("n", restored_text().alias("text"))) == [(600_001, text)]

"""Quality rules with adaptive thresholds.

Each document's shares (symbols, repeated lines, repeated words, word length)
are whole numbers; a quantile sketch of a share is the number of documents at
each value, of which the leading ``BITS`` bits are kept.  So its quantiles are
exact below 2**BITS, and low by less than one part in 2**(BITS - 1) above, however large a
value is; a sketch has at most 2**BITS cells and half as many for each further bit, and
sketches merge by addition.  They are built per language and source and merged per language
and over all documents.  A group's quartiles are drawn towards those of its language, and these towards
those of all, as if ``PRIOR`` documents more were like the larger group: the fewer a group's own, the
more it takes from there.  Every share has an upper fence: the third quartile
and ``SPREAD`` times the distance between the quartiles, at least a floor.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .staging import staged
from .text import WordHash, arrow_map, as_bytes, carried, restored, windows, with_columns

#: Symbols that prose has few of.
SYMBOLS = b"#*$%&|<>"
#: Fixed rules: fewer words than this fail, and so does a larger percentage of words in repeated 5-word windows.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Shares and the least distance, in their units, that counts as the spread of a group.
FLOORS = {"symbol_share": 100, "dup_line_share": 150, "repeat_share": 100, "word_length": 60}
#: Leading bits of a value that a sketch keeps, spread of the fence, and documents that the larger group counts for beside a group's own.
BITS, SPREAD, PRIOR = 12, 3, 100
#: Words of a text at which half of the distance from the quartile counts: the mean of a few words says less than that of many.
NOISE = {"word_length": 50}
#: Rows of thresholds up to which they are broadcast.
BROADCAST_ROWS = 100_000


def metrics_of(raw: bytes | None, cache: WordHash) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of a text."""
    if not raw:
        return 0, 0, 0, 0, 0, 0
    words = raw.split()
    joined = np.frombuffer(b"".join(words), np.uint8)
    lines = [x for x in raw.split(b"\n") if x.split()]
    grams = windows(cache.array(words), WINDOW)
    repeated = 0
    if len(grams):
        _, place, count = np.unique(grams, return_inverse=True, return_counts=True)
        at = np.flatnonzero(count[place] > 1)
        if len(at):
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + WINDOW, -1)
            repeated = int((np.cumsum(edge[:-1]) > 0).sum())
    chars = int(((joined & 0xC0) != 0x80).sum())
    return len(words), chars, sum(map(raw.count, (bytes([c]) for c in SYMBOLS))), len(lines), len(lines) - len(set(lines)), repeated


def quality_metrics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The columns ``keep`` with the counts of ``metrics_of`` for each whole text; null and empty texts have zeros.

    Words are compared by 64-bit hash within one text.  A map over partitions without a shuffle.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    kept = docs.select(*keep).schema

    def start():
        cache = WordHash()

        def step(batch):
            rows = np.array([metrics_of(x, cache) for x in as_bytes(batch.column(len(keep)))], np.int64).reshape(-1, len(names))
            return {f.name: batch.column(i) for i, f in enumerate(kept)} | {n: rows[:, i] for i, n in enumerate(names)}

        return step

    return arrow_map(docs.select(*keep, F.col(text).alias("__text")), start, with_columns(kept, **dict.fromkeys(names, "long")))


def shares(metrics: DataFrame) -> DataFrame:
    """``metrics`` with its shares: symbols and repeated words per 1000 words, repeated lines per 1000 lines, characters per 100 words."""
    per = lambda a, b, unit: F.when(F.col(b) > 0, F.expr(f"{unit} * {a} div {b}")).otherwise(0)
    return metrics.withColumns(
        {
            "symbol_share": per("n_symbols", "n_words", 1000),
            "dup_line_share": per("n_dup_lines", "n_lines", 1000),
            "repeat_share": per("n_repeat_words", "n_words", 1000),
            "word_length": per("word_chars", "n_words", 100),
            "base_failed": F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"),
        }
    )


def sketches(measured: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """One row for each group, share and cell: the number of documents, combined before the shuffle."""
    pairs = F.array(*[F.struct(F.lit(k).alias("share"), F.col(k).alias("value")) for k in FLOORS])
    spare = f"greatest(length(bin(value)) - {BITS}, 0)"
    cells = measured.where("not base_failed").select(*by, F.inline(pairs)).withColumn("value", F.expr(f"shiftleft(shiftright(value, {spare}), {spare})"))
    return cells.groupBy(*by, "share", "value").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, by: list[str], suffix: str) -> DataFrame:
    """Per group: the number of documents, and each share's quartiles, from a sketch of any merged level."""
    merged = sketch.groupBy(*by, "share", "value").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by, "share")
    run = merged.withColumns({"upto": F.sum("n").over(w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(w)})
    reached = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("value")))
    found = run.groupBy(*by, "share").agg(reached(1).alias("q1"), reached(3).alias("q3"), F.max("total").alias("docs"))
    each = [F.max(F.when(F.col("share") == k, F.col(q))).alias(f"{k}_{q}{suffix}") for k in FLOORS for q in ("q1", "q3")]
    return found.groupBy(*by).agg(F.max("docs").alias(f"docs{suffix}"), *each)


def thresholds(measured: DataFrame) -> DataFrame:
    """Per language and source (null counts as the empty name): the third quartile and the fence of each share."""
    sketch = staged(sketches(grouped(measured), ("__lang", "__source"))).withColumn("__all", F.lit(0))
    own, lang, all_ = (quartiles(sketch, by, s) for by, s in ((["__lang", "__source"], "_own"), (["__lang"], "_lang"), (["__all"], "_all")))
    joined = own.join(lang, "__lang").crossJoin(F.broadcast(all_.drop("__all")))  # one row
    for level, parent in (("_lang", "_all"), ("_own", "_lang")):
        joined = joined.withColumns({f"{k}_{q}{level}": F.expr(f"(docs{level} * {k}_{q}{level} + {PRIOR} * {k}_{q}{parent}) div (docs{level} + {PRIOR})") for k in FLOORS for q in ("q1", "q3")})
    limits = [x for k, v in FLOORS.items() for x in (F.col(f"{k}_q3_own").alias(f"{k}_q3"), F.expr(f"{k}_q3_own + {SPREAD} * greatest({k}_q3_own - {k}_q1_own, {v})").alias(f"{k}_fence"))]
    return staged(joined.select("__lang", "__source", *limits))


def grouped(measured: DataFrame) -> DataFrame:
    return measured.withColumns({f"__{c}": F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "source")})


def judged(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """``measured`` joined with its group's fences: ``kept`` is false for base failures and for shares beyond a fence."""
    limits = F.broadcast(limits) if limits.count() <= BROADCAST_ROWS else limits
    named = grouped(measured)
    beyond = F.lit(False)
    for k in FLOORS:
        beyond = beyond | F.expr(f"coalesce(({k} - {k}_q3) * n_words > ({k}_fence - {k}_q3) * (n_words + {NOISE.get(k, 0)}), false)")
    return named.join(limits, ["__lang", "__source"], "left").withColumn("kept", ~(F.col("base_failed") | beyond)).drop("__lang", "__source")


def quality_verdicts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per document: its counts, shares, ``base_failed`` and ``kept``.

    Null and empty texts have no words and fail.  A null ``lang`` or ``source`` is the empty name, and so is a column that
    ``docs`` doesn't have.  Repeated rows, and rows of one id, are each a document, with equal verdicts where text, language and source are equal; a share at the fence
    is kept.  The counts are written once to the shared folder; the sketches and the verdicts read them there.
    """
    known = {c.lower() for c in docs.columns}
    named = docs.withColumns({c: F.lit(None).cast("string") for c in ("lang", "source") if c not in known})
    measured = shares(staged(quality_metrics(named, text)))
    return judged(measured, thresholds(measured))


def quality_filter(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they are; odd rows as in ``quality_verdicts``.

    Each text is measured once: rows and counts are written to the shared folder, and the sketches read only
    the counts there.  No text is shuffled.
    """
    held, own = carried(docs)
    named = held.withColumns({c: F.col(own[c]) if c in own else F.lit(None).cast("string") for c in ("lang", "source")})
    measured = shares(staged(quality_metrics(named, own[text], (*held.columns, "lang", "source"))))
    return restored(judged(measured, thresholds(measured)).where("kept"), docs)

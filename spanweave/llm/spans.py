"""Substring deduplication by sliding sentence spans.

Every run of ``SEVERAL`` or more consecutive sentences counts, however short.  Such a run is a union of
runs of just as many, and where it is repeated they are, too: so these are what is hashed
and joined globally, and they cover what all runs would.  Two sentences of ``PAIR_WORDS`` together and one of ``LONE_WORDS`` count
beside them, for a repeated passage of few sentences, or whose other sentences run on into the text around it.  Shorter
pairs are phrases that many unrelated documents share, and stay.  Sentences
covered by an occurrence other than the first, in the order of document id and
place, are removed.

Spans are compared by 96 bits of hash: among 10**12 different spans the chance that any two
are taken for one is below 1e-5.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontaminate import word_bounds
from .staging import broadcast_if_small, staged
from .text import STEP, WordHash, alnum_words, arrow_map, as_bytes, carried, mixed, restored, with_columns

#: Sentences of a run that counts whatever its length, and the words from which two and one do.
SEVERAL, PAIR_WORDS, LONE_WORDS = 3, 16, 25
#: A word of more bytes than this (writing without spaces) counts once for every half of it.
LONG_WORD = 24
#: A sentence ends after stops before white space (those of Arabic, Urdu and Hindi, too), after full-width stops, and after a line break.
SENTENCE_END = re.compile(rb"(?:[.!?]|\xd8\x9f|\xdb\x94|\xe0\xa5\xa4)+(?=\s)[ \t]*\n?|(?:\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f)+[ \t]*\n?|\n")
#: Full-width stops, which end a sentence but not a word.
FULL_STOPS = re.compile(rb"((?:\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f)+)")
#: A second odd multiplier, and the inverses of both modulo 2**64.
STEP_2 = np.uint64(0xD6E8FEB86659FD93)
INVERSE, INVERSE_2 = (np.uint64(pow(int(x), -1, 1 << 64)) for x in (STEP, STEP_2))


def sentence_ends(raw: bytes) -> np.ndarray:
    """Byte offsets after which the sentences of a text end, the text's length last."""
    ends = [m.end() for m in SENTENCE_END.finditer(raw)]
    if not ends or ends[-1] < len(raw):
        ends.append(len(raw))
    return np.array(ends, np.int64)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def runs(ends: np.ndarray) -> np.ndarray:
    """(first, past last) sentence of each span, in their order, from the number of words up to each sentence's end."""
    n = len(ends)
    upto = np.concatenate(([0], ends))
    some = [np.arange(max(n - SEVERAL + 1, 0)), np.flatnonzero(upto[2:] - upto[:-2] >= PAIR_WORDS), np.flatnonzero(np.diff(upto) >= LONE_WORDS)]
    first = np.concatenate(some)
    stop = first + np.repeat((SEVERAL, 2, 1), [len(x) for x in some])
    order = np.lexsort((stop, first))
    return np.stack((first[order], stop[order]), 1)


def spans_of(raw: bytes, cache: WordHash, power: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64 and 32 bits of the hash of each span's words, and its sentences."""
    # A space after them, which the sentence takes, keeps words within sentences.
    if b"\xe3\x80\x82" in raw or b"\xef\xbc" in raw:
        raw = FULL_STOPS.sub(rb"\1 ", raw)
    words = alnum_words(raw)
    starts, stops = word_bounds(raw)
    upto = np.searchsorted(starts, sentence_ends(raw), "left")
    # Sentences without words begin and end no run.
    spoken = np.flatnonzero(np.diff(upto, prepend=0))
    upto = upto[spoken]
    length = stops - starts
    counted = np.concatenate(([0], np.cumsum(np.where(length > LONG_WORD, length * 2 // LONG_WORD, 1))))
    pairs = runs(counted[upto])
    if not len(pairs):
        return np.zeros(0, np.int64), np.zeros(0, np.int32), pairs
    hashes = cache.array(words)
    n = len(words)
    up, up2, down, down2 = (p[: n + 1] for p in power)
    c = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up[:n], dtype=np.uint64)))
    c2 = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(hashes) * up2[:n], dtype=np.uint64)))
    at = np.concatenate(([0], upto))
    a, b = at[pairs[:, 0]], at[pairs[:, 1]]
    one = mixed((c[b] - c[a]) * down[a] + (b - a).astype(np.uint64))
    two = mixed((c2[b] - c2[a]) * down2[a])
    pairs = np.stack((spoken[pairs[:, 0]], spoken[pairs[:, 1] - 1] + 1), 1)
    return one.view(np.int64), (two >> np.uint64(32)).astype(np.uint32).view(np.int32), pairs


def row_key(text: str) -> Column:
    """Tells rows of one id and different texts apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def span_table(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``hash``, ``check``, ``doc_id``, ``row`` (``row_key``), ``start`` and ``stop`` (sentences) of every span of rows with an id, and whether the row has it before (``again``)."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def start():
        cache = WordHash()
        power = [powers(x, 1 << 12) for x in (STEP, STEP_2, INVERSE, INVERSE_2)]

        def step(batch):
            nonlocal power
            got = []
            for raw in as_bytes(batch.column(2)):
                if raw and len(raw) // 2 + 2 > len(power[0]):
                    power = [powers(x, len(raw)) for x in (STEP, STEP_2, INVERSE, INVERSE_2)]
                got.append(spans_of(raw or b"", cache, power))
            rows = pa.array(np.repeat(np.arange(len(got)), [len(x[0]) for x in got]))
            pairs = np.concatenate([x[2] for x in got])
            again = np.concatenate([repeats(x[0]) for x in got])
            return {
                "hash": np.concatenate([x[0] for x in got]),
                "check": np.concatenate([x[1] for x in got]),
                "doc_id": batch.column(0).take(rows),
                "row": batch.column(1).take(rows),
                "start": pairs[:, 0],
                "stop": pairs[:, 1],
                "again": again,
            }

        return step

    chosen = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), row_key(text).alias("row"), F.col(text).alias("text"))
    return arrow_map(chosen, start, f"hash long, check int, doc_id {kind}, row long, start int, stop int, again boolean")


def repeats(hashes: np.ndarray) -> np.ndarray:
    """Which hashes stand earlier in the array."""
    out = np.ones(len(hashes), bool)
    out[np.unique(hashes, return_index=True)[1]] = False
    return out


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``row``, ``start`` and ``stop`` of the occurrences of repeated spans that aren't the first.

    Texts are read once; the spans are written to the shared folder.  Within a row the repeats are known at
    once.  The first row of a hash is found with partial minima before the shuffle, so a passage of many
    documents is a few rows; those that are repeated have one row each and meet the spans in a plain
    inner join of two tables, whose hot keys Spark splits.
    """
    spans = staged(span_table(docs, doc_id, text))
    shared = not spans.groupBy("doc_id").agg((F.min("row") != F.max("row")).alias("several")).where("several").isEmpty()
    # Rows are in the order of their ids, and of their keys where some rows share an id.
    place = F.struct("doc_id", "row") if shared else F.col("doc_id")
    least = spans.groupBy("hash", "check").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    firsts = staged(least.where("first <> last").select("hash", "check", "first"))
    places = ("doc_id", "row", "start", "stop")
    later = spans.join(firsts, ["hash", "check"]).where(place != F.col("first")).select(*places)
    return later.unionByName(spans.where("again").select(*places))


def covered(spans: DataFrame) -> DataFrame:
    """Per ``doc_id`` and ``row`` the sentences that the spans cover, as disjoint ``spans array<struct<start, stop>>``."""
    packed = F.shiftleft(F.col("start").cast("long"), 32) + F.col("stop")
    lists = spans.groupBy("doc_id", "row").agg(F.collect_set(packed).alias("packed"))

    def start():
        def step(batch):
            out = []
            for x in batch.column(2):
                pairs = np.sort(x.values.to_numpy())
                start, stop = pairs >> 32, np.maximum.accumulate(pairs & 0xFFFFFFFF)
                opens = np.flatnonzero(np.concatenate(([True], start[1:] > stop[:-1])))
                closes = np.append(opens[1:], len(pairs)) - 1
                out.append([{"start": a, "stop": b} for a, b in zip(start[opens].tolist(), stop[closes].tolist(), strict=True)])
            return {"doc_id": batch.column(0), "row": batch.column(1), "spans": out}

        return step

    kind = spans.schema["doc_id"].dataType.simpleString()
    return arrow_map(lists, start, f"doc_id {kind}, row long, spans array<struct<start:int,stop:int>>")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``__spans`` (the removed sentences), ``__sentences`` (their number before) and ``__text`` (what stays).

    A text without repeated spans stays as it is.  Null and empty texts have no sentences.  Equal rows of an id are one
    document and keep the same sentences; rows of an id and different texts are documents of their own, in an
    order of their texts' hashes.  A row without an id stays as it is and is never a first occurrence.
    """
    found = staged(covered(repeated_spans(docs, doc_id, text))).select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), F.col("spans").alias("__spans"))
    joined = docs.join(broadcast_if_small(found), (F.col(doc_id) == F.col("__id")) & (row_key(text) == F.col("__row")), "left").drop("__id", "__row")
    names = joined.columns
    at, text_at = names.index("__spans"), names.index(text)

    def start():
        def step(batch):
            count, kept = [], []
            for raw, cut in zip(as_bytes(batch.column(text_at)), batch.column(at).to_pylist(), strict=True):
                ends = sentence_ends(raw) if raw else ()
                count.append(len(ends))
                if not cut:
                    kept.append(None if raw is None else raw.decode())
                    continue
                out, last = [], 0
                for x in cut:
                    out.append(raw[last : ends[x["start"] - 1] if x["start"] else 0])
                    last = ends[x["stop"] - 1]
                kept.append(b"".join([*out, raw[last:]]).decode())
            return {n: batch.column(i) for i, n in enumerate(names)} | {"__sentences": count, "__text": kept}

        return step

    return arrow_map(joined, start, with_columns(joined.schema, __sentences="long", __text="string"))


def span_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with repeated sentence spans removed; a document of which nothing is left goes, all others stay."""
    held, own = carried(docs)
    done = without_repeats(held, own[doc_id], own[text])
    emptied = F.col("__spans").isNotNull() & (F.trim(F.translate("__text", "\n\r\t\v\f", "     ")) == "")
    return restored(done.where(~emptied).withColumn(own[text], F.col("__text")), docs)


def span_report(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, ``n_sentences``, ``n_removed``, ``spans`` (removed sentences, half-open) and the remaining ``text``."""
    done = without_repeats(docs.select("doc_id", "text"))
    removed = F.expr("cast(aggregate(coalesce(__spans, array()), 0, (n, x) -> n + x.stop - x.start) as bigint)")
    return done.select("doc_id", F.col("__sentences").alias("n_sentences"), removed.alias("n_removed"), F.col("__spans").alias("spans"), F.col("__text").alias("text"))

"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned against every token window.

A window is ``n`` consecutive words of an item; an item of fewer, but not none,
is one window.  The hash set finds candidate places; each is verified word by
word, so hash collisions change nothing.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import ALNUM_TABLE, WordHash, alnum_words, arrow_map, as_bytes, carried, restored, windows, with_columns

#: Bytes of benchmark text, and windows, that are broadcast at once; larger benchmarks are taken in blocks.  A window takes up to
#: 40 bytes in a worker beside the text, so a block is under 60 MB there.
BLOCK_BYTES, BLOCK_WINDOWS = 16 << 20, 1 << 20
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


class Grams:
    """The windows of a block of items as arrays: by length, sorted hashes with their items and places in the items' words."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], n: int):
        self.names = [x for x, _ in items]
        one, parts, at = WordHash(), [], 0
        found: dict[int, list[np.ndarray]] = {}
        for i, (_, text) in enumerate(items):
            words = alnum_words(text)
            if not words:
                continue
            size = min(n, len(words))
            hashes = windows(one.array(words), size)
            ends = at + np.cumsum([len(w) + 1 for w in words])
            start = np.concatenate(([at], ends[:-1]))[: len(hashes)]
            rows = np.stack((hashes.view(np.int64), np.full(len(hashes), i), start, ends[size - 1 :] - 1 - start))
            found.setdefault(size, []).append(rows)
            parts.append(b" ".join(words))
            at = int(ends[-1])
        self.text = b" ".join(parts)
        self.by_length = {}
        for size, rows in found.items():
            keys, item, start, length = np.concatenate(rows, axis=1)
            keys = keys.view(np.uint64)
            order = np.lexsort((start, item, keys))
            keys, item = keys[order], item[order].astype(np.int32)
            first = np.concatenate(([True], (keys[1:] != keys[:-1]) | (item[1:] != item[:-1])))
            # Of a window that an item has twice one is enough.
            keys, item, start, length = keys[first], item[first], start[order][first], length[order][first].astype(np.int32)
            bits = max(10, int(np.ceil(np.log2(8 * len(keys) + 1))))
            hit = np.zeros(1 << bits, bool)
            hit[(keys >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.by_length[size] = bits, hit, keys, item, start, length

    def find(self, words: list[bytes], hashes: np.ndarray) -> tuple[np.ndarray, set[str | None]]:
        """Which words lie inside an occurrence, and the items with occurring windows."""
        edge = np.zeros(len(words) + 1, np.int64)
        found: set[int] = set()
        for size, (bits, hit, keys, item, start, length) in self.by_length.items():
            if size > len(words):
                continue
            wanted = windows(hashes, size)
            places = np.flatnonzero(hit[(wanted >> np.uint64(64 - bits)).astype(np.int64)])
            low, high = (np.searchsorted(keys, wanted[places], side) for side in ("left", "right"))
            some = np.flatnonzero(low < high)
            for i, a, b in zip(places[some].tolist(), low[some].tolist(), high[some].tolist(), strict=True):
                gram = b" ".join(words[i : i + size])
                same = [k for k in range(a, b) if length[k] == len(gram) and self.text.startswith(gram, start[k])]
                if same:
                    edge[i] += 1
                    edge[i + size] -= 1
                    found.update(item[same].tolist())
        return np.cumsum(edge[:-1]) > 0, {self.names[k] for k in found}


def without_hits(text: bytes, hit: np.ndarray) -> bytes:
    """The text without its hit words; a removed stretch leaves one space."""
    starts, stops = word_bounds(text)
    cut = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    out, at = [], 0
    for a, b in cut.reshape(-1, 2).tolist():
        out.append(text[at : starts[a]])
        at = stops[b - 1]
    out.append(text[at:])
    return b"".join(out)


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which the words of ``alnum_words`` start and stop."""
    inside = np.frombuffer(text.translate(ALNUM_TABLE), np.uint8) != 0x20
    step = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    return step[::2], step[1::2]


def blocks_of(benchmark: DataFrame, item: str, text: str, block_bytes: int, block_windows: int) -> list[DataFrame]:
    """The benchmark as it is, or in hash blocks of about ``block_bytes`` of text and ``block_windows`` words (as many windows at most)."""
    rows = benchmark.select(F.col(item).cast("string").alias("item_id"), F.col(text).alias("text"))
    found = rows.agg(
        F.coalesce(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + F.octet_length(F.coalesce("item_id", F.lit("")))), F.lit(0)),
        F.coalesce(F.sum(F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORDS), F.lit(0)))), F.lit(0)),
    ).first()
    n = max(-(-int(found[0]) // block_bytes), -(-int(found[1]) // block_windows), 1)
    return [rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else rows for k in range(n)]


def scan(docs: DataFrame, items: list[tuple[str | None, bytes | None]], n: int, text: str, keep: tuple[str, ...], spans: bool, clean: bool) -> DataFrame:
    grams = docs.sparkSession.sparkContext.broadcast(Grams(items, n))
    kept = docs.select(*keep).schema

    def start():
        cache, found = WordHash(), grams.value

        def step(batch):
            out = {k: [] for k in ("n_words", "n_hit", "item_ids", "hit_words", "clean_text")}
            for raw in as_bytes(batch.column(len(keep))):
                words = alnum_words(raw)
                hit, items = found.find(words, cache.array(words))
                out["n_words"].append(len(words))
                out["n_hit"].append(int(hit.sum()))
                out["item_ids"].append(sorted(x for x in items if x is not None))
                if spans:
                    out["hit_words"].append(np.flatnonzero(hit))
                if clean:
                    out["clean_text"].append(without_hits(raw, hit).decode() if hit.any() else None if raw is None else raw.decode())
            return {f.name: batch.column(i) for i, f in enumerate(kept)} | out

        return step

    more = {"n_words": "long", "n_hit": "long", "item_ids": "array<string>"} | ({"hit_words": "array<long>"} if spans else {}) | ({"clean_text": "string"} if clean else {})
    return arrow_map(docs.select(*keep, F.col(text).alias("__text")), start, with_columns(kept, **more))


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, n: int = 8, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item: str = "item_id", item_text: str = "text", clean: bool = False, block_bytes: int = BLOCK_BYTES, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Per row of ``docs``: the columns ``keep``, ``n_words``, ``n_hit`` (words inside an occurrence of a
    window) and ``item_ids array<string>`` (items with occurring windows, sorted); with ``clean`` also
    ``clean_text``, the text without the hit words.

    The size of ``benchmark`` is checked.  Up to ``block_bytes`` of text and ``block_windows`` words its windows are
    broadcast and the documents pass through one map without a shuffle.  A larger one is taken in
    blocks, each broadcast alone and scanned against all documents, and the hit places of equal texts
    are united; hot groups of copies are combined before that shuffle.

    Null and empty texts have no words and no hits.  An item without an id marks words but isn't
    listed; an item without words has no window.  Repeated rows give repeated results.
    """
    blocks = blocks_of(benchmark, item, item_text, block_bytes, block_windows)
    collected = lambda b: [(r[0], None if r[1] is None else r[1].encode()) for r in b.collect()]
    if len(blocks) == 1:
        return scan(docs, collected(blocks[0]), n, text, keep, False, clean)
    texts = docs.select(F.sha2(text, 256).alias("__key"), F.col(text).alias("__whole")).where(F.col(text).isNotNull())
    parts = [
        scan(texts, collected(b), n, "__whole", ("__key",), True, False).where("n_hit > 0").groupBy("__key").agg(F.first("hit_words").alias("hit_words"), F.first("item_ids").alias("item_ids"))
        for b in blocks
    ]
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    hits = hits.groupBy("__key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_words")))).alias("__hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("__items"))
    whole = docs.select(*keep, F.col(text).alias("__whole"), F.sha2(text, 256).alias("__key")).join(hits, "__key", "left")
    kept = docs.select(*keep).schema

    def start():
        def step(batch):
            n_words, clean_text = [], []
            hits = batch.column(len(keep) + 1).to_pylist()
            for raw, places in zip(as_bytes(batch.column(len(keep))), hits, strict=True):
                words = alnum_words(raw)
                n_words.append(len(words))
                hit = np.zeros(len(words), bool)
                hit[places or []] = True
                clean_text.append(None if raw is None else without_hits(raw, hit).decode())
            none = {"n_hit": [len(x or ()) for x in hits], "item_ids": [x or [] for x in batch.column(len(keep) + 2).to_pylist()]}
            return {f.name: batch.column(i) for i, f in enumerate(kept)} | none | {"n_words": n_words, "clean_text": clean_text}

        return step

    more = {"n_words": "long", "n_hit": "long", "item_ids": "array<string>"} | ({"clean_text": "string"} if clean else {})
    return arrow_map(whole.select(*keep, "__whole", "__hit", "__items"), start, with_columns(kept, **more))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 8, min_items: int = 2, text: str = "text") -> DataFrame:
    """``docs`` without rows that hold windows of ``min_items`` or more items, and without the hit words of the others.

    All columns stay as they are; texts without hits are unchanged.
    """
    held, own = carried(docs)
    found = benchmark_hits(held, benchmark, n, own[text], tuple(held.columns), clean=True)
    return restored(found.where(F.size("item_ids") < min_items).withColumn(own[text], F.col("clean_text")), docs)


def hit_digest(hits: DataFrame, min_items: int = 2) -> DataFrame:
    """The hits with their item ids as a count and a SHA-256 sum."""
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("item_ids") >= min_items).alias("contaminated"),
    )

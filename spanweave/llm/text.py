"""Byte-level text helpers shared by the operators that run in Python workers.

Texts are handled as UTF-8 bytes: ``bytes.lower`` touches A-Z only and
``bytes.split`` cuts at exactly space and ``\\t\\n\\v\\f\\r``, so both word rules
of this package are single C calls.
"""

import ctypes
import gc
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

#: Lower-cases A-Z and turns every other ASCII byte outside 0-9 and a-z into a space.
ALNUM_TABLE = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)
#: ASCII white space: which bytes it is, and a pattern.
SPACE_BYTES = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
SPACE = re.compile(rb"[\t-\r ]")
#: Odd multiplier of the rolling word-window hash, and the constants of the splitmix64 finalizer.
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Words held by one worker's hash cache before it starts anew.
CACHE_WORDS = 150_000
#: Bytes of a record batch that are worked on at once, and of the batches that Spark sends to workers.
SLICE_BYTES, SENT_BYTES = 2 << 20, 4 << 20


def alnum_words(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of digits, a-z and non-ASCII characters; none for null."""
    return text.translate(ALNUM_TABLE).split() if text else []


def space_words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of anything but ASCII white space; none for null."""
    return text.lower().split() if text else []


def cut_at_spaces(text: bytes, size: int):
    """A text in parts of about ``size`` bytes that end where words end."""
    at = 0
    while len(text) - at > size and (m := SPACE.search(text, at + size)):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:]


class WordHash(dict):
    """word -> 64-bit hash, computed once per word while the cache holds it."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64 finalizer: every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


#: Hash of a byte at each place of a word: a number by byte, times a power of an odd base.
BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * STEP)
BASE = int(STEP)
#: Bytes of text that are hashed at once.
HASHED_BYTES = 1 << 18


class Words:
    """64-bit hashes of the words of texts, without making each word: those of ``space_words``, or with ``alnum`` of ``alnum_words``; with ``stem`` also those of their first bytes."""

    def __init__(self, alnum: bool = False, stem: int = 0):
        self.alnum, self.stem = alnum, stem
        self.up = self.down = np.zeros(0, np.uint64)

    def hashed(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each word of a text that ends with white space starts, its hash and its stem's."""
        if len(raw) > len(self.up):
            powers = [np.full(max(len(raw), HASHED_BYTES + 4096), x, np.uint64) for x in (BASE, pow(BASE, -1, 1 << 64))]
            for p in powers:
                p[0] = 1
            self.up, self.down = (np.cumprod(p, dtype=np.uint64) for p in powers)
        text = np.frombuffer(raw.translate(ALNUM_TABLE) if self.alnum else raw.lower(), np.uint8)
        inside = np.concatenate(([False], text != 0x20 if self.alnum else ~SPACE_BYTES[text]))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, stop = edge[::2], edge[1::2]
        upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTES[text] * self.up[: len(text)], dtype=np.uint64)))
        hashed = lambda end: mixed((upto[end] - upto[start]) * self.down[start] + (end - start).astype(np.uint64))
        return start, hashed(stop), hashed(np.minimum(stop, start + self.stem)) if self.stem else start

    def of(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The hashes of all words end to end, those of their stems, and the number of each text's words."""
        found, stems, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64)
        held: list[tuple[int, bytes]] = []
        size = 0

        def flush():
            start, hashes, of_stems = self.hashed(b"\n".join([x for _, x in held]) + b"\n")
            stops = np.cumsum([len(x) + 1 for _, x in held])
            np.add.at(n, [i for i, _ in held], np.diff(np.searchsorted(start, stops), prepend=0))
            found.append(hashes)
            stems.append(of_stems)
            held.clear()

        for i, text in enumerate(texts):
            for part in cut_at_spaces(text, HASHED_BYTES) if text else ():
                if held and size + len(part) > HASHED_BYTES:
                    flush()
                    size = 0
                held.append((i, part))
                size += len(part) + 1
        if held:
            flush()
        return np.concatenate(found), np.concatenate(stems) if self.stem else found[0], n


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """One hash for each run of ``length`` consecutive word hashes."""
    n = len(hashes) - length + 1
    if n <= 0:
        return hashes[:0]
    out = hashes[:n].copy()
    for j in range(1, length):
        out *= STEP
        out += hashes[j : j + n]
    return mixed(out)


def shingles(hashes: np.ndarray, length: int) -> np.ndarray:
    """Sorted distinct window hashes; a shorter, non-empty text is one window."""
    return np.unique(windows(hashes, min(length, len(hashes)))) if len(hashes) else hashes


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """A string column's values in UTF-8."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def arrow_map(df: DataFrame, function, schema, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` of a function from a record batch to a dict of columns (or None), made once per partition by ``function()``.

    Sets the session's ``spark.sql.execution.arrow.maxBytesPerBatch`` to ``SENT_BYTES`` where it is larger, and gives
    the memory of a partition back at its end: workers are used again and would otherwise only grow.
    """
    schema = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    arrow = to_arrow_schema(schema)
    small_batches(df.sparkSession)

    def run(batches):
        step = function()
        for batch in batches:
            for part in sliced(batch, slice_bytes):
                out = step(part)
                if out is not None:
                    yield pa.RecordBatch.from_arrays([as_array(out[f.name], f.type) for f in arrow], schema=arrow)
        step = out = batch = part = None
        release()

    return df.mapInArrow(run, schema)


def small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark.conf.get(name).removesuffix("b")
    if not size.isdigit() or int(size) > SENT_BYTES:
        spark.conf.set(name, str(SENT_BYTES))


def release() -> None:
    """Gives unused memory of this worker back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def with_columns(kept: StructType, **kinds: str) -> StructType:
    """A new schema: the fields of ``kept`` and those given by name and DDL type."""
    return StructType([*kept.fields, *(StructField(n, _parse_datatype_string(k)) for n, k in kinds.items())])


def carried(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns named by place, so that none clashes with a working column, and those names by the old ones."""
    places = [f"__c{i}" for i in range(len(df.columns))]
    return df.toDF(*places), dict(zip(df.columns, places, strict=True))


def restored(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``carried(like)`` in ``df``, under their own names."""
    return df.select(*[f"__c{i}" for i in range(len(like.columns))]).toDF(*like.columns)


def as_array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, kind)


def sliced(batch: pa.RecordBatch, size: int):
    """The batch in runs of rows of about ``size`` bytes: long texts never pile up in one step."""
    rows = max(1, int(batch.num_rows * size / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)

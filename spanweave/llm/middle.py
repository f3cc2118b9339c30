"""Fill-in-middle: texts cut in three at unit borders and put in an order in which the middle comes last.

A text is held as its maximal runs of bytes of one class, each with the number of units that are complete at
its end.  A cut after some number of units is found by binary search for the run that holds it, and its byte within that run by
arithmetic, so no unit is ever made:

* ``line``: runs of line feeds (each ends a unit) and of anything else (which ends none, but for the last run of a text);
* ``word``: runs of ASCII white space (which belongs to the word after it) and of anything else (one unit);
* ``char``: runs of characters of one UTF-8 length (a unit for each).
"""

from hashlib import sha256

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACE_BYTES, arrow_map, as_bytes

#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
#: Bytes of the character that a byte begins; 0 within one.
WIDTH = np.repeat(np.array([1, 0, 2, 3, 4], np.int64), [128, 64, 32, 16, 16])


class Runs:
    """The runs of a text: where each starts and stops, the units complete at its end, and the bytes of a unit within it (0: the run completes one at its end at most)."""

    def __init__(self, raw: bytes, unit: str):
        data = np.frombuffer(raw, np.uint8)
        if unit == "char":
            lead = np.flatnonzero((data & 0xC0) != 0x80)
            kind = WIDTH[data[lead]]
            first = np.flatnonzero(np.diff(kind, prepend=0))
            self.start, self.step = lead[first], kind[first]
            counts = np.diff(first, append=len(kind))
        else:
            kind = data == 10 if unit == "line" else SPACE_BYTES[data]
            self.start = np.flatnonzero(np.concatenate((kind[:1] | True, kind[1:] != kind[:-1])))
            counts = self.counts(kind[self.start], np.diff(self.start, append=len(data)), unit)
            self.step = np.where(kind[self.start], 1, 0) if unit == "line" else np.zeros(len(counts), np.int64)
        self.stop = np.append(self.start[1:], len(data))
        self.upto = np.cumsum(counts)

    @staticmethod
    def counts(kind: np.ndarray, length: np.ndarray, unit: str) -> np.ndarray:
        counts = np.where(kind, length, 0) if unit == "line" else np.where(kind, 0, 1)
        # What no line feed or word completes is a unit at the end of the text.
        if len(counts) and not counts[-1]:
            counts[-1] = 1
        return counts

    def __len__(self) -> int:
        """The number of units."""
        return int(self.upto[-1]) if len(self.upto) else 0

    def byte(self, units: int) -> int:
        """Where the text is cut after so many units."""
        if not units:
            return 0
        run = int(np.searchsorted(self.upto, units))
        if not self.step[run]:
            return int(self.stop[run])
        before = int(self.upto[run - 1]) if run else 0
        return int(self.start[run]) + (units - before) * int(self.step[run])


def draws(seed: int, doc_id) -> list[int]:
    """Four numbers below 2**32 that the seed and the id give; a null id counts as an empty one."""
    digest = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4)]


def fill_in_middle(docs: DataFrame, unit: str = "line", rate: int = 100, spm: int = 50, seed: int = 7, doc_id: str = "doc_id", text: str = "text", marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Per row: ``doc_id``, ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    Two draws by ``seed`` and id give the cuts, which may be equal or at the ends; the third makes ``rate`` of 100 texts
    examples, and the fourth ``spm`` of 100 of those suffix first (``spm``), the others prefix first (``psm``).  Output:
    ``psm`` P prefix S suffix M middle, ``spm`` S suffix P prefix M middle, and ``plain`` the text, for empty and null texts
    (``output`` is empty), those that contain a mark and those not drawn; numbers of characters are null there.
    Rows of one id are cut by the same draws, repeated rows alike; a null id draws as an empty one.  Very long texts take
    some 40 bytes for each run.  Raises ValueError for an unknown unit.
    """
    if unit not in ("line", "word", "char"):
        raise ValueError("unit is line, word or char")
    kind = docs.schema[doc_id].dataType.simpleString()
    p, s, m = (x.encode() for x in marks)

    def start():
        def chars(raw: bytes) -> int:
            return int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))

        def step(batch):
            rows = []
            for key, raw in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                raw = raw or b""
                runs = Runs(raw, unit)
                n = len(runs)
                one, two, drawn, order = draws(seed, key)
                if not n or drawn % 100 >= rate or any(x in raw for x in (p, s, m)):
                    rows.append((n, "plain", None, None, raw))
                    continue
                a, b = (runs.byte(x) for x in sorted((one % (n + 1), two % (n + 1))))
                prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
                first = order % 100 < spm
                out = b"".join((s, suffix, p, prefix, m, middle) if first else (p, prefix, s, suffix, m, middle))
                rows.append((n, "spm" if first else "psm", chars(prefix), chars(middle), out))
            names = ("n", "form", "prefix_chars", "middle_chars", "output")
            return {"doc_id": batch.column(0)} | {x: [r[i] for r in rows] for i, x in enumerate(names)}

        return step

    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return arrow_map(chosen, start, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored_text(output: str = "output", form: str = "form", marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``fill_in_middle`` made an output of, from that and its form alone; null for a null output."""
    p, s, m = marks
    out = F.col(output)
    after = lambda x, n: F.substr(x, n + F.lit(1))
    # Neither text nor marks contain a mark, so each is found once.
    body = {form: after(out, F.lit(len(lead))) for form, lead in (("psm", p), ("spm", s))}
    one = {"psm": F.substring_index(body["psm"], s, 1), "spm": F.substring_index(body["spm"], p, 1)}
    two = {form: F.substring_index(after(body[form], F.length(one[form]) + len(lead)), m, 1) for form, lead in (("psm", s), ("spm", p))}
    middle = F.substring_index(out, m, -1)
    return F.when(F.col(form) == "psm", F.concat(one["psm"], middle, two["psm"])).when(F.col(form) == "spm", F.concat(two["spm"], middle, one["spm"])).otherwise(out)


def middle_digest(examples: DataFrame) -> DataFrame:
    """``fill_in_middle``'s rows with the digests of the output and of the text restored from it in place of the output."""
    return examples.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored_text(), 256).alias("restored_sha256"))

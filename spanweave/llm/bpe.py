"""BPE encoding and decoding by a pair occurrence index.

The distinct pieces of many texts lie end to end in one symbol array with links
to the next and previous symbol.  An index maps each mergeable pair's rank to
all its positions; active ranks are taken in ascending order, all positions of
a rank are merged at once, and only the lists of the pairs beside a merge are
updated.  This equals merging word by word because a merge can only make pairs
of higher rank (checked when a vocabulary is loaded).

Null and empty texts have no tokens and decode to the empty text.
"""

import gc
import hashlib
import heapq
import json
import re
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import arrow_map, as_bytes, cut_at_spaces, with_columns

#: Key of a pair: left id * PAIR + right id.
PAIR = 1 << 32
#: Words whose tokens one worker keeps between batches, bytes of text it encodes together, and tokens it decodes together.
KEPT_WORDS, BATCH_BYTES, DECODED = 100_000, 5 << 19, 1 << 17
#: Split patterns by which runs of letters and of signs are pieces, and words of ASCII letters and signs then (no apostrophe, no start of a special string).
USUAL_SPLIT = re.compile(r"('\w+\|)*\[\\p\{L\}\]\+\|\[\\p\{N\}\]\|\[\^\\s\\p\{L\}\\p\{N\}\]\+")
USUAL_WORD = re.compile(rb"([A-Za-z]*)([!-&(-/:;=-@\[-`{-~]*)")


@dataclass
class WordBpe:
    """A BPE vocabulary with word ends, lower case and dropped white space, as plain arrays.

    ``special`` are strings that stand for one token wherever they occur in a raw text.
    """

    tokens: list[str]
    first_ids: np.ndarray
    last_ids: np.ndarray
    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    made: np.ndarray
    special: dict[str, int]
    pattern: str
    _compiled: tuple | None = field(default=None, repr=False)

    @classmethod
    def load(cls, path: str) -> "WordBpe":
        """Reads a tokenizers JSON file; raises ValueError for settings other than those described above."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec["added_tokens"]
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        suffix = model["end_of_word_suffix"]
        plain = (
            steps == ["NFC", "Replace", "Lowercase"]
            and split["behavior"] == "Removed"
            and split["invert"]
            and not level["add_prefix_space"]
            and not level["use_regex"]
            and suffix
            and not any(model[k] for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
            and not any(x[k] for x in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
            and spec["decoder"] is None
        )
        if not plain:
            raise ValueError(f"{path} has settings that this encoder doesn't know")
        ids = model["vocab"]
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        made = np.array([ids[a + b] for a, b in merges], np.int64)
        if len(np.unique(made)) != len(made):
            raise ValueError(f"{path} makes a token in two ways; ranks in ascending order would not be exact")
        rank_of = dict(zip(made.tolist(), range(len(made)), strict=True))
        if any(rank_of.get(ids[x], -1) >= r for r, pair in enumerate(merges) for x in pair):
            raise ValueError(f"{path} uses a token before it is made")
        keys = np.array([ids[a] * PAIR + ids[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        names = byte_names()
        tokens = [""] * (max([*ids.values(), *(x["id"] for x in added)]) + 1)
        for token, i in ids.items():
            tokens[i] = token
        for x in added:
            tokens[x["id"]] = x["content"]
        return cls(
            tokens,
            np.array([ids[c] for c in names], np.int32),
            np.array([ids[c + suffix] for c in names], np.int32),
            keys[order],
            order.astype(np.int32),
            made.astype(np.int32),
            {x["content"]: x["id"] for x in added},
            split["pattern"]["Regex"],
        )

    def patterns(self) -> tuple:
        if self._compiled is None:
            special = "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))
            self._compiled = regex.compile(self.pattern), regex.compile(f"({special})") if special else None
        return self._compiled

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, -1 where it never merges."""
        keys = left.astype(np.int64) * PAIR + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the non-empty pieces, end to end, and where each piece ends."""
        if not pieces:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        stops = np.cumsum(lengths)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        symbols = self.first_ids[raw]
        symbols[stops - 1] = self.last_ids[raw[stops - 1]]
        after = np.arange(1, len(raw) + 1, dtype=np.int32)
        after[stops - 1] = -1
        before = np.arange(-1, len(raw) - 1, dtype=np.int32)
        before[stops - lengths] = -1
        alive = np.ones(len(raw), bool)
        rank_at = np.full(len(raw), -1, np.int32)
        inner = np.flatnonzero(after >= 0).astype(np.int32)
        rank_at[inner] = self.ranks(symbols[inner], symbols[inner + 1])

        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(places: np.ndarray) -> None:
            ranks = rank_at[places]
            places, ranks = places[ranks >= 0], ranks[ranks >= 0]
            if not len(places):
                return
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            starts = [0, *cuts.tolist(), len(places)]
            for r, a, b in zip(ranks[[0, *cuts]].tolist(), starts, starts[1:]):
                if r in index:
                    index[r].append(places[a:b])
                else:
                    index[r] = [places[a:b]]
                    heapq.heappush(active, r)

        note(inner)
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            at = np.concatenate(lists) if len(lists) > 1 else lists[0]
            at = at[rank_at[at] == rank]
            if not len(at):
                continue
            if len(lists) > 1:
                at = np.unique(at)
            if symbols[at[0]] == symbols[after[at[0]]]:
                at = leftmost(np.sort(at), after)
            gone = after[at]
            then = after[gone]
            symbols[at] = self.made[rank]
            alive[gone] = False
            rank_at[gone] = -1
            after[at] = then
            has_next = then >= 0
            before[then[has_next]] = at[has_next]
            rank_at[at] = -1
            left = before[at]
            left = left[left >= 0]
            changed = np.concatenate([at[has_next], left])
            if len(changed):
                changed = np.unique(changed)
                rank_at[changed] = self.ranks(symbols[changed], symbols[after[changed]])
                note(changed)
        return symbols[alive].astype("<u4"), np.cumsum(alive)[stops - 1]

    def pieces(self, word: str) -> list[bytes]:
        """The pieces of a stretch of raw text without special strings."""
        text = unicodedata.normalize("NFC", word)
        # Sigma alone has a lower case that depends on its place; each character is lowered on its own.
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        return [x.encode() for x in self.patterns()[0].findall(text)]


def leftmost(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of overlapping occurrences of a pair of equal symbols, every other one from the left."""
    keep, last = [], -1
    for i in at.tolist():
        if i != last:
            keep.append(i)
            last = after[i]
    return np.array(keep, np.int64)


def byte_names() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the others for the code points from 256 on.
    """
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)}
    others = iter(range(256, 512))
    return [chr(b if b in shown else next(others)) for b in range(256)]


class Encoder:
    """Encodes texts of one worker in batches; keeps the tokens of up to ``KEPT_WORDS`` words from one batch to the next."""

    def __init__(self, model: WordBpe):
        self.model = model
        self.ids: dict[bytes, bytes] = {}
        self.decoder = Decoder(model.tokens)
        self.usual = USUAL_SPLIT.fullmatch(model.pattern) and all(x.startswith("<") for x in model.special)

    def learn(self, texts: list[bytes]) -> None:
        """Encodes all words of the texts that aren't known yet, together."""
        words: set[bytes] = set()
        for text in texts:
            words.update(text.split())
        words.difference_update(self.ids)
        cut = self.model.patterns()[1]
        # Words that are one piece each, and the parts of the others; bytes are pieces, numbers are special tokens.
        single: list[tuple[bytes, bytes]] = []
        several: list[tuple[bytes, list]] = []
        usual = USUAL_WORD.fullmatch if self.usual else lambda word: None
        for word in words:
            if met := usual(word):
                letters, signs = met.groups()
                if letters and signs:
                    several.append((word, [letters.lower(), signs]))
                else:
                    single.append((word, letters.lower() or signs))
                continue
            raw = word.decode("utf-8", "replace")
            if cut and "<" in raw and cut.search(raw):
                row: list = []
                for x in cut.split(raw):
                    if x in self.model.special:
                        row.append(self.model.special[x])
                    else:
                        row += self.model.pieces(x)
                several.append((word, row))
            elif len(found := self.model.pieces(raw)) == 1:
                single.append((word, found[0]))
            else:
                several.append((word, found))
        pieces = {x for _, x in single}
        pieces.update(x for _, row in several for x in row if isinstance(x, bytes))
        ids = self.tokens_of(list(pieces))
        for word, piece in single:
            self.ids[word] = ids[piece]
        for word, row in several:
            self.ids[word] = b"".join([ids[x] if isinstance(x, bytes) else np.uint32(x).tobytes() for x in row])

    def tokens_of(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """The ids of each piece as little-endian 32-bit numbers."""
        symbols, ends = self.model.encode_pieces(pieces)
        raw, stops = symbols.tobytes(), (4 * ends).tolist()
        return {piece: raw[a:b] for piece, a, b in zip(pieces, [0, *stops], stops, strict=False)}

    def ids_of(self, text: bytes) -> bytes:
        return b"".join(map(self.ids.__getitem__, text.split()))

    def encode(self, text: bytes) -> tuple[bytes, bytes]:
        """Ids as little-endian 32-bit numbers, and the decoded text in UTF-8, of a text whose words are known."""
        ids = self.ids_of(text)
        return ids, self.decoder.decode([ids])[0][:-1]

    def encode_all(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Ids, and each token's text with a space after it, of every text; then words go if there are too many."""
        self.learn(texts)
        ids = list(map(self.ids_of, texts))
        if len(self.ids) > KEPT_WORDS:
            self.ids.clear()
        return list(zip(ids, self.decoder.decode(ids), strict=True))


class Decoder:
    """Token ids to text: each token's bytes with a space after it, unused ids none."""

    def __init__(self, tokens: list[str]):
        shown = [t.encode() + b" " if t else b"" for t in tokens]
        self.size = np.fromiter(map(len, shown), np.int32, len(shown))
        self.start = np.cumsum(self.size, dtype=np.int32) - self.size
        self.flat = np.frombuffer(b"".join(shown), np.uint8)

    def decode(self, lists: list[bytes]) -> list[bytes]:
        """The bytes of every list of ids (little-endian, 32 bits, all known)."""
        ids = np.frombuffer(b"".join(lists), "<u4")
        stops = np.cumsum(self.size[ids], dtype=np.int64)
        parts = []
        for at in range(0, len(ids), DECODED):
            part = ids[at : at + DECODED]
            size = self.size[part]
            stop = np.cumsum(size, dtype=np.int32)
            parts.append(self.flat[np.arange(stop[-1], dtype=np.int32) + np.repeat(self.start[part] - stop + size, size)].tobytes())
        raw = b"".join(parts)
        ends = np.concatenate(([0], stops))[np.cumsum([0, *(len(x) // 4 for x in lists)])].tolist()
        return [raw[a:b] for a, b in zip(ends, ends[1:])]


def bpe_encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), digest: bool = False) -> DataFrame:
    """Token ids and decoded text of every whole text.

    Returns the columns ``keep`` with ``n_tokens long``, and ``ids array<int>`` and ``decoded
    string``, or with ``digest`` their SHA-256 sums ``ids_sha256`` and ``decoded_sha256``
    instead; a column of ``keep`` that has one of these names is left out.  Special strings of the
    vocabulary in a text are their tokens, as the library has it.  A map over partitions without a
    shuffle; repeated rows give repeated results.  The vocabulary at ``path`` is read on the driver
    and broadcast; it doesn't grow with the data.  A worker holds ``BATCH_BYTES`` of text and the tokens of
    ``KEPT_WORDS`` words and of that text's; longer texts are encoded part by part.
    """
    spark: SparkSession = docs.sparkSession
    model = spark.sparkContext.broadcast(WordBpe.load(path))
    made = {"ids_sha256": "string", "decoded_sha256": "string"} if digest else {"ids": "array<int>", "decoded": "string"}
    keep = tuple(x for x in keep if x not in {"n_tokens", *made})
    kept = docs.select(*keep).schema

    def start():
        encoder = Encoder(model.value)

        def step(batch):
            texts = [x or b"" for x in as_bytes(batch.column(len(keep)))]
            ids, shown = [[] for _ in texts], [[] for _ in texts]
            held, size = [], 0

            def encode():
                # The collector would walk the word table again and again; it holds no cycles.
                gc.disable()
                for (row, _), (i, d) in zip(held, encoder.encode_all([x for _, x in held]), strict=True):
                    ids[row].append(i)
                    shown[row].append(d)
                gc.enable()
                held.clear()

            for row, whole in enumerate(texts):
                for part in cut_at_spaces(whole, BATCH_BYTES):
                    if held and size + len(part) > BATCH_BYTES:
                        encode()
                        size = 0
                    held.append((row, part))
                    size += len(part)
            encode()
            n, of_ids, of_shown = [], [], []
            for i, d in zip(ids, shown, strict=True):
                i, d = b"".join(i), b"".join(d)[:-1]
                n.append(len(i) // 4)
                of_ids.append(hashlib.sha256(i).hexdigest() if digest else np.frombuffer(i, "<i4"))
                of_shown.append(hashlib.sha256(d).hexdigest() if digest else d.decode())
            return {f.name: batch.column(i) for i, f in enumerate(kept)} | {"n_tokens": n} | dict(zip(made, (of_ids, of_shown), strict=True))

        return step

    schema = with_columns(kept, n_tokens="long", **made)
    return arrow_map(docs.select(*keep, F.col(text).alias("__text")), start, schema, slice_bytes=BATCH_BYTES)


def bpe_decode(rows: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Decoded text of id arrays: token strings joined by a space; null and empty arrays give the empty text, unknown ids none."""
    model = rows.sparkSession.sparkContext.broadcast(WordBpe.load(path).tokens)
    keep = tuple(x for x in keep if x != "decoded")
    kept = rows.select(*keep).schema

    def start():
        decoder = Decoder(model.value)

        def step(batch):
            known = [[i for i in x or () if i is not None and 0 <= i < len(decoder.size)] for x in batch.column(len(keep)).to_pylist()]
            shown = [x[:-1].decode() for x in decoder.decode([np.array(x, "<u4").tobytes() for x in known])]
            return {f.name: batch.column(i) for i, f in enumerate(kept)} | {"decoded": shown}

        return step

    return arrow_map(rows.select(*keep, F.col(ids).alias("__ids")), start, with_columns(kept, decoded="string"))

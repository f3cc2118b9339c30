"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

``P(word | context) = P(class | context) * P(subclass | class, context) * P(word | subclass, context)``:
each factor is a softmax over ``FAN`` members, with as many factors as the number of distinct words
asks for.  The most frequent words are members of their own, dealt over the classes
so that all classes have about the same share of the text; the others share ``FAN ** levels / 4`` members by
hash, and within one each has its add-one share of the corpus counts (words that training
never saw have one share together).  So every word is predicted from its context, whatever its rank.

The logits of a factor are its logarithmic shares in the corpus and three rows of weights, chosen by
hashes of the word before, of the two before, and of the word before that one alone (a skip).
Every class has rows of its own.  The tables grow with the number of distinct words up to ``ROW_BITS``, that is
to 50 MB, which bounds what is broadcast.

Training is by gradients summed over the corpus.  The gradient of a weight is the number of
times that its context meets its member less the number that the model expects; both are whole numbers
or follow from them, are added up per row over all partitions in a shuffle, and so don't depend on
how the rows are dealt out.  The step divides by the curvature, in logarithms:
``RATE * log((observed + PRIOR) / (expected + PRIOR))``.  Every round is over all training documents.  In the first,
with weights of zero, expectations follow from the counts; the next draw one expected
member for every token from the model's softmax, by a hash of the document and the place.  Scoring works on batches of tokens, three rows each.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged
from .text import Words, arrow_map, as_bytes, mixed, release, sliced, small_batches, with_columns

#: Members of a softmax (a power of two), most factors, and the least and most rows of a factor's weights, as powers of two.
FAN, LEVELS, ROW_BITS = 32, 3, (11, 17)
#: Words whose counts are broadcast, by descending count.
HEAD_WORDS = 1 << 18
#: Rounds of training, and rates and priors of the first and of the others (chosen by ``settings.py`` on a split of the training rows).
ROUNDS, RATE, PRIOR, LATER_RATE, LATER_PRIOR = 2, 0.65, 2.5, 0.5, 32.0
#: Bound of a weight, and of the logarithm of a share.
MOST, LEAST_LOG = 18.0, -60.0
#: Tokens that are worked on at once, bits of the short hashes by which frequent words are found, and words that a worker counts before it sends them on.
STEP_TOKENS, SPOTS, COUNTED = 4096, 21, 1 << 20
#: Rows of a piece of the weights, and bytes of text that a worker holds at once.
PIECE_ROWS, PART_BYTES = 2048, 1 << 20
#: Hashes of the end token and of the place before a text.
END, BEFORE = np.uint64(0x51ED270B5A1F2C37), np.uint64(0xA24BAED4963EE407)
#: Marks of the three context features, and of the factors (any odd numbers).
MARKS = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)
FACTORS = np.array([0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165], np.uint64)


def tokens_of(words: Words, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The token hashes of all texts end to end, an end token after each, and the number of each text's tokens."""
    hashes, _, n = words.of(texts)
    return np.insert(hashes, np.cumsum(n), END), n + 1


def counted(docs: DataFrame, text: str) -> DataFrame:
    """``word`` (hash) and ``c`` of all tokens, the end token included; combined in each worker and again before the shuffle."""

    def run(batches):
        words_of = Words()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        raw: list[np.ndarray] = []

        def fold():
            if raw:
                held.append(np.unique(np.concatenate(raw), return_counts=True))
                raw.clear()
            if len(held) > 1:
                words, inverse = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
                held[:] = [(words, np.bincount(inverse, weights=np.concatenate([x[1] for x in held]), minlength=len(words)).astype(np.int64))]

        def sent():
            fold()
            words, counts = held.pop() if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], names=["word", "c"])

        for batch in batches:
            for part in sliced(batch, PART_BYTES):
                raw.append(tokens_of(words_of, as_bytes(part.column(0)))[0])
                if sum(map(len, raw)) > COUNTED:
                    fold()
                    if len(held[0][0]) > COUNTED:
                        yield sent()
        yield sent()
        held.clear()
        release()

    small_batches(docs.sparkSession)
    return docs.select(F.col(text).alias("text")).mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Frame:
    """What every worker knows of the corpus: the counts of the frequent words, the members of all factors and their shares."""

    def __init__(self, distinct: int, words: np.ndarray, counts: np.ndarray, shared: np.ndarray | None):
        """``words`` and ``counts``: the frequent words, most frequent first; ``shared``: by the ``shared_bits`` high bits of the hash, the sum of c + 1 over all words."""
        self.levels = levels_for(distinct)
        members = FAN**self.levels
        own = min(len(words), members - members // 4)
        self.member = np.where(np.arange(len(words)) < own, dealt(np.arange(len(words)), self.levels), self.shared_member(words))
        mass = np.zeros(members)
        mass[self.shared_places()] = 1 + (shared if shared is not None else 0)
        np.subtract.at(mass, self.shared_member(words[:own]), counts[:own] + 1.0)
        mass[self.member[:own]] = counts[:own] + 1.0
        self.log_mass = np.log10(np.maximum(mass, 1))
        self.has_own = np.arange(len(words)) < own
        self.shares = []
        for level in range(self.levels):
            inner = mass.reshape(-1, FAN ** (self.levels - 1 - level)).sum(axis=1).reshape(-1, FAN)
            with np.errstate(divide="ignore", invalid="ignore"):
                self.shares.append(np.nan_to_num(np.maximum(np.log(inner / inner.sum(axis=1, keepdims=True)), LEAST_LOG), nan=-np.log(FAN)).astype(np.float32))
        self.bits = int(np.clip(np.ceil(np.log2(max(distinct, 1))), *ROW_BITS))
        order = np.argsort(words)
        self.words, self.counts, self.member, self.has_own = words[order], counts[order], self.member[order], self.has_own[order]
        # The last word of each short hash, and the short hashes that several words share.
        short = self.short(self.words)
        self.spot = np.zeros(1 << SPOTS, np.int32)
        self.spot[short] = np.arange(len(short))
        self.several = np.bincount(short, minlength=1 << SPOTS) > 1

    def shared_bits(self) -> int:
        return bits_of(FAN**self.levels // 4)

    def shared_member(self, hashes: np.ndarray) -> np.ndarray:
        return dealt(FAN**self.levels * 3 // 4 + (hashes >> np.uint64(64 - self.shared_bits())).astype(np.int64), self.levels)

    def shared_places(self) -> np.ndarray:
        return dealt(np.arange(FAN**self.levels * 3 // 4, FAN**self.levels), self.levels)

    def at(self, hashes: np.ndarray) -> np.ndarray:
        """Index in the frequent words, -1 for others."""
        if not len(self.words):
            return np.full(len(hashes), -1)
        short = self.short(hashes)
        i = self.spot[short].astype(np.int64)
        again = np.flatnonzero(self.several[short])
        i[again] = np.minimum(np.searchsorted(self.words, hashes[again]), len(self.words) - 1)
        i[self.words[i] != hashes] = -1
        return i

    @staticmethod
    def short(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - SPOTS)).astype(np.int64)

    def members_at(self, found: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return self.shared_member(hashes)
        out = self.member[found]
        rest = np.flatnonzero(found < 0)
        out[rest] = self.shared_member(hashes[rest])
        return out

    def rows(self) -> int:
        return self.levels << self.bits


def bits_of(n: int) -> int:
    return n.bit_length() - 1


def levels_for(distinct: int) -> int:
    """Factors by which three quarters of the members hold all words, at most ``LEVELS``."""
    n = 1
    while n < LEVELS and distinct > FAN**n * 3 // 4:
        n += 1
    return n


def dealt(places: np.ndarray, levels: int) -> np.ndarray:
    """Members by rank: neighbours in rank lie in different classes, those a class-width apart in different subclasses."""
    out = np.zeros_like(places)
    for _ in range(levels):
        out, places = out * FAN + places % FAN, places // FAN
    return out


def features(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of each context feature of each token; ``first``: where texts begin."""
    one = np.concatenate(([BEFORE], hashes[:-1]))
    one[first] = BEFORE
    two = np.concatenate(([BEFORE], one[:-1]))
    two[first] = BEFORE
    one, two = mixed(one), mixed(two * np.uint64(3))
    return np.stack((mixed(one ^ MARKS[0]), mixed((one + two * np.uint64(5)) ^ MARKS[1]), mixed(two ^ MARKS[2])))


class Steps:
    """Tokens of texts in steps of bounded size: per step the index of its frequent words, members, path, nodes, rows and features."""

    def __init__(self, frame: Frame):
        self.frame, self.words = frame, Words()

    def texts(self, texts: list[bytes | None]):
        """(hashes, number of tokens of each text) of all."""
        return tokens_of(self.words, texts)

    def over(self, hashes: np.ndarray, n: np.ndarray):
        """For each step: its place, how many tokens before it are context only, and the parts of its tokens."""
        frame, starts = self.frame, np.cumsum(n) - n
        for at in range(0, len(hashes), STEP_TOKENS):
            low, high = max(0, at - 2), min(len(hashes), at + STEP_TOKENS)
            first = starts[np.searchsorted(starts, low) : np.searchsorted(starts, high)] - low
            mine = hashes[low:high]
            context = features(mine, first)[:, at - low :]
            mine = mine[at - low :]
            found = frame.at(mine)
            member = frame.members_at(found, mine)
            path, node, rows = [], [], []
            for level in range(frame.levels):
                below = bits_of(FAN) * (frame.levels - 1 - level)
                inner = member >> below
                path.append(inner & (FAN - 1))
                node.append(inner >> bits_of(FAN))
                own = frame.bits - bits_of(FAN) * level
                spread = mixed(context + FACTORS[level]) >> np.uint64(64 - own)
                rows.append((level << frame.bits) + (node[-1] << own) + spread.astype(np.int64))
            yield at, high, found, member, path, node, rows, context


class Softmax:
    """Shares of the members of a factor in batches of tokens; reuses its memory."""

    def __init__(self, frame: Frame, weights: np.ndarray):
        self.frame, self.weights = frame, weights
        self.out, self.more = (np.empty((STEP_TOKENS, FAN), np.float32) for _ in range(2))
        self.ones, self.place = np.ones(FAN, np.float32), np.arange(STEP_TOKENS)

    def __call__(self, level: int, node: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exponentials of the logits, and their sums."""
        out, more = self.out[: len(node)], self.more[: len(node)]
        np.take(self.frame.shares[level], node, axis=0, out=out, mode="clip")
        for r in rows:
            np.take(self.weights, r, axis=0, out=more, mode="clip")
            out += more
        np.exp(out, out=out)
        return out, out @ self.ones


def stepped(observed: np.ndarray, expected: np.ndarray, rate: float, prior: float) -> np.ndarray:
    """The step of weights with a gradient of ``observed`` - ``expected``, divided by its curvature in logarithms."""
    return rate * np.log((observed + prior) / (expected + prior))


def shares_of_rows(frame: Frame, piece: int) -> np.ndarray:
    """For each row of a piece the shares of the members of its class in the corpus."""
    rows = np.arange(piece * PIECE_ROWS, (piece + 1) * PIECE_ROWS)
    level = int(rows[0] >> frame.bits)
    return np.exp(frame.shares[level][(rows & ((1 << frame.bits) - 1)) >> (frame.bits - bits_of(FAN) * level)].astype(float))


def pieces(kind: int, counts: np.ndarray):
    """The counts of a worker as record batches: a byte a cell, and a list of the cells above that."""
    width = PIECE_ROWS * FAN
    for i in range(len(counts) // width):
        part = counts[i * width : (i + 1) * width]
        if part.any():
            high = np.flatnonzero(part > 255)
            more = np.stack((high, part[high])).astype(np.int64).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([kind], pa.int32()), pa.array([np.minimum(part, 255).astype(np.uint8).tobytes()], pa.binary()), pa.array([more], pa.binary())], names=["piece", "kind", "counts", "high"])


def trained(docs: DataFrame, text: str, salt: tuple[str, ...], frame, weights) -> np.ndarray:
    """Weights (``rows``, ``FAN``) after the step of a round; ``weights``: a broadcast table, or None for zeros.

    Workers send counts by pieces of rows; each piece is added up and stepped in one task.  What the model
    expects is drawn for a token by its context, its place in the text and the columns ``salt``.
    """

    def run(batches):
        know = frame.value
        steps, size = Steps(know), know.rows() * FAN
        seen = np.zeros(size, np.uint32)
        drawn = None if weights is None else np.zeros(size, np.uint32)
        softmax = None if weights is None else Softmax(know, weights.value.astype(np.float32))
        one = np.uint32(1)
        for part in (x for batch in batches for x in sliced(batch, PART_BYTES)):
            hashes, n = steps.texts(as_bytes(part.column(0)))
            salted = np.repeat(part.column(1).to_numpy().view(np.uint64), n) + (np.arange(len(hashes)) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64) * MARKS[0]
            for at, high, _, _, path, node, rows, context in steps.over(hashes, n):
                for level in range(know.levels):
                    cells = rows[level] * FAN
                    for r in cells:
                        np.add.at(seen, r + path[level], one)
                    if softmax is not None:
                        p, total = softmax(level, node[level], rows[level])
                        chance = (mixed(mixed(context[1] + salted[at:high]) ^ FACTORS[level]) >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24)
                        member = np.minimum((np.cumsum(p, axis=1, out=p) < (chance * total)[:, None]).sum(axis=1), FAN - 1)
                        for r in cells:
                            np.add.at(drawn, r + member, one)
        yield from pieces(0, seen)
        if drawn is not None:
            yield from pieces(1, drawn)
        seen = drawn = softmax = None
        release()

    def step(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i, kind, counts, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total = sums.setdefault((i, kind), np.zeros(PIECE_ROWS * FAN))
                total += np.frombuffer(counts, np.uint8)
                at, n = np.frombuffer(high, np.int64).reshape(2, -1)
                total[at] += n - 255
        know = frame.value
        for i in sorted({i for i, _ in sums}):
            seen = sums.get((i, 0), np.zeros(PIECE_ROWS * FAN)).reshape(-1, FAN)
            if weights is None:
                moved = stepped(seen, seen.sum(axis=1, keepdims=True) * shares_of_rows(know, i), RATE, PRIOR)
            else:
                drawn = sums.get((i, 1), np.zeros(PIECE_ROWS * FAN)).reshape(-1, FAN)
                moved = weights.value[i * PIECE_ROWS : (i + 1) * PIECE_ROWS].astype(float) + stepped(seen, drawn, LATER_RATE, LATER_PRIOR)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.clip(moved, -MOST, MOST).astype(np.float16).tobytes()], pa.binary())], names=["piece", "weights"])

    small_batches(docs.sparkSession)
    sent = docs.select(F.col(text).alias("text"), (F.xxhash64(*salt) if salt else F.lit(0).cast("long")).alias("salt")).mapInArrow(run, "piece int, kind int, counts binary, high binary")
    got = sent.repartition("piece").mapInArrow(step, "piece int, weights binary").collect()
    out = np.zeros((frame.value.rows(), FAN), np.float16) if weights is None else weights.value.copy()
    for r in got:
        out[r.piece * PIECE_ROWS : (r.piece + 1) * PIECE_ROWS] = np.frombuffer(r.weights, np.float16).reshape(-1, FAN)
    del got
    release()
    return out


def scored(rows: DataFrame, keep: tuple[str, ...], frame, weights) -> DataFrame:
    """``keep`` with ``n_tokens``, ``head_known`` and ``head_log`` (frequent tokens and the sum of log10(c + 1) over them), ``part`` (the
    log10 probability, but for log10(c + 1) of words beyond the frequent) and ``rare``, the hashes of those."""
    kinds = rows.select(*keep).schema

    def start():
        know = frame.value
        steps, softmax = Steps(know), Softmax(know, weights.value.astype(np.float32))
        logs = np.append(np.log10(know.counts + 1.0), 0.0)
        # What a word's share within its member needs: nothing for words of their own.
        inner = np.append(np.where(know.has_own, 0.0, logs[:-1] - know.log_mass[know.member]), 0.0)

        def step(batch):
            hashes, n = steps.texts(as_bytes(batch.column(len(keep))))
            value, log = np.empty(len(hashes)), np.empty(len(hashes))
            known = np.empty(len(hashes), bool)
            for at, high, found, member, path, node, chosen, _ in steps.over(hashes, n):
                place = softmax.place[: high - at]
                v = inner[found] - np.where(found < 0, know.log_mass[member], 0.0)
                for level in range(know.levels):
                    p, total = softmax(level, node[level], chosen[level])
                    v += np.log10(np.maximum(p[place, path[level]], np.float32(1e-30)) / total)
                value[at:high], log[at:high], known[at:high] = v, logs[found], found >= 0
            stops = np.cumsum(n)
            starts = stops - n
            rare = np.flatnonzero(~known)
            cuts = np.searchsorted(rare, np.append(starts, len(hashes)))
            beyond = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(hashes[rare].view(np.int64)))
            sums = lambda x: np.add.reduceat(x, starts) if len(starts) else x
            return {f.name: batch.column(i) for i, f in enumerate(kinds)} | {"n_tokens": n, "head_known": sums(known.astype(np.int64)), "head_log": sums(log), "part": sums(value), "rare": beyond}

        return step

    more = {"n_tokens": "long", "head_known": "long", "head_log": "double", "part": "double", "rare": "array<long>"}
    return arrow_map(rows, start, with_columns(kinds, **more), slice_bytes=PART_BYTES)


def framed(counts: DataFrame) -> tuple[Frame, int, int, int | None]:
    """The frame of a table of counts, the numbers of tokens and of distinct words, and the least count of the frequent words (None: none is)."""
    level = F.floor(F.log2(F.col("c")) * 16).cast("int")
    levels = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.sum("c").alias("tokens"), F.min("c").alias("least")).collect()
    total, distinct = sum(r.tokens for r in levels), sum(r.words for r in levels)
    least, taken = None, 0
    for r in sorted(levels, key=lambda r: -r.level):
        taken += r.words
        if taken > HEAD_WORDS:
            break
        least = r.least
    head = counts.where(F.col("c") >= least).toArrow() if least is not None else None
    words = head.column("word").to_numpy().view(np.uint64) if head is not None else np.zeros(0, np.uint64)
    c = head.column("c").to_numpy() if head is not None else np.zeros(0, np.int64)
    order = np.lexsort((words, -c))
    bits = bits_of(FAN ** levels_for(distinct) // 4)
    shared = np.zeros(1 << bits)
    for r in counts.groupBy(F.shiftrightunsigned("word", 64 - bits).alias("at")).agg(F.sum(F.col("c") + 1).alias("n")).collect():
        shared[r["at"]] = r["n"]
    return Frame(distinct, words[order], c[order], shared), total, distinct, least


def lm_scores(docs: DataFrame, train: str = "pmod(crc32(coalesce(cast(doc_id as string), '')), 7) <> 2", text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: ``keep``, ``held_out`` (not in the training rows, those of the condition ``train``), ``n_tokens``,
    ``n_known``, ``train_tokens``, ``base_score`` (add-one unigram) and ``score`` (the model's log10 probability of the text).

    Tokens are the words without ASCII white space, A-Z lower-cased, and one end; a null or empty text is the
    end alone.  Words are told apart by 64-bit hash.  An empty training set leaves all tokens unknown.
    The counts of words beyond the frequent ones stay distributed and meet the texts in a join.
    Counts and every round of training are over all training rows.
    """
    spark = docs.sparkSession
    learned = docs.where(train)
    counts = staged(counted(learned, text))
    know, total, distinct, least = framed(counts)
    frame = spark.sparkContext.broadcast(know)
    release()
    weights = None
    for _ in range(ROUNDS if total else 0):
        before, weights = weights, spark.sparkContext.broadcast(trained(learned, text, keep, frame, weights))
        if before is not None:
            before.destroy()
    weights = weights or spark.sparkContext.broadcast(np.zeros((know.rows(), FAN), np.float16))
    rows = docs.select(*keep, F.expr(f"not coalesce({train}, false)").alias("held_out"), F.col(text).alias("__text"))
    parts = staged(scored(rows, (*keep, "held_out"), frame, weights).withColumn("__row", F.monotonically_increasing_id()))
    rare = counts.where(F.col("c") < least) if least is not None else counts
    met = parts.select("__row", F.explode("rare").alias("word")).join(rare, "word")
    sums = met.groupBy("__row").agg(F.count("*").alias("__known"), F.sum(F.log10(F.col("c") + 1)).alias("__log"))
    joined = parts.drop("rare").join(sums, "__row", "left")
    log = F.coalesce("__log", F.lit(0.0))
    return joined.select(
        *keep,
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("__known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("head_log") + log - F.col("n_tokens") * float(np.log10(total + distinct + 1))).alias("base_score"),
        (F.col("part") + log).alias("score"),
    )

"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated models, of toxic and of ordinary documents, give each token a probability:

    p(word | before) = max(c(before, word) - D, 0) / c(before) + left(before) * p(word)
    p(word)          = max(n(word) - D', 0) / n + left * p(stem) * shared(word | stem)
    p(stem)          = max(n(stem) - D'', 0) / n + left * shared(stem)

with counts c of word pairs, continuation counts n (kinds of pairs that end so), absolute
discounts, and ``left`` the share that the discounts of a class took away, so that all
of them add up to one.  The last levels are counts that both classes share: what is rare in either
says little about a class.  The discounts grow with the square root of the sample, as chance differences of counts do,
which would else outweigh a few toxic expressions.

A passage is ``PASSAGE`` consecutive tokens.  The score is a logistic curve over the greatest difference
of the passages' length-normalised log-likelihoods and over the logarithm of the text's length (more
passages have a greater maximum by chance), fitted to the training rows, each read by models of the
other ``FOLDS - 1`` parts of them.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged
from .text import STEP, Words, arrow_map, as_bytes, mixed, with_columns

#: Most documents of each class, and most bytes of their texts, that the models learn from (chosen by hash where there are more).
SAMPLE, SAMPLE_BYTES = 20_000, 64 << 20
#: Parts of the training rows, each of which is left out once.
FOLDS = 4
#: Bytes of a stem, the least discount, and those of pairs, words and stems by the square root of the number of kinds of pairs in the lesser class.
STEM, LEAST_DISCOUNT, DISCOUNTS = 5, 0.75, (0.05, 0.008, 0.04)
#: Tokens of a passage, tokens that are looked up at once, and weight of the penalty on the curve's slopes.
PASSAGE, STEP_TOKENS, PENALTY = 2, 1 << 15, 1e-4
START = np.uint64(0x51ED270B5A1F2C37)
#: Count that shared expressions have besides their own, seen or not.
ADDED = 0.5


def tokens_of(texts: list, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, of the words before them and of their stems (32 bits), and the number of words of each text."""
    w, s, n = words.of(texts)
    s = (s >> np.uint64(32)).astype(np.uint32).view(np.int32)
    u = np.concatenate(([START], w[:-1])) if len(w) else w
    u[(np.cumsum(n) - n)[n > 0]] = START
    return w, u, s, n


def pair_hash(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mixed(u * STEP + w)


def pair_counts(rows: DataFrame) -> DataFrame:
    """``u``, ``w``, ``stem`` and per fold k the counts ``t{k}`` and ``o{k}`` of the word pairs of toxic and ordinary texts."""

    def start():
        words = Words(alnum=True, stem=STEM)

        def step(batch):
            w, u, s, n = tokens_of(as_bytes(batch.column(1)), words)
            return {"part": np.repeat(batch.column(0).to_numpy(), n), "u": u.view(np.int64), "w": w.view(np.int64), "stem": s}

        return step

    part = (F.col("fold") * 2 + F.col("toxic").cast("int")).alias("part")
    sums = [F.count_if(F.col("part") == 2 * k + x).cast("int").alias(f"{'ot'[x]}{k}") for k in range(FOLDS) for x in (0, 1)]
    return arrow_map(rows.select(part, "text"), start, "part int, u long, w long, stem int").groupBy("u", "w", "stem").agg(*sums)


def tables_of(counts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pair counts, and the continuation counts of words and of stems, as ``t``, ``o`` of all folds and ``t{k}``, ``o{k}`` of all but one; each is shuffled once for all models."""
    total = {x: sum((F.col(f"{x}{k}") for k in range(1, FOLDS)), F.col(f"{x}0")) for x in "to"}
    pairs = staged(counts).withColumns({x: v for x, v in total.items()} | {f"{x}{k}": v - F.col(f"{x}{k}") for x, v in total.items() for k in range(FOLDS)})
    names = [f"{x}{k}" for k in ("", *range(FOLDS)) for x in "to"]
    words = staged(pairs.groupBy("w", "stem").agg(*[F.count_if(F.col(c) > 0).cast("int").alias(c) for c in names]))
    kept = [F.count_if(F.col(f"t{k}") + F.col(f"o{k}") > 0).alias(f"words{k}") for k in ("", *range(FOLDS))]
    return pairs, words, staged(words.groupBy("stem").agg(*[F.sum(c).alias(c) for c in names], *kept))


class Table:
    """Sorted hashes with a few numbers each; zeros for hashes that aren't held."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.vstack((values[order], np.zeros((1, values.shape[1]))))

    def at(self, hashes: np.ndarray) -> np.ndarray:
        i = np.searchsorted(self.keys, hashes)
        i[i == len(self.keys)] = 0
        i[self.keys[i] != hashes if len(self.keys) else slice(None)] = -1
        return self.values[i]


class Models:
    """Both classes' models.

    Held are the expressions with a count above the discount in a class, and the words and stems at the end of such ones.
    All others add the same factor to both classes' probabilities, so that leaving them out changes no difference.
    """

    def __init__(self, kinds, discounts, left_words, left_stems, stems, words: Table, stem_table: Table, pairs: Table, contexts: Table):
        self.kinds, self.discounts = np.asarray(kinds, float), discounts
        self.left_words, self.left_stems = (np.where(self.kinds > 0, np.asarray(x, float) / np.maximum(self.kinds, 1), 1.0) for x in (left_words, left_stems))
        self.n_stems = stems
        self.words, self.stems, self.pairs, self.contexts = words, stem_table, pairs, contexts

    def probabilities(self, w: np.ndarray, u: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Of each token by both classes (toxic, ordinary)."""
        of_pairs, of_words, of_stems = self.discounts
        of_stem, of_word = self.stems.at(s), self.words.at(w)
        both_stem, both_word = of_stem[:, :2].sum(axis=1), of_word.sum(axis=1)
        per = np.maximum(self.kinds, 1)
        shared = (both_stem + ADDED) / (self.kinds.sum() + ADDED * (self.n_stems + 1))
        within = (both_word + ADDED) / (both_stem + ADDED * (of_stem[:, 2] + 1))
        p = np.maximum(of_stem[:, :2] - of_stems, 0) / per + self.left_stems * shared[:, None]
        p = np.maximum(of_word - of_words, 0) / per + self.left_words * p * within[:, None]
        context = self.contexts.at(u)
        met = np.flatnonzero(context.any(axis=1))
        if len(met):
            count, left = context[met, :2], context[met, 2:]
            pair = np.maximum(self.pairs.at(pair_hash(u[met], w[met])) - of_pairs, 0)
            seen = count > 0
            count = np.maximum(count, 1)
            p[met] = np.where(seen, pair / count + left / count * p[met], p[met])
        return p

    def features(self, w, u, s, n) -> np.ndarray:
        """Greatest difference of the passages' log-likelihoods per token, and logarithm of 1 + n, of each text; zeros for no words."""
        out = np.column_stack((np.zeros(len(n)), np.log1p(n)))
        if not len(w):
            return out
        value = np.empty(len(w))
        for at in range(0, len(w), STEP_TOKENS):
            cut = slice(at, at + STEP_TOKENS)
            logs = np.log(self.probabilities(w[cut], u[cut], s[cut]))
            value[cut] = logs[:, 0] - logs[:, 1]
        some = np.flatnonzero(n > 0)
        starts = (np.cumsum(n) - n)[some]
        total = np.concatenate(([0.0], np.cumsum(value)))
        # A passage at the end of a text begins early enough; a shorter text is one passage.
        size = np.minimum(PASSAGE, np.repeat(n[some], n[some]))
        stop = np.minimum(np.arange(len(w)) + size, np.repeat(starts + n[some], n[some]))
        out[some, 0] = np.maximum.reduceat((total[stop] - total[stop - size]) / size, starts)
        return out


def discounts_of(kinds: int) -> list[float]:
    return [max(LEAST_DISCOUNT, x * kinds**0.5) for x in DISCOUNTS]


def model_of(tables: tuple[DataFrame, DataFrame, DataFrame], without: int | None = None) -> Models:
    """The models of all folds but one.  What is collected is bounded by the sample: a held expression has more counts than its discount."""
    suffix = "" if without is None else str(without)
    pairs, words, stems = (x.select(*keys, *[F.col(f"{c}{suffix}").alias(c) for c in columns]) for x, keys, columns in zip(tables, (("u", "w"), ("w", "stem"), ("stem",)), ("to", "to", ("t", "o", "words")), strict=True))
    pairs, words, stems = (x.where("t + o > 0") for x in (pairs, words, stems))
    kinds = words.agg(F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("o"), F.lit(0))).first()
    discounts = of_pairs, of_words, of_stems = discounts_of(min(kinds))
    high = lambda least: F.greatest("t", "o") > least
    taken = lambda k, least: F.least(F.col(k).cast("double"), F.lit(least))
    held = pairs.where(high(of_pairs))
    left = lambda table, least: table.agg(*[F.coalesce(F.sum(taken(k, least)), F.lit(0.0)) for k in "to"], F.count("*")).first()
    left_words, left_stems = left(words, of_words), left(stems, of_stems)
    ends = held.select("w").distinct()
    held_words = staged(words.join(ends, "w", "left_semi").unionByName(words.where(high(of_words)).join(ends, "w", "left_anti")))
    bases = held_words.select("stem").distinct()
    held_stems = stems.join(bases, "stem", "left_semi").unionByName(stems.where(high(of_stems)).join(bases, "stem", "left_anti"))
    contexts = pairs.join(held.select("u").distinct(), "u", "left_semi").groupBy("u").agg(*[F.sum(k).alias(k) for k in "to"], *[F.sum(taken(k, of_pairs)).alias(f"left_{k}") for k in "to"])

    def table(df: DataFrame, key: str, *columns: str) -> Table:
        got = df.select(key, *columns).toArrow()
        keys = got.column(key).to_numpy()
        return Table(keys.view(np.uint64) if keys.dtype == np.int64 else keys, np.column_stack([got.column(c).to_numpy() for c in columns]).astype(float))

    got = held.select("u", "w", "t", "o").toArrow()
    u, w = (got.column(c).to_numpy().view(np.uint64) for c in "uw")
    pair_table = Table(pair_hash(u, w), np.column_stack([got.column(c).to_numpy() for c in "to"]).astype(float))
    return Models(
        kinds,
        discounts,
        left_words[:2],
        left_stems[:2],
        left_stems[2],
        table(held_words, "w", "t", "o"),
        table(held_stems, "stem", "t", "o", "words"),
        pair_table,
        table(contexts, "u", "t", "o", "left_t", "left_o"),
    )


def featured(rows: DataFrame, keep: tuple[str, ...], models) -> DataFrame:
    kinds = rows.select(*keep).schema

    def start():
        words, know = Words(alnum=True, stem=STEM), models.value

        def step(batch):
            x = know.features(*tokens_of(as_bytes(batch.column(len(keep))), words))
            return {f.name: batch.column(i) for i, f in enumerate(kinds)} | {"passage": x[:, 0], "length": x[:, 1]}

        return step

    return arrow_map(rows.select(*keep, "text"), start, with_columns(kinds, passage="double", length="double"), slice_bytes=1 << 20)


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, scales and coefficients (the last: intercept) of a penalised logistic curve, classes weighted equally."""
    k = x.shape[1]
    if not len(y) or y.min() == y.max():
        return np.zeros(k), np.ones(k), np.append(np.zeros(k), 6.0 * (2 * y.mean() - 1) if len(y) else -6.0)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    b = np.zeros(k + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        gradient = z.T @ (weight * (p - y)) + PENALTY * np.append(b[:k], 0)
        curve = (z * (weight * p * (1 - p))[:, None]).T @ z + PENALTY * np.diag(np.append(np.ones(k), 1e-3))
        step = np.linalg.solve(curve, gradient)
        b -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, b


def training_rows(docs: DataFrame, labels: DataFrame, held_out: str, text: str, sample: int, sample_bytes: int) -> DataFrame:
    """``text``, ``toxic`` and ``fold`` of distinct labelled texts, about ``sample`` and ``sample_bytes`` of each class at most."""
    marked = labels.where(f"not {held_out}").where("toxic is not null and doc_id is not null").select("doc_id", (F.col("toxic") == 1).alias("toxic")).distinct()

    def share(found: dict, most: int):
        return F.coalesce(*[F.when(F.col("toxic") == k, F.lit(min(1.0, most / max(n, 1)))) for k, n in found.items()], F.lit(1.0)) * float(1 << 30)

    found = {r[0]: r[1] for r in marked.groupBy("toxic").count().collect()}
    chosen = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share(found, sample))
    texts = staged(docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "toxic").distinct())
    sizes = {r[0]: r[1] for r in texts.groupBy("toxic").agg(F.sum(F.octet_length("text"))).collect()}
    place = F.xxhash64("text", F.lit(1))
    return texts.where(F.pmod(place, F.lit(1 << 30)) < share(sizes, sample_bytes)).withColumn("fold", F.pmod(F.shiftright(place, 32), F.lit(FOLDS)).cast("int"))


def toxicity_scores(docs: DataFrame, labels: DataFrame, held_out: str = "pmod(crc32(coalesce(cast(doc_id as string), '')), 5) = 0", text: str = "text", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """Per row: ``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from a score of 0.5).

    Labels of rows that meet ``held_out`` are not used.  The models learn from up to about ``sample`` distinct
    texts, and ``sample_bytes`` of them, of each class; all other rows are only scored.  Scores depend on the text alone.  Null
    and empty texts count as texts without evidence.  Without labels of both classes all scores are near the
    one class, or 0.
    """
    spark = docs.sparkSession
    train = training_rows(docs, labels, held_out, text, sample, sample_bytes)
    tables = tables_of(pair_counts(train))
    fitted = None
    for k in range(FOLDS):
        without = spark.sparkContext.broadcast(model_of(tables, k))
        part = featured(train.where(F.col("fold") == k), ("toxic",), without)
        fitted = part if fitted is None else fitted.unionByName(part)
    curve = np.array(fitted.collect(), float).reshape(-1, 3)
    mean, scale, b = logistic(curve[:, 1:], curve[:, 0])
    shared = spark.sparkContext.broadcast(model_of(tables))
    rows = featured(docs.select("doc_id", F.expr(held_out).alias("held_out"), F.col(text).alias("text")), ("doc_id", "held_out"), shared)
    logit = F.lit(float(b[-1]))
    for name, m, s, x in zip(("passage", "length"), mean, scale, b, strict=False):
        logit = logit + (F.col(name) - float(m)) / float(s) * float(x)
    score = F.lit(1.0) / (1 + F.exp(-F.least(F.greatest(logit, F.lit(-30.0)), F.lit(30.0))))
    return rows.select("doc_id", "held_out", score.alias("score")).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))

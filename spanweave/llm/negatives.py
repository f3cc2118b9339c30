"""Hard negatives by dual-tree search over inner products.

A tree of balls is fitted to a bounded sample; every row goes to one of its leaves.  The anchors and the candidates each have
the tree with their own counts and radii.  The inner products of two balls lie in the interval

    <a, c> +- (|a| s + |c| r + r s)

of their centres a, c and radii r, s, so a pair of nodes none of whose products any anchor of the one still looks
for is left with everything below it: whole groups of anchors at once.  Leaf pairs that remain are scored exactly.

What an anchor looks for are windows of scores.  It first searches its own leaf; where it finds enough there, the least of them raises
the window's lower end, by which the second search prunes.  Leaves with many candidates are cut into blocks and their anchors into parts.
"""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .near import grouped
from .staging import staged
from .text import arrow_map, release, small_batches

#: The sample that the tree is fitted to (rows, bytes), leaves and bytes of the tree's centres at most, and rows that a leaf should have.
SAMPLE, SAMPLE_BYTES, LEAVES, TREE_BYTES, LEAF_ROWS = 20_000, 32 << 20, 1024, 16 << 20, 1024
#: Candidates of a block and anchors of a part; scores computed at once.
BLOCK_ROWS, PART_ROWS, SCORES = 65_536, 65_536, 1 << 21
LEAST, MOST = -(1 << 63), (1 << 63) - 1


class Tree:
    """Centres of a binary tree of 2-means splits; node 0 is the root, ``left`` and ``right`` are -1 at leaves."""

    def __init__(self, points: np.ndarray, leaves: int):
        self.center, self.left, self.right = [points.mean(axis=0)], [-1], [-1]
        heap = [(-len(points), 0, np.arange(len(points)))]
        while len(heap) < leaves:
            size, node, rows = heapq.heappop(heap)
            sides = self.split(points[rows]) if size < -1 else None
            if sides is None:
                heapq.heappush(heap, (0, node, rows))
                if not heap[0][0]:
                    break
                continue
            self.left[node], self.right[node] = len(self.center), len(self.center) + 1
            right, *centers = sides
            for side, center in zip((~right, right), centers, strict=True):
                heapq.heappush(heap, (-int(side.sum()), len(self.center), rows[side]))
                self.center.append(center)
                self.left.append(-1)
                self.right.append(-1)
        self.center, self.left, self.right = np.array(self.center), np.array(self.left), np.array(self.right)
        self.norm = np.linalg.norm(self.center, axis=1)

    @staticmethod
    def split(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Whether each point goes right, and the two centres that say so; None for points that are all equal."""
        far = lambda x: points[int(((points - x) ** 2).sum(axis=1).argmax())]
        one = far(points.mean(axis=0))
        two = far(one)
        for step in range(4):
            sides = points @ (two - one) > ((two**2).sum() - (one**2).sum()) / 2
            if sides.all() or not sides.any():
                return None
            if step < 3:
                one, two = points[~sides].mean(axis=0), points[sides].mean(axis=0)
        return sides, one, two

    def leaf(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each point and its distance from the leaf's centre."""
        at = np.zeros(len(points), np.int64)
        todo = np.arange(len(points)) if self.left[0] >= 0 else np.zeros(0, np.int64)
        while len(todo):
            for node in np.unique(at[todo]):
                rows = todo[at[todo] == node]
                one, two = self.center[self.left[node]], self.center[self.right[node]]
                right = points[rows] @ (two - one) > ((two**2).sum() - (one**2).sum()) / 2
                at[rows] = np.where(right, self.right[node], self.left[node])
            todo = todo[self.left[at[todo]] >= 0]
        return at, np.linalg.norm(points - self.center[at], axis=1)

    def upwards(self, leaves: dict[int, tuple], of_none: tuple, fold) -> np.ndarray:
        """Values of all nodes from those of the leaves: a node's is ``fold(node, left, value, right, value)``."""
        value = [leaves.get(x, of_none) for x in range(len(self.left))]
        for x in range(len(self.left) - 1, -1, -1):
            if self.left[x] >= 0:
                value[x] = fold(x, self.left[x], value[self.left[x]], self.right[x], value[self.right[x]])
        return np.array(value, np.float64)

    def radii(self, leaves: dict[int, float]) -> np.ndarray:
        """The radius of each node that holds the balls of its children; negative for nodes without rows."""
        reach = lambda x, child, r: r if r < 0 else float(np.linalg.norm(self.center[x] - self.center[child])) + r
        return self.upwards(leaves, -1.0, lambda x, a, r, b, s: max(reach(x, a, r), reach(x, b, s)))

    def interval(self, a: np.ndarray, r: np.ndarray, c: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bounds of the inner products of nodes ``a`` with radii ``r`` and ``c`` with radii ``s``, with room for rounding."""
        middle = (self.center[a] * self.center[c]).sum(axis=1)
        spread = self.norm[a] * s + self.norm[c] * r + r * s
        spread += 1 + 1e-9 * (np.abs(middle) + spread)
        # Scores end at the bounds of a long, as what is looked for does.
        return np.clip(middle - spread, LEAST, MOST), np.clip(middle + spread, LEAST, MOST)

    def pairs(self, anchors: dict[int, tuple[float, float, float]], candidates: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of an anchor leaf (radius, least and greatest score that it looks for) and a candidate leaf (radius) that may hold a wanted score."""
        r, s = self.radii({k: v[0] for k, v in anchors.items()}), self.radii(candidates)
        low = self.upwards({k: v[1] for k, v in anchors.items()}, np.inf, lambda x, a, u, b, v: min(u, v))
        high = self.upwards({k: v[2] for k, v in anchors.items()}, -np.inf, lambda x, a, u, b, v: max(u, v))
        found = []
        a = c = np.zeros(1, np.int64)
        while len(a):
            keep = (r[a] >= 0) & (s[c] >= 0)
            a, c = a[keep], c[keep]
            least, most = self.interval(a, r[a], c, s[c])
            keep = (most >= low[a]) & (least <= high[a])
            a, c = a[keep], c[keep]
            inner_a, inner_c = self.left[a] >= 0, self.left[c] >= 0
            found.append((a[~inner_a & ~inner_c], c[~inner_a & ~inner_c]))
            # Of two inner nodes the wider one is opened.
            first = inner_a & (~inner_c | (r[a] >= s[c]))
            second = inner_c & ~first
            a, c = (
                np.concatenate((self.left[a[first]], self.right[a[first]], a[second], a[second])),
                np.concatenate((c[first], c[first], self.left[c[second]], self.right[c[second]])),
            )
        return tuple(np.concatenate([x[i] for x in found]) for i in (0, 1)) if found else (a, c)


class Scale:
    """How vectors are stored and multiplied: width, type of a component, and whether products are exact as doubles or longs."""

    def __init__(self, width: int, largest: int):
        self.width = width
        self.kind = np.dtype("<i2" if largest < 1 << 15 else "<i4" if largest < 1 << 31 else "<i8")
        bound = largest * largest * max(width, 1)
        self.product = np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object

    def stored(self, vectors: pa.Array, scale: float) -> np.ndarray:
        """Floors of scaled components, rows padded with 0 to the full width."""
        sizes = np.asarray(vectors.value_lengths().fill_null(0), np.int64)
        flat = np.floor(scale * np.asarray(vectors.flatten(), np.float64))
        whole = np.clip(flat, LEAST, 2.0**62).astype(np.int64)
        large = flat > 2.0**62
        whole[large] = [min(int(x), MOST) for x in flat[large]]
        out = np.zeros((len(sizes), self.width), np.int64)
        out[np.arange(self.width) < sizes[:, None]] = whole
        return out.astype(self.kind)

    def loaded(self, rows: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(rows), self.kind).reshape(len(rows), self.width).astype(self.product)

    def products(self, a: np.ndarray, c: np.ndarray) -> np.ndarray:
        out = a @ c.T if self.width else np.zeros((len(a), len(c)))
        return np.array([[min(max(int(x), LEAST), MOST) for x in row] for row in out], np.int64).reshape(out.shape) if self.product is object else out


def usable(df: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """``id``, ``label`` and ``v`` of the rows that take part; of rows that share an id the one of the least (label, vector)."""
    v = F.col(embedding)
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = df.select(F.col(vec_id).alias("id"), F.col(label).alias("label"), v.cast("array<double>").alias("v")).where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & v.isNotNull() & finite)
    return rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v")


def placed(rows: DataFrame, tree: Tree, scale: Scale, factor: float) -> DataFrame:
    """``id``, ``label``, ``q`` (the stored vector), ``leaf`` and ``away``, the distance from its centre."""

    def start():
        def step(batch):
            q = scale.stored(batch.column(2), factor)
            leaf, away = tree.leaf(q.astype(np.float64))
            return {"id": batch.column(0), "label": batch.column(1), "q": [x.tobytes() for x in q], "leaf": leaf, "away": away}

        return step

    kinds = dict(rows.dtypes)
    return arrow_map(rows.select("id", "label", "v"), start, f"id {kinds['id']}, label {kinds['label']}, q binary, leaf long, away double")


def fitted(rows: DataFrame, factor: float) -> tuple[Tree, Scale] | None:
    """The tree over the rows with the least hashes of their ids, and the scale; None without rows."""
    size = F.aggregate("v", F.lit(0.0), lambda most, x: F.greatest(most, F.abs(x)))
    n, width, largest = rows.agg(F.count("*"), F.max(F.size("v")), F.max(size)).first()
    if not n:
        return None
    scale = Scale(width, min(int(factor * largest) + 1, 1 << 63))
    most = max(2, min(SAMPLE, SAMPLE_BYTES // (8 * max(width, 1))))
    sample = rows.select("v", F.xxhash64("id").alias("h")).orderBy("h", "v").limit(most).collect()
    points = np.zeros((len(sample), width))
    for row, x in zip(points, sample, strict=True):
        row[: len(x.v)] = np.floor(factor * np.array(x.v, np.float64))
    leaves = max(1, min(n // LEAF_ROWS, LEAVES, TREE_BYTES // (16 * max(width, 1))))
    return Tree(points, leaves), scale


def searched(asks: DataFrame, points: DataFrame, pairs: tuple[np.ndarray, np.ndarray], tree: Tree, scale: Scale, k: int, same: bool) -> DataFrame:
    """``anchor``, ``w``, ``id`` and ``score``: the first ``k`` of each window of each anchor (``asks``) in each block of the leaves that it is paired with.

    ``same``: whether candidates have the anchor's label, or another.
    """
    spark = asks.sparkSession
    small_batches(spark)
    held = {r.leaf: r.n for r in points.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    wanted = {r.leaf: r.n for r in asks.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    met: dict[int, list[int]] = {}
    load: dict[int, int] = {}
    for a, c in zip(*(x.tolist() for x in pairs), strict=True):
        met.setdefault(a, []).append(c)
        load[c] = load.get(c, 0) + wanted[a]
    cut = {c: (-(-held[c] // BLOCK_ROWS), -(-n // PART_ROWS)) for c, n in load.items()}
    # At most LEAVES rows, of at most LEAVES leaves each.
    leaves = F.broadcast(spark.createDataFrame([(c, *x) for c, x in cut.items()], "leaf long, blocks long, parts long"))
    others = F.broadcast(spark.createDataFrame([(a, [(c, *cut[c]) for c in x]) for a, x in met.items()], "leaf long, to array<struct<leaf long, blocks long, parts long>>"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    none = F.lit(None).cast("array<long>")
    told = points.join(leaves, "leaf").select("leaf", F.pmod(F.xxhash64("id"), "blocks").alias("block"), each(F.col("parts")).alias("part"), F.lit(False).alias("asks"), "id", "label", "q", none.alias("low"), none.alias("high"))
    asked = asks.join(others, "leaf").select("id", "label", "q", "low", "high", F.explode("to").alias("to"))
    asked = asked.select(F.col("to.leaf").alias("leaf"), each(F.col("to.blocks")).alias("block"), F.pmod(F.xxhash64("id"), F.col("to.parts")).alias("part"), F.lit(True).alias("asks"), "id", "label", "q", "low", "high")
    both = told.unionByName(asked).repartition("leaf", "block", "part").sortWithinPartitions("leaf", "block", "part", "asks", "id")
    kind = dict(points.dtypes)["id"]
    radius = {r.leaf: r.away for r in points.groupBy("leaf").agg(F.max("away").alias("away")).collect()}

    def run(batches):
        for group in grouped(batches, 3):
            found = best(group, tree, radius, scale, k, same)
            if found is not None:
                yield found
        release()

    return both.mapInArrow(run, f"anchor {kind}, w int, id {kind}, score long")


def best(group: pa.Table, tree: Tree, radius: dict[int, float], scale: Scale, k: int, same: bool) -> pa.RecordBatch | None:
    """A block's candidates (in the order of their ids), then the anchors of a part: the first ``k`` of each window."""
    asks = group.column(3).to_numpy()
    n = int(np.searchsorted(asks, True))
    if n == len(asks) or not n:
        return None
    ids, labels = (np.asarray(group.column(i).to_pylist()) for i in (4, 5))
    low, high = (group.column(i).slice(n).to_pylist() for i in (7, 8))
    vectors = group.column(6).to_pylist()
    candidates = scale.loaded(vectors[:n])
    leaf = group.column(0)[0].as_py()
    found = []
    for at in range(n, len(asks), max(1, SCORES // n)):
        rows = np.arange(at, min(at + max(1, SCORES // n), len(asks)))
        anchors = scale.loaded([vectors[i] for i in rows])
        # The ball of this leaf as a single anchor sees it.
        exact = anchors.astype(np.float64)
        middle, spread = exact @ tree.center[leaf], np.linalg.norm(exact, axis=1) * radius[leaf]
        spread += 1 + 1e-9 * (np.abs(middle) + spread)
        lows, highs = np.array([min(low[i - n]) for i in rows], np.float64), np.array([max(high[i - n]) for i in rows], np.float64)
        keep = np.flatnonzero((np.clip(middle + spread, LEAST, MOST) >= lows) & (np.clip(middle - spread, LEAST, MOST) <= highs))
        for i, scores in zip(rows[keep], scale.products(anchors[keep], candidates), strict=True):
            fits = (labels[:n] == labels[i]) == same
            fits &= (ids[:n] != ids[i]) & (scores >= min(low[i - n])) & (scores <= max(high[i - n]))
            fits = np.flatnonzero(fits)
            for w, (x, y) in enumerate(zip(low[i - n], high[i - n], strict=True)):
                own = fits[(scores[fits] >= x) & (scores[fits] <= y)]
                if len(own) > 8 * k:
                    own = own[scores[own] >= np.partition(scores[own], len(own) - k)[len(own) - k]]
                for j in own[np.argsort(-scores[own], kind="stable")[:k]]:
                    found.append((i, w, j, int(scores[j])))
    if not found:
        return None
    take = lambda x: group.column(4).take(pa.array([r[x] for r in found])).combine_chunks()
    return pa.RecordBatch.from_arrays([take(0), pa.array([r[1] for r in found], pa.int32()), take(2), pa.array([r[3] for r in found], pa.int64())], names=["anchor", "w", "id", "score"])


def first(found: DataFrame, k: int) -> DataFrame:
    """``found`` with ``rank``, of each window of an anchor the first ``k``: at most ``k`` a block were found, so no window is large."""
    order = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def dual_search(asks: DataFrame, points: DataFrame, tree: Tree, scale: Scale, k: int, same: bool) -> DataFrame:
    """The first ``k`` candidates of each window: ``anchor``, ``w``, ``id``, ``score`` and ``rank``."""
    radius = {r.leaf: r.away for r in points.groupBy("leaf").agg(F.max("away").alias("away")).collect()}
    own = np.array(sorted({r.leaf for r in asks.select("leaf").distinct().collect()} & radius.keys()), np.int64)
    near = staged(first(searched(asks, points, (own, own), tree, scale, k, same), k))
    floors = near.groupBy("anchor", "w").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") == k)
    floors = floors.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("w", "floor"))).alias("floors"))
    raised = F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("floors", i), x)))
    now = staged(asks.join(floors.withColumnRenamed("anchor", "id"), "id", "left").withColumn("low", raised).drop("floors"))
    groups = now.groupBy("leaf").agg(F.max("away").alias("away"), F.min(F.array_min("low")).alias("low"), F.max(F.array_max("high")).alias("high")).collect()
    a, c = tree.pairs({r.leaf: (r.away, float(r.low), float(r.high)) for r in groups}, radius)
    far = searched(now, points, (a[a != c], c[a != c]), tree, scale, k, same)
    return first(near.drop("rank").unionByName(far), k)


def hard_negatives(df: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100, factor: float = 256.0, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and ``negative_score``.

    Scores are inner products of ``floor(factor * component)``.  The rows that meet ``anchors`` (a condition on the columns of ``df``) ask.  An
    anchor's positives are its first ``positives`` other rows of the same label; for each of them, the negatives are the first ``negatives`` rows of
    other labels with ``least <= 100 * negative_score / positive_score <= most``.  Higher scores come first, ties by id.

    Rows with a null id, label or vector, or a null or non-finite component take no part.  Of rows that share an id, that with the least
    (label, vector) counts, so repeated rows change nothing.  Shorter vectors count as ended by zeros.  Scores beyond a long count as the nearest
    long.  Anchors without positives, and positives without negatives, have no row; nor has an empty table.
    """
    kinds = dict(df.dtypes)
    names = f"anchor_id {kinds[vec_id]}, positive_id {kinds[vec_id]}, rank int, negative_id {kinds[vec_id]}, positive_score long, negative_score long"
    asking = df.where(anchors & F.col(vec_id).isNotNull()).select(F.col(vec_id).alias("id")).distinct()
    rows = staged(usable(df, vec_id, embedding, label))
    model = fitted(rows, factor)
    if model is None:
        return df.sparkSession.createDataFrame([], names)
    tree, scale = model
    points = staged(placed(rows, tree, scale, factor))
    wide = lambda x: F.array(F.lit(x).cast("long"))
    asks = staged(points.join(asking, "id").withColumns({"low": wide(LEAST), "high": wide(MOST)}))
    near = staged(dual_search(asks, points, tree, scale, positives, True))
    exact = F.col("score").cast("decimal(20,0)")
    low, high = F.ceil(exact * least / 100).cast("long"), F.floor(exact * most / 100).cast("long")
    windows = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", low.alias("low"), high.alias("high")))).alias("w"))
    wanted = staged(asks.drop("low", "high").join(windows.select(F.col("anchor").alias("id"), "w.low", "w.high"), "id"))
    found = dual_search(wanted, points, tree, scale, negatives, False)
    of = near.select("anchor", (F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = found.join(of, ["anchor", "w"])
    return named.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

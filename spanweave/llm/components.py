"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is an aggregation to the least neighbour and a join with it, so a
hub's edges are combined before the shuffle and a hot key can be split.  The
edges of each round are written to the shared folder, which bounds the lineage.
"""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged

#: Nodes whose forest one worker builds at once (about 50 MB).
LOCAL_NODES = 250_000


def forest(edges: DataFrame) -> DataFrame:
    """Within each partition, edges as stars: each node and the least node that its edges there reach."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches):
        parent: dict = {}

        def root(x):
            top = x
            while (up := parent.setdefault(top, top)) != top:
                top = up
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        def stars():
            rows = [(x, root(x)) for x in parent]
            rows = [x for x in rows if x[0] != x[1]]
            parent.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], like.column(i).type) for i in (0, 1)], names=["a", "b"])

        like = None
        for like in batches:
            for x, y in zip(like.column(0).to_pylist(), like.column(1).to_pylist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            if len(parent) > LOCAL_NODES:
                yield stars()
        if like is not None:
            yield stars()

    return edges.select("a", "b").mapInArrow(run, f"a {kind}, b {kind}")


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, the least node that it reaches, for every node of the edges (a, b).

    Edges with a null end or from a node to itself are left out; a node that has no other edge
    has no row.  Repeated edges change nothing.
    """
    valid = edges.select("a", "b").where("a <> b")
    now = staged(forest(valid).distinct())
    before = None
    while True:
        size = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if size == before or not size[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = size
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = staged(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())

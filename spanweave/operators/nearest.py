"""k nearest intervals, by the positions around each interval."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import SPEC, Spec, carrying, framed, same_groups
from ..plans.binning import range_join
from ..plans.prefix import Stretches
from .joins import OTHER

DIRECTIONS = ("any", "forward", "backward")


@carrying
def nearest(a: DataFrame, b: DataFrame, spec: Spec = SPEC, other: Spec = OTHER, k: int = 1, slack: int = 0, include_overlaps: bool = True, direction: str = "any") -> DataFrame:
    """``idx``, ``idx2`` and ``distance`` of the right intervals at the ``k`` least distances from each left one, ties included.

    Overlapping intervals have distance 0, touching ones 1.  ``direction``: right intervals after the left one
    (forward), before it (backward) or both; overlaps count in every direction unless left out.  ``slack`` moves the left
    interval back.

    One order of all positions: each left interval takes the last ``k`` distinct ends up to its start and the next ``k`` distinct
    starts from its end as two short arrays, and from counts whether it overlaps any.  These fix its ``k`` distances, and an
    equi-join on (group, position) finds the right intervals there, never all pairs of a group.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction is one of {DIRECTIONS}")
    same_groups(spec, other)
    x = framed(a, spec).select("g", "i", (F.col("s") - slack).alias("s"), (F.col("e") - slack).alias("e"))
    y = framed(b, other).select("g", F.col("i").alias("i2"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    # Ends come before the questions of their position (0), starts after them (2).
    edges = y.select("g", "i2", F.inline(F.array(F.struct(F.col("e2").alias("p"), F.lit(0).alias("o")), F.struct(F.col("s2").alias("p"), F.lit(2).alias("o")))))
    arounds = _around(x, edges, k)
    back, forth = (F.transform(c, lambda p: F.struct(p.alias("p"), F.lit(o).alias("o"), d(p).alias("distance"))) for c, o, d in (("back", 0, lambda p: F.col("s") - p + 1), ("forth", 2, lambda p: p - F.col("e") + 1)))
    sides = {"forward": [forth], "backward": [back], "any": [back, forth]}[direction]
    seen = F.concat(*[F.coalesce(c, F.array().cast("array<struct<p:long,o:int,distance:long>>")) for c in sides])
    zero = F.when(F.col("met"), F.array(F.lit(0).cast("long"))) if include_overlaps else F.lit(None).cast("array<long>")
    distances = F.slice(F.array_sort(F.array_distinct(F.concat(F.transform("seen", lambda c: c["distance"]), F.coalesce(zero, F.array().cast("array<long>"))))), 1, k)
    kept = arounds.withColumn("seen", seen).withColumn("distances", distances)
    wanted = kept.select("g", "i", F.inline(F.filter("seen", lambda c: F.array_contains("distances", c["distance"]))))
    found = wanted.join(edges, ["g", "p", "o"]).select("i", "i2", "distance")
    if include_overlaps:
        met = range_join(x, y, ("s", "e"), ("s2", "e2"), (F.col("s") < F.col("e2")) & (F.col("s2") < F.col("e")))
        found = found.unionByName(met.select("i", "i2", F.lit(0).cast("long").alias("distance")))
    return found.select(F.col("i").alias("idx"), F.col("i2").alias("idx2"), "distance")


def _around(x: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """Left rows (g, i, s, e) with the last ``k`` distinct ends up to their start (``back``), the next ``k`` distinct starts from their end (``forth``), nearest first, and whether they meet a right row (``met``)."""
    none = F.lit(None).cast("long")
    spots = edges.groupBy("g", "p", "o").agg(F.count("*").alias("n"))
    lined = Stretches(spots.select(F.struct("g", "o").alias("g"), "p", "n"), "p")
    # Each spot with those before it among the ends, and those after it among the starts.
    near = lined.df.withColumn("__0", F.col("p"))
    for j in range(1, k):
        near = lined.running(near, "near", F.col(f"__{j - 1}"), "__back")
        near = lined.running(near, "near", F.col(f"__{j - 1}"), "__forth", after=True)
        near = near.withColumn(f"__{j}", F.when(F.col("g.o") == 0, F.col("__back")).otherwise(F.col("__forth"))).drop("__back", "__forth")
    told = near.select(F.col("g.g").alias("g"), "p", F.col("g.o").alias("o"), "n", F.array_compact(F.array(*[f"__{j}" for j in range(k)])).alias("near"))
    asked = x.select("g", "i", "s", "e", F.inline(F.array(F.struct(F.col("s").alias("p"), F.lit(True).alias("first")), F.struct(F.col("e").alias("p"), F.lit(False).alias("first")))), F.lit(1).alias("o"), F.xxhash64("i").alias("t"))
    asked = asked.withColumns({"n": none, "near": F.lit(None).cast("array<long>")})
    told = told.withColumns({"i": F.lit(None).cast(x.schema["i"].dataType), "s": none, "e": none, "first": F.lit(None).cast("boolean"), "t": none})
    laid = Stretches(asked.unionByName(told), "p", "o", "t", "first")
    rows = laid.running(laid.df, "near", F.when(F.col("o") == 0, F.col("near")), "back")
    rows = laid.running(rows, "sum", F.when(F.col("o") == 0, F.col("n")), "ends")
    rows = laid.running(rows, "sum", F.when(F.col("o") == 2, F.col("n")), "starts")
    rows = laid.running(rows, "near", F.when(F.col("o") == 2, F.col("near")), "forth", after=True)
    own = lambda c, first: F.max(F.when(F.col("first") == first, F.col(c)))
    met = F.coalesce(own("starts", False), F.lit(0)) > F.coalesce(own("ends", True), F.lit(0))
    return rows.where("o = 1").groupBy("g", "i", "s", "e").agg(own("back", True).alias("back"), own("forth", False).alias("forth"), met.alias("met"))

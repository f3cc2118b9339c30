"""Operators that cut, move or bound single intervals."""

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import SPEC, Spec, carrying, floor_div, framed
from ..plans.prefix import Stretches


@carrying
def tile(df: DataFrame, size: int, spec: Spec = SPEC) -> DataFrame:
    """Tiles of a global grid that each interval meets, not clipped: ``idx``, ``start``, ``end`` and ``fraction``, the covered share of the tile."""
    if size <= 0:
        raise ValueError("size is above 0")
    rows = framed(df, _present(df, spec))
    each = rows.withColumn("j", F.explode(F.sequence(floor_div(F.col("s"), size), floor_div(F.col("e") - 1, size)))).withColumn("start", F.col("j") * size)
    end = F.col("start") + size
    shared = F.least(end, F.col("e")) - F.greatest("start", "s")
    return each.select(F.col("i").alias("idx"), "start", end.alias("end"), (shared / F.lit(float(size))).alias("fraction"))


@carrying
def window(df: DataFrame, size: int, spec: Spec = SPEC) -> DataFrame:
    """Pieces of each interval cut at multiples of ``size`` along the joined lengths of its run: ``idx``, ``start``, ``end``.

    A run is a stretch of rows of one group in the order of ``idx``, each strand for itself; without group columns every row is
    one.  Lengths are counted from the first row on the plus strand (false), and so that the last window
    is whole on the minus strand (true).  ``idx`` is a whole number.
    """
    if size <= 0:
        raise ValueError("size is above 0")
    strand = F.coalesce(F.col(spec.strand), F.lit(False)) if spec.strand else F.lit(False)
    rows = framed(df, spec, neg=strand, n=F.col(spec.idx).cast("long"))
    if spec.by:
        line = Stretches(rows.select(F.lit(0).alias("g"), F.col("g").alias("own"), "i", "s", "e", "neg", "n"), "n")
        before = line.running(line.df, "max", F.struct("n", "own"), "last")
        change = F.when(F.col("last").isNull() | (F.col("last.own") != F.col("own")), 1).otherwise(0)
        runs = line.running(before.withColumn("change", change), "sum", F.col("change"), "run", inclusive=True)
    else:
        runs = rows.withColumn("run", F.col("n"))
    laid = Stretches(runs.select(F.struct("run", "neg").alias("g"), "i", "s", "e", "neg", "n"), "n")
    length = F.col("e") - F.col("s")
    placed = laid.running(laid.df, "sum", length, "c0")
    totals = runs.groupBy(F.struct("run", "neg").alias("g")).agg(F.sum(length).alias("total"))
    joined = placed.join(totals, "g").withColumn("p0", F.coalesce("c0", F.lit(0)) - F.when(F.col("neg"), F.col("total") % size).otherwise(0))
    p1 = F.col("p0") + length
    each = joined.withColumn("j", F.explode(F.sequence(floor_div(F.col("p0"), size), floor_div(p1 - 1, size))))
    shift = F.col("s") - F.col("p0")
    return each.select(
        F.col("i").alias("idx"),
        (F.greatest("p0", F.col("j") * size) + shift).alias("start"),
        (F.least(F.col("p0") + length, (F.col("j") + 1) * size) + shift).alias("end"),
    )


@carrying
def extend(df: DataFrame, ext_3: int = 0, ext_5: int = 0, spec: Spec = SPEC) -> DataFrame:
    """All rows as ``idx``, ``start``, ``end``, with each group's least start and greatest end moved out.

    The first row with the least start gives the strand: on plus (false) the start moves by ``ext_5`` and the end by ``ext_3``,
    on minus the other way round.
    """
    strand = F.coalesce(F.col(spec.strand), F.lit(False)) if spec.strand else F.lit(False)
    rows = framed(df, spec, degenerate=True, neg=strand)
    edges = rows.groupBy("g").agg(
        F.min_by(F.struct("i", "neg"), F.struct("s", "i")).alias("low"),
        F.min_by("i", F.struct(-F.col("e"), F.col("i"))).alias("high"),
    )
    back, forth = (F.when(F.col("low.neg"), x).otherwise(y) for x, y in ((ext_3, ext_5), (ext_5, ext_3)))
    joined = rows.join(edges, "g")
    return joined.select(
        F.col("i").alias("idx"),
        (F.col("s") - F.when(F.col("i") == F.col("low.i"), back).otherwise(0)).alias("start"),
        (F.col("e") + F.when(F.col("i") == F.col("high"), forth).otherwise(0)).alias("end"),
    )


@carrying
def genome_bounds(df: DataFrame, length: str, clip: bool = False, only_right: bool = False, spec: Spec = SPEC) -> DataFrame:
    """``idx``, ``start``, ``end`` of the rows within ``[0, length)`` (a column), or with ``clip`` their parts within it.

    ``only_right`` looks at the right bound alone.  Rows with a null length, and parts that are empty, are left out.
    """
    rows = framed(df, _present(df, spec), n=F.col(length).cast("long")).select(F.col("i").alias("idx"), F.col("s").alias("start"), F.col("e").alias("end"), "n")
    if not clip:
        return rows.where("end <= n" if only_right else "end <= n and start >= 0").drop("n")
    inside = rows.where("start < n" if only_right else "start < n and end > 0")
    low = F.col("start") if only_right else F.greatest("start", F.lit(0).cast("long"))
    return inside.select("idx", low.alias("start"), F.least("end", "n").alias("end")).where("start < end")


def _present(df: DataFrame, spec: Spec) -> Spec:
    """``spec`` with the group columns that ``df`` has, for operators that need no groups but leave out rows without one."""
    return replace(spec, by=tuple(c for c in spec.by if c in df.columns))

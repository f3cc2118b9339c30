"""Islands of overlapping intervals, and what is built on them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import SPEC, Spec, carrying, framed, ungrouped
from ..plans.prefix import Stretches, before_groups


def islands(rows: DataFrame, slack: int = 0) -> tuple[DataFrame, Stretches]:
    """``rows`` (i, g, s, e) with ``island``, numbered from 1 in each group, and how they were laid; an island begins where a start is at or past the running end plus ``slack``."""
    laid = Stretches(rows, "s", "e", "i")
    reach = laid.running(laid.df, "max", F.col("e"), "reach")
    opens = F.when(F.col("reach").isNull() | (F.col("s") >= F.col("reach") + slack), 1).otherwise(0)
    return laid.running(reach.withColumn("opens", opens), "sum", F.col("opens"), "island", inclusive=True).select("i", "g", "s", "e", "island"), laid


def merged(rows: DataFrame, slack: int = 0) -> DataFrame:
    """One row per island: ``g``, ``i`` (of the greatest (end, id)), ``s``, ``e``, ``count``."""
    return (
        islands(rows, slack)[0]
        .groupBy("g", "island")
        .agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("count"), F.max_by("i", F.struct("e", "i")).alias("i"))
        .select("g", "i", "s", "e", "count")
    )


@carrying
def merge(df: DataFrame, spec: Spec = SPEC, slack: int = 0) -> DataFrame:
    """Islands as ``idx``, ``start``, ``end`` and ``count``; touching intervals stay apart at slack 0, and gaps below ``slack`` close."""
    return merged(framed(df, spec), slack).select(F.col("i").alias("idx"), F.col("s").alias("start"), F.col("e").alias("end"), "count")


@carrying
def cluster(df: DataFrame, spec: Spec = SPEC, slack: int = 0) -> DataFrame:
    """``cluster_id`` and ``idx``: islands numbered over the ordered groups from 0, one number left out at each change of group."""
    found, laid = islands(framed(df, spec), slack)
    # One row per group: its islands and the gap before it.
    base = before_groups(found.groupBy("g").agg(F.max("island").alias("n")), laid.groups, base=F.col("n") + 1).drop("n")
    return found.join(base, "g").select((F.col("base") + F.col("island") - 1).alias("cluster_id"), F.col("i").alias("idx"))


@carrying
def boundary(df: DataFrame, spec: Spec = SPEC) -> DataFrame:
    """Per group ``idx`` (of the greatest (end, id)), ``start``, ``end`` and ``count``."""
    rows = framed(df, spec)
    return rows.groupBy("g").agg(F.max_by("i", F.struct("e", "i")).alias("idx"), F.min("s").alias("start"), F.max("e").alias("end"), F.count("*").alias("count")).select("idx", "start", "end", "count")


def complement(df: DataFrame, lengths: DataFrame | None = None, spec: Spec = SPEC, length: str = "length", slack: int = 0, include_first: bool = False) -> DataFrame:
    """Gaps between the islands of each group as its group columns, ``start``, ``end`` and ``idx``.

    ``lengths`` has a row of ``length`` for each group that is to have a gap after its last island (of several the
    greatest counts); ``include_first`` adds the gap from 0.  A gap begins ``slack`` past an island; empty ones are left out.
    ``idx`` is 0 for gaps of the first group and else the id of the first interval of the group.
    """
    rows = framed(df, spec)
    joined = merged(rows, slack)
    laid = Stretches(joined, "s", like=rows)
    after = laid.running(laid.df, "min", F.col("s"), "next", after=True)
    first = rows.groupBy("g").agg(F.min_by("i", F.struct("s", "i")).alias("i"), F.min("s").alias("low"))
    least = rows.agg(F.min("g").alias("__least"))
    named = first.crossJoin(F.broadcast(least)).select("g", F.when(F.col("g") == F.col("__least"), F.lit(0).cast(rows.schema["i"].dataType)).otherwise(F.col("i")).alias("idx"), "low")
    if lengths is not None:
        ends = lengths.select(spec.group().alias("g"), F.col(length).cast("long").alias("length")).groupBy("g").agg(F.max("length").alias("length"))
        after = after.join(ends, "g", "left")
    else:
        after = after.withColumn("length", F.lit(None).cast("long"))
    gaps = after.select("g", (F.col("e") + slack).alias("start"), F.coalesce("next", "length").alias("end"))
    if include_first:
        gaps = gaps.unionByName(named.where("low > 0").select("g", F.lit(0).cast("long").alias("start"), F.col("low").alias("end")))
    return ungrouped(gaps.where("start < end").join(named.drop("low"), "g"), spec, "start", "end", "idx")

"""Coordinates along the joined intervals of a group."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import signed
from ..model import SPEC, Spec, carrying, framed
from ..plans.binning import range_join
from ..plans.prefix import Stretches

@carrying
def group_cumsum(df: DataFrame, spec: Spec = SPEC, sort: bool | None = None) -> DataFrame:
    """``idx`` with the lengths of its group before (``start``) and with it (``end``).

    Rows with a true ``spec.strand`` (all, without one) are walked by ascending start, others by descending start.
    ``sort`` orders the result by id, false by group in walking order, and by default it has no order.
    """
    up = F.coalesce(F.col(spec.strand), F.lit(True)) if spec.strand else F.lit(True)
    rows = framed(df, spec, degenerate=True, up=up).withColumn("key", signed(F.col("up"), F.col("s")))
    laid = Stretches(rows, "key", "i")
    length = F.abs(F.col("e") - F.col("s"))
    done = laid.running(laid.df, "sum", length, "end", inclusive=True)
    out = done if sort is None else done.orderBy("i") if sort else done.orderBy("g", "key", "i")
    return out.select(F.col("i").alias("idx"), (F.col("end") - length).alias("start"), "end")


@carrying
def spliced_subsequence(df: DataFrame, start: int | str = 0, end: int | str | None = None, force_plus: bool = False, spec: Spec = SPEC) -> DataFrame:
    """What is left of each interval within ``[start, end)`` along the joined intervals of its group: ``idx``, ``start``, ``end``.

    Bounds are numbers or columns (the first row of the group in walking order counts); negative ones count from the
    joined length, a missing end is that length.  A true ``spec.strand`` is plus: minus rows are walked first and from
    the right.  ``force_plus`` trims minus rows as if they were plus.
    """
    up = F.coalesce(F.col(spec.strand), F.lit(True)) if spec.strand else F.lit(True)
    value = lambda x: F.col(x).cast("long") if isinstance(x, str) else F.lit(x).cast("long")
    rows = framed(df, spec, up=up, low=value(start), high=value(end))
    rows = rows.withColumn("pos", signed(F.col("up"), F.col("s"))).withColumn("key_e", signed(F.col("up"), F.col("e")))
    length = F.col("e") - F.col("s")
    # Each strand of a group is walked for itself; what the minus rows have comes before the plus rows.
    laid = Stretches(rows.withColumn("g", F.struct(F.col("g").alias("own"), "up")), "pos", "key_e", "i")
    placed = laid.running(laid.df, "sum", length, "part", inclusive=True).withColumn("g", F.col("g.own"))
    whole = rows.groupBy("g").agg(
        F.sum(length).alias("total"),
        F.coalesce(F.sum(F.when(~F.col("up"), length)), F.lit(0)).alias("minus"),
        F.min_by(F.struct("low", "high"), F.struct("up", "pos", "key_e", "i")).alias("slice"),
    )
    joined = placed.drop("low", "high").join(whole, "g").withColumn("upto", F.col("part") + F.when(F.col("up"), F.col("minus")).otherwise(0))
    bound = lambda x: F.when(x < 0, F.col("total") + x).otherwise(x)
    left = F.greatest(bound(F.col("slice.low")) - (F.col("upto") - length), F.lit(0).cast("long"))
    right = F.greatest(F.col("upto") - F.coalesce(bound(F.col("slice.high")), F.col("total")), F.lit(0).cast("long"))
    plain = F.lit(True) if force_plus else F.col("up")
    cut = joined.select(
        F.col("i").alias("idx"),
        (F.col("s") + F.when(plain, left).otherwise(right)).alias("start"),
        (F.col("e") - F.when(plain, right).otherwise(left)).alias("end"),
    )
    return cut.where("start < end")


def map_to_global(exons: DataFrame, queries: DataFrame, tx: str = "tx", idx: str = "idx") -> DataFrame:
    """Query ranges in the local coordinates of a transcript as ranges of the genome: ``idx``, ``start``, ``end``, ``strand``.

    ``exons``: ``tx``, local ``ls``, ``le``, genome ``gs``, ``ge`` and ``fwd``; ``queries``: ``idx``, ``tx``, ``qs``, ``qe``, ``fwd``.  One row for each
    exon that a query meets; ``strand`` is true where both run alike.  What lies past the exons is left out.
    """
    x = queries.select(F.col(tx).alias("g"), F.col(idx).alias("i"), F.col("qs").cast("long").alias("qs"), F.col("qe").cast("long").alias("qe"), F.col("fwd").alias("q_fwd")).where("qs < qe")
    y = exons.select(F.col(tx).alias("g"), *[F.col(c).cast("long").alias(c) for c in ("ls", "le", "gs", "ge")], F.col("fwd").alias("x_fwd")).where("ls < le")
    met = range_join(x, y, ("qs", "qe"), ("ls", "le"), (F.col("ls") < F.col("qe")) & (F.col("qs") < F.col("le")))
    one = F.greatest("qs", "ls") - F.col("ls")
    two = F.least("qe", "le") - F.col("ls")
    return met.select(
        F.col("i").alias("idx"),
        F.when(F.col("x_fwd"), F.col("gs") + one).otherwise(F.col("ge") - two).alias("start"),
        F.when(F.col("x_fwd"), F.col("gs") + two).otherwise(F.col("ge") - one).alias("end"),
        (F.col("q_fwd") == F.col("x_fwd")).alias("strand"),
    )

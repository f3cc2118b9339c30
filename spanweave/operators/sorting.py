"""Orders of intervals."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import signed
from ..model import SPEC, Spec, carrying, framed
from ..plans.prefix import placed


@carrying
def sort_intervals(df: DataFrame, spec: Spec = SPEC) -> DataFrame:
    """``idx`` and ``pos``, its place from 0 by group, start, end and id, in that order; rows with a true ``spec.strand`` by descending start and end."""
    return _places(df, spec, False)


@carrying
def sort_groups(df: DataFrame, spec: Spec = SPEC) -> DataFrame:
    """``idx`` and ``pos``, its place from 0 by group, equal groups by id, in that order."""
    return _places(df, spec, True)


@carrying
def sort_positions(df: DataFrame, spec: Spec = SPEC, groups_only: bool = False) -> DataFrame:
    """The rows of ``sort_intervals`` (or ``sort_groups``), for those that need no order of the result."""
    return _places(df, spec, groups_only)


def _places(df: DataFrame, spec: Spec, groups_only: bool) -> DataFrame:
    """One sort of all rows by the whole key, of any types: neither a large group nor many rows at one position are one task."""
    up = ~F.coalesce(F.col(spec.strand), F.lit(False)) if spec.strand else F.lit(True)
    rows = framed(df, spec, degenerate=True, up=up)
    order = ["i"] if groups_only else [signed(F.col("up"), F.col("s")), signed(F.col("up"), F.col("e")), "i"]
    return placed(rows, "g", *order).select(F.col("i").alias("idx"), "pos")

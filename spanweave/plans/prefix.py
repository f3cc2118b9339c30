"""Running values per group that survive a group with most of the rows, and places in one order of all rows.

A plain window sends a whole group to one task.  Where a group has more than ``STRETCH_ROWS``, the rows are dealt by
ranges of (group, order), with splitters that Spark samples over the whole order, which ends in a unique key: a
stretch is what a group has in one range, however many rows share a position.  Each stretch is one window partition, and
what lies before (or after) it comes from a second, small window over one row per stretch.  Without such a group the plan is
a plain window.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import kept

#: Rows of a group from which all rows are dealt into ranges, and rows of a range.
STRETCH_ROWS = 2_000_000
#: Groups (one row each) that one window takes; beyond that they are dealt into ranges of so many.
WINDOW_GROUPS = 1_000_000


class Stretches:
    """``df`` with ``__b``, the range of each row by ``g`` and the columns ``order``, which should tell all rows of a group apart.

    ``like`` has the groups by whose sizes it is decided whether to deal, where ``df`` itself is dear to compute; ``groups`` is
    their number and ``largest`` the size of the largest.  The dealt rows are a checkpoint, so that all that is made of them sees the same ranges.
    """

    def __init__(self, df: DataFrame, *order: Column | str, like: DataFrame | None = None):
        self.order = [F.col(c) if isinstance(c, str) else c for c in order]
        counts = (df if like is None else like).groupBy("g").agg(F.count("*").alias("__n"))
        zero = lambda x: F.coalesce(x, F.lit(0))
        self.groups, rows, self.largest = counts.agg(F.count("*"), zero(F.sum("__n")), zero(F.max("__n"))).first()
        self.single = self.largest <= STRETCH_ROWS
        self.df = df if self.single else kept(df.repartitionByRange(-(-rows // STRETCH_ROWS), "g", *self.order).withColumn("__b", F.spark_partition_id()))

    def keys(self) -> list[str]:
        return ["g"] if self.single else ["g", "__b"]

    def running(self, df: DataFrame, kind: str, value: Column, name: str, after: bool = False, inclusive: bool = False) -> DataFrame:
        """``df`` with ``name``: the ``kind`` of ``value`` over the rows of the group before each row (or after it), null without any.

        Kinds: ``max``, ``min``, ``sum``, and ``near``, the nearest value that isn't null.
        """
        fold = getattr(F, kind) if kind != "near" else lambda x: F.last(x, ignorenulls=True)
        # What lies after is what lies before in the opposite order: a frame to the end of the partition would be folded anew for each row.
        turned = (lambda c: c.desc()) if after else (lambda c: c)
        upto = lambda w, last: w.rowsBetween(Window.unboundedPreceding, last)
        own = fold(value).over(upto(Window.partitionBy(*self.keys()).orderBy(*[turned(c) for c in self.order]), 0 if inclusive else -1))
        if self.single:
            return df.withColumn(name, own)
        if kind == "near":
            # Of the values that aren't null that of the last row (or first).
            total = (F.min_by if after else F.max_by)(value, F.when(value.isNotNull(), F.struct(*self.order)))
        else:
            total = fold(value)
        side = upto(Window.partitionBy("g").orderBy(turned(F.col("__b"))), -1)
        # A range has one group at most that begins before it (or ends after it), so the carried rows are no more than ranges.
        carry = df.groupBy("g", "__b").agg(total.alias("__t")).select("g", "__b", fold(F.col("__t")).over(side).alias("__carry")).where("__carry is not null")
        both = df.withColumn("__own", own).join(F.broadcast(carry), ["g", "__b"], "left")
        if kind == "sum":
            joined = F.when(F.col("__own").isNull() & F.col("__carry").isNull(), None).otherwise(F.coalesce("__own", F.lit(0)) + F.coalesce("__carry", F.lit(0)))
        elif kind == "near":
            joined = F.coalesce("__own", "__carry")
        else:
            joined = (F.greatest if kind == "max" else F.least)("__own", "__carry")
        return both.withColumn(name, joined).drop("__own", "__carry")


def placed(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` in the order of the columns, which must tell all rows apart, with ``pos``, the place of each row from 0.

    One exchange, by ranges whose splitters Spark samples over all of the order; a row's place is that in its range and
    the rows of the ranges before, of which there are as many as partitions.
    """
    ranged = kept(df.orderBy(*order))
    sizes = ranged.groupBy(F.spark_partition_id().alias("__b")).agg(F.count("*").alias("n"))
    upto = F.coalesce(F.sum("n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # The number of a row in its partition is in the lower 33 bits.
    numbered = ranged.withColumns({"__b": F.spark_partition_id(), "__k": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    return numbered.join(F.broadcast(sizes.select("__b", upto.alias("__upto"))), "__b").withColumn("pos", F.col("__upto") + F.col("__k")).drop("__b", "__k", "__upto")


def before_groups(groups: DataFrame, n: int, **values: Column) -> DataFrame:
    """``groups`` (some ``n`` rows, one per ``g``) with the sums of ``values`` over all groups in front of each, 0 for the first.

    Many groups are dealt into ranges, and each range takes the sums of the ranges before.
    """
    zero = lambda x: F.coalesce(x, F.lit(0).cast("long"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    if n <= WINDOW_GROUPS:
        own = upto(Window.orderBy("g"))
        return groups.withColumns({k: zero(F.sum(v.cast("long")).over(own)) for k, v in values.items()})
    ranged = kept(groups.withColumns({f"__v{k}": v.cast("long") for k, v in values.items()}).repartitionByRange(-(-n // WINDOW_GROUPS), "g").withColumn("__b", F.spark_partition_id()))
    inside = upto(Window.partitionBy("__b").orderBy("g"))
    front = upto(Window.orderBy("__b"))
    sums = ranged.groupBy("__b").agg(*[F.sum(f"__v{k}").alias(f"__sum{k}") for k in values])
    base = sums.select("__b", *[zero(F.sum(f"__sum{k}").over(front)).alias(f"__base{k}") for k in values])
    done = ranged.join(F.broadcast(base), "__b").withColumns({k: zero(F.sum(f"__v{k}").over(inside)) + F.col(f"__base{k}") for k in values})
    return done.select(*groups.columns, *values)

"""Difference, disjoining and greedy selection of intervals."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..model import SPEC, Spec, carrying, framed, same_groups
from ..plans.prefix import Stretches
from ..plans.shared import kept
from .islands import islands
from .joins import OTHER

#: Rows of an island up to which it is folded in one expression.
FOLDED = 256


@carrying
def subtract(a: DataFrame, b: DataFrame, spec: Spec = SPEC, other: Spec = OTHER) -> DataFrame:
    """The maximal pieces of each left interval that no right interval of its group covers: ``idx``, ``start``, ``end``.

    One order of all starts and ends: where the number of open right intervals falls to none a gap begins, and
    running counts number the gaps.  A left row takes the numbers from its start to its end and meets the gaps by them.
    """
    same_groups(spec, other)
    x, y = framed(a, spec), framed(b, other).withColumnRenamed("i", "i2")
    none = F.lit(None).cast(x.schema["i"].dataType).alias("i")
    mark = lambda p, o, d: F.struct(F.col(p).alias("p"), F.lit(o).alias("o"), F.lit(d).alias("d"))
    # At one position: left ends, right ends, left starts, right starts.
    asked = x.select("g", "i", F.xxhash64("i").alias("t"), "s", "e", F.inline(F.array(mark("s", 2, 0), mark("e", 0, 0))))
    missing = F.lit(None).cast("long")
    told = y.select("g", none, F.xxhash64("i2").alias("t"), missing.alias("s"), missing.alias("e"), F.inline(F.array(mark("s", 3, 1), mark("e", 1, -1))))
    laid = Stretches(asked.unionByName(told), "p", "o", "t")
    covered = laid.running(laid.df, "sum", F.col("d"), "cover", inclusive=True)
    closes, opens = (F.col("o") == 1) & (F.col("cover") == 0), (F.col("o") == 3) & (F.col("cover") == 1)
    counted = laid.running(covered.withColumn("closes", closes.cast("int")), "sum", F.col("closes"), "n", inclusive=True)
    # A gap by its number: from where the cover last fell to none to where it begins again.
    gaps = counted.where(closes | opens).groupBy("g", "n").agg(F.max(F.when(F.col("o") == 1, F.col("p"))).alias("after"), F.min(F.when(F.col("o") == 3, F.col("p"))).alias("before"))
    rows = counted.where("i is not null").groupBy("g", "i").agg(F.first("s").alias("s"), F.first("e").alias("e"), F.sequence(F.min("n"), F.max("n")).alias("n"))
    met = rows.withColumn("n", F.explode("n")).join(gaps, ["g", "n"], "left")
    return met.select(F.col("i").alias("idx"), F.greatest("s", "after").alias("start"), F.least("e", "before").alias("end")).where("start < end")


@carrying
def split(df: DataFrame, spec: Spec = SPEC, slack: int = 0, between: bool = False) -> DataFrame:
    """Segments between neighbouring starts and ends of a group that some interval covers, or with ``between`` all of them.

    ``idx`` is the first event at the segment's start: ends before starts, then the least id.  Ends are
    moved by ``slack``.
    """
    rows = framed(df, spec)
    events = rows.select(
        "g",
        F.inline(
            F.array(
                F.struct(F.col("s").alias("p"), F.lit(1).alias("d"), F.struct(F.lit(1).alias("o"), F.col("i").alias("i")).alias("first")),
                F.struct((F.col("e") + slack).alias("p"), F.lit(-1).alias("d"), F.struct(F.lit(0).alias("o"), F.col("i").alias("i")).alias("first")),
            )
        ),
    )
    spots = events.groupBy("g", "p").agg(F.sum("d").alias("d"), F.min("first").alias("first"))
    laid = Stretches(spots, "p")
    covered = laid.running(laid.df, "sum", F.col("d"), "cover", inclusive=True)
    done = laid.running(covered, "min", F.col("p"), "next", after=True).where("next is not null")
    done = done if between else done.where("cover > 0")
    return done.select(F.col("first.i").alias("idx"), F.col("p").alias("start"), F.col("next").alias("end"))


@carrying
def max_disjoint(df: DataFrame, spec: Spec = SPEC, slack: int = 0) -> DataFrame:
    """``idx`` of the intervals that are taken greedily in the order (start, end, id): each that starts more than ``3 * slack`` past the last one taken.

    An interval past all earlier ends by that much is taken whatever came before, so islands are independent.  The rows of a small
    one are folded in order.  In a large one each row points to the first that starts far enough past its end, and
    the chain from the island's first row is marked by doubling the pointers.
    """
    gap = 3 * slack
    rows, _ = islands(framed(df, spec), gap + 1)
    kind = rows.schema["i"].dataType
    sizes = rows.groupBy("g", "island").agg(F.count("*").alias("size"))
    largest = sizes.agg(F.max("size")).first()[0] or 0
    sized = rows if largest <= FOLDED else kept(rows.join(sizes, ["g", "island"]))
    small = sized if largest <= FOLDED else sized.where(F.col("size") <= FOLDED)
    none = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast(ArrayType(kind)).alias("taken"))
    take = lambda acc, x: F.when(acc["last"].isNull() | (x["s"] > acc["last"] + gap), F.struct(x["e"].alias("last"), F.concat(acc["taken"], F.array(x["i"])).alias("taken"))).otherwise(acc)
    ordered = small.groupBy("g", "island").agg(F.array_sort(F.collect_list(F.struct("s", "e", "i"))).alias("rows"))
    folded = ordered.select(F.explode(F.aggregate("rows", none, take, lambda acc: acc["taken"])).alias("idx"))
    if largest <= FOLDED:
        return folded
    return folded.unionByName(_chained(sized.where(F.col("size") > FOLDED), gap).select(F.col("i").alias("idx")))


def _chained(rows: DataFrame, gap: int) -> DataFrame:
    """``i`` of the rows of islands that the chain from the first one meets, in as many rounds as twos make the longest chain."""
    own = rows.select(F.struct("g", "island").alias("g"), "s", "e", "i")
    none = F.lit(None).cast("long").alias("e")
    # Of one position: the rows that start there, then the questions for the first row past it.
    marks = own.select("g", "i", F.col("s").alias("p"), F.lit(0).alias("o"), "e").unionByName(own.select("g", "i", (F.col("e") + gap).alias("p"), F.lit(1).alias("o"), none))
    laid = Stretches(marks, "p", "o", "e", "i")
    counted = laid.running(laid.df, "sum", 1 - F.col("o"), "r", inclusive=True)
    pointed = kept(counted.groupBy("g", "i").agg(F.max(F.when(F.col("o") == 0, F.col("r"))).alias("r"), (F.max(F.when(F.col("o") == 1, F.col("r"))) + 1).alias("next")))
    jumps = pointed.select("g", "r", "next")
    marked = new = kept(pointed.where("r = 1").select("g", "r"))
    while not new.isEmpty():
        # What 2**k steps lead to from the marks of the first 2**k steps; pointers past the island meet no row.
        reached = marked.join(jumps, ["g", "r"]).select("g", F.col("next").alias("r"))
        new = kept(reached.join(pointed.select("g", "r"), ["g", "r"], "left_semi"))
        marked = marked.unionByName(new)
        jumps = kept(jumps.join(jumps.select("g", F.col("r").alias("next"), F.col("next").alias("then")), ["g", "next"]).select("g", "r", F.col("then").alias("next")))
    return pointed.join(marked, ["g", "r"], "left_semi").select("i")

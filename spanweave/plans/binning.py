"""Range joins as equi-joins on bins of several widths.

Every interval has a level by its length: level k spans at most ``SPAN`` bins of
width ``base * SPAN**k``.  It enters the bins of its own level and of each coarser level that the
other side uses, so one very long interval never becomes millions of rows.  A
pair meets at the coarser of its two levels, in the first bin that both enter,
and so exactly once.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import floor_div

SPAN = 64
#: Length up to which levels are made.
MOST_LENGTH = (1 << 63) - 1


def base_width(*lengths: float | None) -> int:
    """The width of the finest bins: the median length, so that most intervals enter one or two."""
    known = [x for x in lengths if x]
    return max(1, int(max(known))) if known else 1


def binned(df: DataFrame, start: str, end: str, base: int, levels: list[int], own: str = "__level", only: Column | None = None) -> DataFrame:
    """``df`` exploded by ``__k`` (level of the bin) and ``__bin``, with its own level and its first bin there as ``__first``.

    ``only``: an array of the levels that rows enter at all, where those aren't the same for all.
    """
    length = F.col(end) - F.col(start)
    level = level_of(length, base, max(levels, default=0))
    widths = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(min(base * SPAN**k, MOST_LENGTH)).cast("long").alias("w")) for k in levels])
    entered = F.filter(widths, lambda x: (x["k"] >= F.col(own)) & (F.lit(True) if only is None else F.array_contains(only, x["k"])))
    used = df.withColumn(own, level).withColumn("__use", F.explode(entered))
    first, last = (floor_div(x, F.col("__use.w")) for x in (F.col(start), F.col(end) - 1))
    return used.select(*df.columns, own, F.col("__use.k").alias("__k"), first.alias("__first"), F.explode(F.sequence(first, last)).alias("__bin"))


def level_of(length: Column, base: int, top: int) -> Column:
    level = F.lit(top)
    for k in range(top - 1, -1, -1):
        level = F.when(length <= min(base * SPAN ** (k + 1), MOST_LENGTH), k).otherwise(level)
    return level


def levels_needed(longest: int, base: int) -> int:
    top = 0
    while longest > base * SPAN ** (top + 1):
        top += 1
    return top


def range_join(a: DataFrame, b: DataFrame, a_range: tuple[str, str], b_range: tuple[str, str], condition: Column, bin_width: int | None = None, extents: tuple | None = None) -> DataFrame:
    """Pairs of rows of equal ``g`` that meet ``condition``, which must imply that the ranges of both overlap.

    ``g`` must be a column of both sides and all other names distinct.  Bounds, a median length and the
    levels in use are read first, in one small aggregation per side (``extents``: their ``extent``, where it is known).
    """
    seen = extents or [extent(x, *r) for x, r in ((a, a_range), (b, b_range))]
    base = bin_width or base_width(*[x.median for x in seen])
    top = levels_needed(max(x.longest or 1 for x in seen), base)
    levels = list(range(top + 1))
    if top:
        own = [set(r[0] for r in x.select(level_of(F.col(r1) - F.col(r0), base, top)).distinct().collect()) for x, (r0, r1) in ((a, a_range), (b, b_range))]
        left = sorted(own[0] | own[1])
        levels = [k for k in left if k >= max(min(own[0], default=0), min(own[1], default=0))]
    return paired(binned(a, *a_range, base, levels, "__level_a"), binned(b, *b_range, base, levels, "__level_b"), condition)


def paired(x: DataFrame, y: DataFrame, condition: Column) -> DataFrame:
    """Pairs of ``binned`` rows (levels as ``__level_a`` and ``__level_b``) that meet ``condition``, each once."""
    x, y = x.withColumnsRenamed({"__first": "__first_a"}), y.withColumnsRenamed({"__first": "__first_b"})
    met = x.join(y, ["g", "__k", "__bin"]).where(
        (F.col("__k") == F.greatest("__level_a", "__level_b")) & (F.col("__bin") == F.greatest("__first_a", "__first_b")) & condition
    )
    return met.drop("__k", "__bin", "__level_a", "__level_b", "__first_a", "__first_b")


def extent(df: DataFrame, start: str, end: str):
    """Number of rows (``n``), least start and greatest end (``low``, ``high``), ``median`` and ``longest`` length."""
    length = F.col(end) - F.col(start)
    return df.agg(F.count("*").alias("n"), F.min(start).alias("low"), F.max(end).alias("high"), F.percentile_approx(length, 0.5, 1000).alias("median"), F.max(length).alias("longest")).first()

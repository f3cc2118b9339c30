"""Overlap joins, their semi and anti forms, and counting without a join."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import contained_either_way, overlap
from ..model import SPEC, Spec, carrying, framed, same_groups
from ..plans.binning import range_join
from ..plans.dyadic import Blocks
from ..plans.prefix import Stretches

OTHER = Spec(idx="idx2", start="s2", end="e2")
MULTIPLE = ("all", "first", "last")


def _sides(a: DataFrame, b: DataFrame, spec: Spec, other: Spec) -> tuple[DataFrame, DataFrame]:
    same_groups(spec, other)
    return framed(a, spec), framed(b, other).withColumnsRenamed({"i": "i2", "s": "s2", "e": "e2"})


def _checked(multiple: str) -> bool:
    """Whether all pairs are wanted."""
    if multiple not in MULTIPLE:
        raise ValueError(f"multiple is one of {MULTIPLE}")
    return multiple == "all"


def _named(pairs: DataFrame, sort_output: bool) -> DataFrame:
    """The pairs' ids; ordered by both if asked for."""
    out = pairs.select(F.col("i").alias("idx"), F.col("i2").alias("idx2"))
    return out.orderBy("idx", "idx2") if sort_output else out


def _one(a: DataFrame, b: DataFrame, last: bool, *searches: tuple[Column, Column, bool]) -> DataFrame:
    """For each left row the right one of the least (``last``: greatest) (start, id) that some search finds: ``i``, ``i2``.

    A search is (v, x, most): with ``most`` the right rows with a start below ``v`` and an end of at least
    ``x``; otherwise those with a start of at least ``v`` and an end of at most ``x``.  A running count gives the
    rank of ``v``, a running greatest (or least) end says whether there is a row at all, and the tree of blocks leads to it.
    """
    found = [_search(a, b, last, *search) for search in searches]
    both = found[0]
    for f in found[1:]:
        both = both.unionByName(f)
    if len(found) > 1:
        both = both.groupBy("i").agg((F.max if last else F.min)("hit").alias("hit"))
    return both.select("i", F.col("hit.i2").alias("i2"))


def _search(a: DataFrame, b: DataFrame, last: bool, v: Column, x: Column, most: bool) -> DataFrame:
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    # Ends at most x come with starts below x, so the last such row is looked for from there.
    place = v if most or not last else F.greatest(v, x)
    asked = a.select("g", "i", place.alias("p"), F.lit(0).alias("o"), F.xxhash64("i").alias("t"), x.alias("x"), v.alias("v"), none(b, "i2"), F.lit(None).cast("long").alias("e"))
    told = b.select("g", none(a, "i"), F.col("s2").alias("p"), F.lit(1).alias("o"), F.lit(0).cast("long").alias("t"), F.lit(None).cast("long").alias("x"), F.lit(None).cast("long").alias("v"), "i2", F.col("e2").alias("e"))
    laid = Stretches(asked.unionByName(told), "p", "o", "t", "i2")
    ranked = laid.running(laid.df, "sum", F.col("o"), "upto", inclusive=True)
    ranked = laid.running(ranked, "max" if most else "min", F.col("e"), "far", after=not most)
    told = ranked.where("o = 1").select("g", (F.col("upto") - 1).alias("r"), "e", F.struct(F.col("p").alias("s2"), "i2").alias("row"))
    asked = ranked.where("o = 0")
    if most:
        asked = asked.where("far >= x")
        rank = F.lit(0).cast("long") if not last else F.col("upto") - 1
    else:
        asked = asked.where("upto > 0") if last else asked.where("far <= x")
        rank = F.col("upto") - 1 if last else F.col("upto")
    blocks = Blocks(told, laid.largest, most, "row")
    met = blocks.found(asked.select("g", "i", "x", "v", rank.alias("r")), ascending=not last, whole=most and not last)
    chosen = met.select("i", "v", F.col("hit.row").alias("hit"))
    return (chosen.where("hit.s2 >= v") if last and not most else chosen).drop("v")


@carrying
def overlaps(a: DataFrame, b: DataFrame, spec: Spec = SPEC, other: Spec = OTHER, multiple: str = "all", contained: bool = False, slack: int = 0, bin_width: int | None = None, sort_output: bool = False) -> DataFrame:
    """Pairs (``idx``, ``idx2``) of overlapping intervals of the same group.

    ``slack`` also takes gaps below it.  ``contained`` takes the pairs whose left interval, wider by
    ``slack`` on both sides, lies in the right one.  ``multiple``: all pairs, or per left row the first or
    last right one by (start, id), which is found without the pairs.  ``sort_output`` orders the rows by both ids.
    """
    x, y = _sides(a, b, spec, other)
    everything = _checked(multiple)
    # Starts that slack moves below 0 count as 0, as the published contract has it; containment isn't clamped.
    low, high = F.col("s") - slack, F.col("e") + slack
    low = low if contained else F.greatest(low, F.lit(0).cast("long"))
    if not everything:
        search = (low + 1, high, True) if contained else (high, low + 1, True)
        return _named(_one(x, y, multiple == "last", search), sort_output)
    wide = x.withColumns({"lo": low, "hi": high})
    condition = (F.col("lo") >= F.col("s2")) & (F.col("hi") <= F.col("e2")) if contained else (F.col("lo") < F.col("e2")) & (F.col("s2") < F.col("hi"))
    wide = wide.withColumns({"from": F.least("lo", F.col("hi") - 1), "to": F.greatest("hi", F.col("lo") + 1)})
    return _named(range_join(wide, y, ("from", "to"), ("s2", "e2"), condition, bin_width), sort_output)


@carrying
def overlaps_simple(a: DataFrame, b: DataFrame, spec: Spec = SPEC, other: Spec = OTHER, multiple: str = "all", contained: bool = False, slack: int = 0, bin_width: int | None = None, sort_output: bool = False) -> DataFrame:
    """As ``overlaps``, with starts that slack may move below 0, and with ``contained`` for containment either way, which slack relaxes."""
    x, y = _sides(a, b, spec, other)
    low, high = F.col("s") - slack, F.col("e") + slack
    if not _checked(multiple):
        # The left row holds the right one, or the right one the left.
        searches = [(low, high, False), (F.col("s") + slack + 1, F.col("e") - slack, True)] if contained else [(high, low + 1, True)]
        return _named(_one(x, y, multiple == "last", *searches), sort_output)
    columns = [F.col(c) for c in ("s", "e", "s2", "e2")]
    condition = (contained_either_way if contained else overlap)(*columns, slack)
    wide = x.withColumns({"from": low, "to": high})
    return _named(range_join(wide, y, ("from", "to"), ("s2", "e2"), condition, bin_width), sort_output)


@carrying
def semi_overlaps(a: DataFrame, b: DataFrame, spec: Spec = SPEC, other: Spec = OTHER, slack: int = 0) -> DataFrame:
    """``idx`` of the left rows that overlap some right row."""
    return _counted(a, b, spec, other, slack, clamp=False).where("count > 0").select("idx")


@carrying
def complement_overlaps(a: DataFrame, b: DataFrame, spec: Spec = SPEC, other: Spec = OTHER, slack: int = 0) -> DataFrame:
    """``idx`` of the left rows that overlap no right row; all of them where the right side is empty."""
    return _counted(a, b, spec, other, slack, clamp=False).where("count = 0").select("idx")


@carrying
def count_overlaps(a: DataFrame, b: DataFrame, spec: Spec = SPEC, other: Spec = OTHER, slack: int = 0) -> DataFrame:
    """``idx`` and ``count``, the number of right rows that each left row overlaps, 0 included."""
    return _counted(a, b, spec, other, slack, clamp=True)


def _counted(a: DataFrame, b: DataFrame, spec: Spec, other: Spec, slack: int, clamp: bool) -> DataFrame:
    """Right starts before the left end, less right ends up to the left start: two running counts over one union, no join."""
    x, y = _sides(a, b, spec, other)
    low = F.col("s") - slack
    low = F.greatest(low, F.lit(0).cast("long")) if clamp else low
    none = F.lit(None).cast(x.schema["i"].dataType)
    mark = lambda p, o, d, sign: F.struct(p.alias("p"), F.lit(o).alias("o"), F.lit(d).alias("d"), F.lit(sign).alias("sign"))
    # At one position: ends of the right side, then questions about the start; questions about the end, then starts of the right side.
    asked = x.select("g", "i", F.xxhash64("i").alias("t"), F.inline(F.array(mark(low, 1, 0, -1), mark(F.col("e") + slack, 2, 0, 1))))
    told = y.select("g", none.alias("i"), F.xxhash64("i2").alias("t"), F.inline(F.array(mark(F.col("e2"), 0, -1, 0), mark(F.col("s2"), 3, 1, 0))))
    # The hash of the id only tells rows at one position apart, so that they can be cut.
    laid = Stretches(asked.unionByName(told), "p", "o", "sign", "t")
    ends = laid.running(laid.df, "sum", F.when(F.col("d") < 0, 1).otherwise(0), "ends", inclusive=True)
    both = laid.running(ends, "sum", F.when(F.col("d") > 0, 1).otherwise(0), "starts", inclusive=True)
    part = F.when(F.col("sign") > 0, F.col("starts")).when(F.col("sign") < 0, -F.col("ends"))
    return both.where("sign <> 0").groupBy("i").agg(F.sum(part).cast("long").alias("count")).select(F.col("i").alias("idx"), "count")

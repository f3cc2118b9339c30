"""First and last matches among ranked rows, without the pairs.

The right rows of a group have ranks in some order.  A tree of blocks of ``RADIX`` ranks, blocks of blocks and so on holds the
greatest (or least) end below each; the first rank from some place on whose end is far enough out is found by climbing from
that place until a later part of a block has one, and descending into it.  Each step is an equi-join on (group, block), so
what is shuffled is linear in both sides, however many rows a left row meets.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import floor_div
from .shared import kept

#: Children of a block.
RADIX = 64


class Blocks:
    """The tree over ``rows`` (g, r from 0, e and ``more``), groups of at most ``largest`` rows, by greatest ends (``most``) or least ones."""

    def __init__(self, rows: DataFrame, largest: int, most: bool, *more: str):
        self.most = most
        self.top = 0
        while RADIX ** (self.top + 1) < largest:
            self.top += 1
        level = self.gathered(rows.select("g", F.col("r").alias("at"), "e", *more), *more)
        # With several levels the leaves are read more than once.
        self.levels = [kept(level) if self.top else level]
        for _ in range(self.top):
            end = (F.array_max if most else F.array_min)(F.transform("a", lambda x: x["e"]))
            self.levels.append(self.gathered(self.levels[-1].select("g", F.col("block").alias("at"), end.alias("e"))))

    @staticmethod
    def gathered(rows: DataFrame, *more: str) -> DataFrame:
        block, place = Blocks.parts(F.col("at"))
        return rows.withColumns({"block": block, "k": place}).groupBy("g", "block").agg(F.array_sort(F.collect_list(F.struct("k", "e", *more))).alias("a"))

    def looked(self, asks: DataFrame, level: int, ascending: bool) -> DataFrame:
        """``asks`` (g, i, x, block, slot) with ``hit``, the first child from ``slot`` on (the last up to it) whose end is at least (at most) ``x``, or null."""
        x, slot = F.col("x"), F.col("slot")
        fits: Column = F.filter("a", lambda c: ((c["e"] >= x) if self.most else (c["e"] <= x)) & ((c["k"] >= slot) if ascending else (c["k"] <= slot)))
        return asks.join(self.levels[level], ["g", "block"], "left").withColumn("hit", F.try_element_at(fits, F.lit(1 if ascending else -1))).drop("a")

    def found(self, asks: DataFrame, ascending: bool, whole: bool = False) -> DataFrame:
        """``asks`` (g, i, x, r) with ``hit``: the first row from rank ``r`` on (the last up to it) whose end fits; asks without one are left out.

        ``whole``: whether all ascending asks begin at rank 0, at the top of the tree then.
        """
        ends = 0 if ascending else RADIX - 1
        block, slot = self.parts(F.col("r"))
        state = asks.withColumns({"block": F.lit(0).cast("long") if whole else block, "slot": F.lit(0) if whole else slot}).drop("r")
        columns = state.columns
        step = (lambda x: kept(x)) if self.top else (lambda x: x)
        hits: dict[int, DataFrame] = {}
        for level in range(self.top if whole else 0, self.top + 1):
            met = step(self.looked(state, level, ascending))
            hits[level] = met.where("hit is not null")
            block, slot = self.parts(F.col("block"))
            state = met.where("hit is null").drop("hit").withColumns({"block": block, "slot": slot + (1 if ascending else -1)}).select(columns)
        down = None
        for level in range(self.top, 0, -1):
            here = hits[level] if down is None else hits[level].unionByName(down) if level in hits else down
            inside = here.withColumns({"block": F.col("block") * RADIX + F.col("hit.k"), "slot": F.lit(ends)}).select(columns)
            down = step(self.looked(inside, level - 1, ascending))
        return (down if 0 not in hits else hits[0] if down is None else hits[0].unionByName(down)).drop("block", "slot")

    @staticmethod
    def parts(rank: Column) -> tuple[Column, Column]:
        """The block of a rank and its place there."""
        return floor_div(rank, RADIX), F.pmod(rank, F.lit(RADIX)).cast("int")

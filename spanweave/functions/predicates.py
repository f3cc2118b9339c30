"""Column predicates of two half-open intervals."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(s: Column, e: Column, s2: Column, e2: Column, slack: int = 0) -> Column:
    """Whether they share a position, or leave a gap of less than ``slack``."""
    return (s < e2 + slack) & (s2 < e + slack)


def contains(s: Column, e: Column, s2: Column, e2: Column, slack: int = 0) -> Column:
    """Whether the first, wider by ``slack`` on both sides, covers the second."""
    return (s - slack <= s2) & (e2 <= e + slack)


def contained_either_way(s: Column, e: Column, s2: Column, e2: Column, slack: int = 0) -> Column:
    return contains(s, e, s2, e2, slack) | contains(s2, e2, s, e, slack)


def signed(ascending: Column, x: Column) -> Column:
    """``x``, or ``-x`` for rows that are walked in descending order."""
    return F.when(ascending, x).otherwise(-x)

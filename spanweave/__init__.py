"""Interval algebra on Spark DataFrames.

Intervals are half-open ``[start, end)`` rows with a unique ``idx`` and any number
of group columns.  Every operator takes and returns DataFrames.
"""

from .model import Spec
from .operators import (
    boundary,
    cluster,
    complement,
    complement_overlaps,
    count_overlaps,
    extend,
    genome_bounds,
    group_cumsum,
    map_to_global,
    max_disjoint,
    merge,
    nearest,
    overlaps,
    overlaps_simple,
    semi_overlaps,
    sort_groups,
    sort_intervals,
    sort_positions,
    spliced_subsequence,
    split,
    subtract,
    tile,
    window,
)

__all__ = [
    "Spec",
    "boundary",
    "cluster",
    "complement",
    "complement_overlaps",
    "count_overlaps",
    "extend",
    "genome_bounds",
    "group_cumsum",
    "map_to_global",
    "max_disjoint",
    "merge",
    "nearest",
    "overlaps",
    "overlaps_simple",
    "semi_overlaps",
    "sort_groups",
    "sort_intervals",
    "sort_positions",
    "spliced_subsequence",
    "split",
    "subtract",
    "tile",
    "window",
]

from .islands import boundary, cluster, complement, merge
from .joins import complement_overlaps, count_overlaps, overlaps, overlaps_simple, semi_overlaps
from .nearest import nearest
from .setops import max_disjoint, split, subtract
from .shape import extend, genome_bounds, tile, window
from .sorting import sort_groups, sort_intervals, sort_positions
from .spliced import group_cumsum, map_to_global, spliced_subsequence

__all__ = [
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

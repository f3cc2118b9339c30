from .predicates import contained_either_way, contains, overlap, signed

__all__ = ["contained_either_way", "contains", "overlap", "signed"]

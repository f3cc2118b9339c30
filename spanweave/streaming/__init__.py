from .static_side import drained, overlaps_with_static, stream_tiles

__all__ = ["drained", "overlaps_with_static", "stream_tiles"]

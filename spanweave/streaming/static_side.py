"""Operators that keep no state between rows, for streams of intervals."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import SPEC, Spec, framed, same_groups
from ..operators.joins import OTHER
from ..operators.shape import tile
from ..plans.binning import MOST_LENGTH, base_width, binned, extent, level_of, levels_needed, paired


def stream_tiles(stream: DataFrame, size: int, spec: Spec = SPEC) -> DataFrame:
    """``tile`` of a stream; it needs no state."""
    return tile(stream, size, spec)


def overlaps_with_static(stream: DataFrame, static: DataFrame, bin_width: int | None = None, spec: Spec = SPEC, other: Spec = OTHER) -> DataFrame:
    """Pairs (``idx``, ``idx2``) of a stream's intervals and a static set: a stream-static equi-join on bins.

    Bins have levels by length (see ``plans.binning``): those of the static side are read when the query starts, and a stream's
    interval may be of any level up to the longest there can be, so that none becomes more than a few bins
    of each level, and nothing need be known about the stream.  ``bin_width`` is the width of the finest bins (by default the static
    side's median length).
    """
    same_groups(spec, other)
    x, y = framed(stream, spec), framed(static, other).withColumnsRenamed({"i": "i2", "s": "s2", "e": "e2"})
    base = bin_width or base_width(extent(y, "s2", "e2").median)
    top = levels_needed(MOST_LENGTH, base)
    used = sorted(r[0] for r in y.select(level_of(F.col("e2") - F.col("s2"), base, top)).distinct().collect())
    # A pair meets at the coarser of its levels: the stream's own, or one of the static side.
    own = F.array(level_of(F.col("e") - F.col("s"), base, top), *[F.lit(k) for k in used])
    return paired(binned(x, "s", "e", base, list(range(top + 1)), "__level_a", own), binned(y, "s2", "e2", base, list(range(top + 1)), "__level_b"), (F.col("s") < F.col("e2")) & (F.col("s2") < F.col("e"))).select(F.col("i").alias("idx"), F.col("i2").alias("idx2"))


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """All rows that a stream has now, written to ``folder`` (which driver and executors share) and read from there."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")

"""Interval sets read from tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, stream: bool = False) -> DataFrame:
    """A table of a folder; as a stream of its files, if asked for."""
    found = spark.read.parquet(path := f"{folder}/{name}.parquet")
    # A pattern, since a stream takes a folder of files or a pattern of them, and the table may be one file.
    return spark.readStream.schema(found.schema).parquet(f"{path}*") if stream else found


def as_intervals(df: DataFrame, idx: str, start: str, end: str, by: tuple[str, ...] = (), strand: str | None = None) -> DataFrame:
    """The columns ``idx``, ``grp`` (a struct of several), ``s``, ``e`` and ``neg`` from SQL expressions, with all others after them."""
    group = F.expr(by[0]) if len(by) == 1 else F.struct(*[F.expr(x) for x in by]) if by else F.lit(0)
    named = {"idx": F.expr(idx), "grp": group, "s": F.expr(start).cast("long"), "e": F.expr(end).cast("long"), "neg": F.expr(strand) if strand else F.lit(False)}
    return df.select(*[c.alias(k) for k, c in named.items()], *[c for c in df.columns if c not in named])


def event_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Events as intervals in seconds, by user."""
    start = "timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)"
    return as_intervals(table(spark, folder, "events"), "event_id", start, f"{start} + 1 + cast(floor(value * 60) as bigint)", ("user_id",), "event_id % 2 = 1")


def order_intervals(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """Orders as intervals in days, by customer."""
    start = "cast(datediff(o_orderdate, timestamp_ntz'1995-01-01 00:00:00') as bigint)"
    return as_intervals(table(spark, folder, "orders", stream), "o_orderkey", start, f"{start} + 1 + cast(floor(o_totalprice / 2000) as bigint)", ("o_custkey",), "o_orderkey % 2 = 1")

"""Tables kept for reuse in the folder that driver and executors share."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows up to which a table is broadcast.
BROADCAST_BYTES = 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.

    Where that is unset, a local session (as in tests) gets a temporary folder that becomes it; a cluster
    raises ValueError, since no folder of one machine would be seen by the others.
    """
    context = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if known is None:
        if current.isDefined():
            return current.get()
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: it names the folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="shared-")
    if not current.isDefined():
        context.setCheckpointDir(known)
    return known


def staged(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written once as Parquet to the shared folder and read from there.

    Cuts the lineage: what is read later no longer depends on shuffle files of
    executors that may be lost.  The table goes when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(schema).parquet(path)


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, marked for a broadcast if its rows take at most ``most`` bytes (16 a row, and its values as strings).  It is read for that, so it should be staged."""
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.concat_ws(" ", *[F.col(c).cast("string") for c in df.columns]))), F.lit(0))).first()
    return F.broadcast(df) if 16 * rows + size <= most else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")

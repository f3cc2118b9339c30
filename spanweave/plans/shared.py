"""Intermediate rows in the folder that driver and executors share."""

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without that setting (as in tests) gets a temporary folder, a cluster raises ValueError."""
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


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint: computed once, with its partitions and their order as they are, and no lineage before it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()

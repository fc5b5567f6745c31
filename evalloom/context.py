"""Session helpers: where lineage is cut, and one-row values."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def use_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint into the folder the session names in ``spark.checkpoint.dir``.

    A temporary folder is set only when nothing is configured *and* the master
    is local; on a cluster a machine-local folder would not survive an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="spark-")
    sc.setCheckpointDir(configured)
    return configured


def one_row(df: DataFrame) -> Column:
    """The only row of a one-row aggregate as a struct column: a scalar subquery, so no join at all."""
    return df.select(F.struct("*").alias("_row")).scalar()

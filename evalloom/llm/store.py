"""Written intermediate tables and column names shared by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from evalloom.context import use_checkpoint_dir


def written(df: DataFrame, **options) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder: cuts lineage and outlives a lost executor."""
    path = f"{use_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Delete the files of tables that ``written`` made and that nothing reads any more; other sources are never touched."""
    spark = df.sparkSession
    home = use_checkpoint_dir(spark)
    for file in df.inputFiles():
        folder = file.rsplit("/", 1)[0]
        if folder.rsplit("/", 1)[-1].startswith("table-"):
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{home}/{folder.rsplit('/', 1)[-1]}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Written tables of one step, deleted together once nothing reads them any more."""

    def __init__(self):
        self.tables = []

    def written(self, df: DataFrame) -> DataFrame:
        self.tables.append(written(df))
        return self.tables[-1]

    def clear(self) -> None:
        while self.tables:
            removed(self.tables.pop())


def free_name(df: DataFrame, base: str) -> str:
    """``base``, or the first of its underscored forms that no column of ``df`` has (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base

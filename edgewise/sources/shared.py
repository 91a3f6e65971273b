"""Tables in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset in local mode, as in tests, a folder of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="edgewise-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def cut(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df written to the shared folder, in one folder for each value of the columns `by`, and read again, so that its lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/edgewise/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def held(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """As cut(), but the folder goes at the end, so nothing that is read later may come from it."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/edgewise/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

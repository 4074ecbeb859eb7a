"""Tables written on the way, where a plan would otherwise read one branch many times over."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Only a session that runs in one process may have
    none: it gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="offersieve-"))
    return _own[0]


def _delete(spark: SparkSession, path: str) -> None:
    if spark._jsc is not None and not spark._jsc.sc().isStopped():
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read again: the plan ends here, and a lost executor loses nothing of it."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/offersieve-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)

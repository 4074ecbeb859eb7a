"""What the corpus operators share: word patterns, scratch tables, and row keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space; the same class in Java, RE2 and Python.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"

_own_dir: list[str] = []

#: Rows in a file of a scratch table.
FILE_ROWS = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share; one of our own only where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="offersieve-"))
    return _own_dir[0]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    if spark._jsc is not None and not spark._jsc.sc().isStopped():
        _delete(spark, path)


def hold(df: DataFrame) -> DataFrame:
    """df, computed once: blocks stay on the executors' disks, none in their heaps, and those of a lost executor are made
    again from the input. For tables made straight from an input; deeper ones are materialized."""
    df = df.persist(StorageLevel.DISK_ONLY)
    df._rows = df.count()
    return df


def write_table(df: DataFrame) -> DataFrame:
    """Write df, as it is dealt, to a table in the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/offersieve-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete_at_exit, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def materialize(df: DataFrame, rows: int = FILE_ROWS) -> DataFrame:
    """A table in the shared folder: lineage is cut, and any executor can read every part. The rows are computed over all
    tasks first and held on disk, then written in files of about `rows` rows, so a small table is one file however many
    partitions made it."""
    held = df.persist(StorageLevel.DISK_ONLY)
    count = held.count()
    out = write_table(held.coalesce(max(1, -(-count // rows))))
    out._rows = count
    held.unpersist()
    return out


def rows_of(table: DataFrame) -> int:
    """How many rows a held or materialized table has."""
    return table._rows


def release(df: DataFrame) -> None:
    """Give back what a materialized table holds, once nothing reads it any more."""
    if hasattr(df, "_scratch"):
        _delete(df.sparkSession, df._scratch)
    else:
        df.unpersist()


#: Rows of one key that one task joins, at least; a key with more is dealt over several tasks.
KEY_ROWS = 1 << 15


def salted_join(left: DataFrame, right: DataFrame, counts: DataFrame, keys: list[str], n: str, rows: int, spread: list[str]) -> DataFrame:
    """Inner join on keys, of which right has one row each; counts says in column n how many of left's `rows` rows have
    them. Keys of more than KEY_ROWS (or a 1024th of the rows, if that is more) are dealt over tasks by the hash of left's
    `spread` columns, and right's rows for them go to each of those. Under 1024 keys are that frequent, so their hashes
    come to the driver and are part of the plan; a key that shares such a hash is dealt too, on both sides alike."""
    limit = max(KEY_ROWS, rows // 1024)
    hot = counts.filter(F.col(n) > limit).select(F.xxhash64(*keys).alias("h"), n).collect()
    if not hot:
        return left.join(right, keys)
    tasks = -(-max(r[n] for r in hot) // limit)
    salt = fresh(left, "salt")
    is_hot = F.xxhash64(*keys).isin([r["h"] for r in hot])
    dealt = left.withColumn(salt, F.when(is_hot, F.pmod(F.xxhash64(*spread), F.lit(tasks)).cast("int")).otherwise(0))
    copies = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.when(is_hot, F.lit(tasks - 1)).otherwise(0))))
    return dealt.join(copies, [*keys, salt]).drop(salt)


def row_hash(*columns: Column | str) -> Column:
    """64 bits of a row's identity: the same for repeated rows, and stable when a lost task runs again. Rows are told apart
    by their id and this, see same_row."""
    return F.xxhash64(*columns)


def same_row(left: DataFrame, right: DataFrame, left_row: str, right_row: str, left_id: str = "doc_id", right_id: str = "doc_id") -> Column:
    """Join condition: the same id (null is an id too) and the same hash."""
    return (left[left_row] == right[right_row]) & left[left_id].cast("long").eqNullSafe(right[right_id])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")

"""Intermediate tables that are written once and read again, so that what was counted on them stays true."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_folders: list[str] = []
_tables: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where the setting is missing, a local master gets a folder of this machine; a cluster gets an error, as its
    executors would not see one another's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = f"file://{tempfile.gettempdir()}/checkpoints"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def _path(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the shared folder, which goes with release() or when the session's JVM ends."""
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path, system = _path(spark, folder)
    system.deleteOnExit(path)
    _folders.append(folder)
    return folder


def _plain(df: DataFrame) -> DataFrame:
    """``df`` with columns that Parquet takes, whatever their names and types."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.withColumns({f.name: F.col(f.name).cast("string") for f in plain.schema if isinstance(f.dataType, T.NullType)})


def _back(plain: DataFrame, df: DataFrame) -> DataFrame:
    """The columns of ``df`` again."""
    void = {f"c{i}": F.lit(None).cast("void") for i, f in enumerate(df.schema) if isinstance(f.dataType, T.NullType)}
    return plain.withColumns(void).toDF(*df.columns)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as it comes out of a table in the shared folder, under the same columns, whatever their names.

    A lost executor costs its running tasks only, and every reader sees the same rows and partition numbers. The files go
    with release() or when the session's JVM ends.
    """
    folder = scratch(df.sparkSession, name)
    plain = _plain(df)
    plain.write.parquet(folder)
    return _back(df.sparkSession.read.schema(plain.schema).parquet(folder), df)


def stored_parts(df: DataFrame, name: str, part: Column, parts: int) -> list[DataFrame]:
    """The rows of ``df`` for which ``part`` is 0, 1, ... in a table each, written in one go.

    The parts are folders of one stored table, so that reading one reads nothing else. Rows go to the tasks by their part,
    and a part with many rows to several of them.
    """
    folder, plain = scratch(df.sparkSession, name), _plain(df)
    dealt = _plain(df.withColumn("__lf_part", part)).withColumnRenamed(f"c{len(df.columns)}", "part").where("part IS NOT NULL")
    dealt.hint("rebalance", "part").write.partitionBy("part").parquet(folder)
    whole = df.sparkSession.read.schema(T.StructType([*plain.schema, T.StructField("part", T.IntegerType())])).parquet(folder)
    return [_back(whole.where(F.col("part") == i).drop("part"), df) for i in range(parts)]


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """``df`` as a stored table in as many buckets of ``key`` as a shuffle has partitions, one file each: joins of two such
    tables by their keys shuffle neither. The session's catalog knows it by a name of its own until release()."""
    spark = df.sparkSession
    folder, n, plain = scratch(spark, name), int(spark.conf.get("spark.sql.shuffle.partitions")), _plain(df)
    at = f"c{df.columns.index(key)}"
    table = f"lf_{folder.rsplit('/', 1)[-1].replace('-', '_')}"
    plain.repartition(n, at).write.bucketBy(n, at).sortBy(at).option("path", folder).saveAsTable(table)
    _tables.append(table)
    return _back(spark.table(table), df)


def release(spark: SparkSession) -> int:
    """Deletes all folders that scratch() has given out so far, and says how many; what still reads from them fails."""
    n = len(_folders)
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    while _folders:
        path, system = _path(spark, _folders.pop())
        system.delete(path, True)
    return n

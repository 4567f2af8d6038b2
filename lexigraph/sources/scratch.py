"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder where none is set and all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lexigraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, tag: str, few: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: a lost executor costs a reread of the file and no recomputation, and rows that depend on task
    ids or sampling (range partitions, row ids) are fixed from here on. ``few`` is for tables of narrow rows, which loops
    would else leave in thousands of tiny files: they are written by two tasks a core, or by a quarter of the shuffle
    partitions if that is more, so that no task gets more than four partitions' rows on a cluster with many of them.
    """
    if few:
        spark = df.sparkSession
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4))
    path = f"{shared_dir(df.sparkSession)}/lexigraph-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of the files that a table is read from, compressed as they are, for one partition of ``dealt``.
DEALT = 8 << 20


def dealt(df: DataFrame, *keys: str, each: int = DEALT) -> DataFrame:
    """``df`` by ``keys``, in as many partitions as its input's size asks for, so that none grows with the table.

    The size is that of all files and local rows that ``df`` reads; where Spark knows none, the session's number holds.
    """
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    if size >= spark._jsparkSession.sessionState().conf().defaultSizeInBytes():
        return df.repartition(*keys)
    return df.repartition(max(spark.sparkContext.defaultParallelism, -(-size // each)), *keys)


def discard(df: DataFrame) -> None:
    """Remove the files of a table that ``materialise`` returned and that nothing reads any more."""
    spark = df.sparkSession
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getName().startswith("lexigraph-"):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

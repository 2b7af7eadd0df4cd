"""Small helpers shared by the operators: scratch storage, sizing, text keys."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the session names: ``spark.checkpoint.dir``, or the checkpoint folder set on its
    context. A temporary folder is made only on one machine; elsewhere executors could not read it."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-newsloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """Writes a frame to the shared folder and reads it back: lineage ends there, and any
    executor can be lost without redoing the work before it. The files go when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/newsloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def scratch_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of ``df`` has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def block_count(df: DataFrame, block_bytes: int = 16 << 20) -> int:
    """Blocks of about ``block_bytes`` of a frame's input: its partitions, cut further where the session
    makes large ones. Planning only; no job runs."""
    size = df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.rdd.getNumPartitions() * max(1, math.ceil(size / block_bytes))

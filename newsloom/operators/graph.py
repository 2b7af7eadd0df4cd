"""Connected components by stars, and numbers in an order by range partitions; what is written between jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def shared_folder(spark) -> str:
    """The shared folder that the session names: ``spark.checkpoint.dir``, or the checkpoint folder set on its context. A
    temporary folder is made only on one machine; elsewhere executors could not read it."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not folder:  # kept on the context, so that a session has one
        folder = tempfile.mkdtemp(prefix="spark-newsloom-")
        context.setCheckpointDir(folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """Written and read again, so that lineage ends. The files go when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def in_order(df: DataFrame, order: list) -> DataFrame:
    """The frame by ranges of ``order`` with ``at``, a number that grows along it (with gaps). To be written before it is used twice."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())


def numbered(df: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """Row numbers from 1 in each group, as ``row_number`` gives them, without a task for each group: rows are dealt by ranges, and a
    row's number is its place in its partition and the numbers of its group's rows in the partitions before. The window is over
    counts, a row for each partition that a group is in."""
    rows = written(in_order(df, [*groups, *order]).withColumn("_part", F.spark_partition_id()))
    counts = rows.groupBy("_part", *groups).agg(F.count("*").alias("_n"), F.min("at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{k}") for k, g in enumerate(groups)], "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    same = [F.col("_part") == F.col("_p"), *[F.col(g).eqNullSafe(F.col(f"_g{k}")) for k, g in enumerate(groups)]]
    return rows.join(bases, same).withColumn(name, F.col("at") - F.col("_first") + F.col("_before") + 1).select(*df.columns, name)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (a, b): the component's smallest node, for every node of an edge between two.

    A round hangs each node's larger neighbours under the smallest node around it, then each node's smaller
    neighbours likewise (large star and small star), until nothing changes; rounds grow with the square of the
    logarithm of the number of nodes at most. Each round is written; a count and a sum of hashes reach the driver."""
    pairs = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = _print_of(pairs)
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        under = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(under, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        pairs = written(hung.select("e.u", "e.v").filter("u <> v").distinct())
        after = _print_of(pairs)
        if after == before:
            roots = pairs.select(F.col("v").alias("node")).distinct()
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
        before = after


def _print_of(pairs: DataFrame):
    """Number of pairs and a sum of their hashes; equal for equal sets."""
    return pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

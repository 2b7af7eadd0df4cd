"""Spreading small inputs over the cores there are."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """A frame that comes in fewer partitions than there are cores, as one small file does, dealt over
    them; any other as it is. Planning only; large inputs are never shuffled by this."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

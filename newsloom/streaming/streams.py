"""Structured Streaming forms of the batch rules (ST1-ST6). Event time must be ``timestamp`` (cast
``timestamp_ntz`` first); every state has a watermark and so a bound."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsloom.operators import graph, store


def timed(events: DataFrame, column: str = "ts") -> DataFrame:
    return events.withColumn(column, F.col(column).cast("timestamp"))


def split_undated(events: DataFrame, column: str = "ts") -> tuple[DataFrame, DataFrame]:
    """(dated, undated): rows without event time have a way of their own (ST2)."""
    return events.filter(F.col(column).isNotNull()), events.filter(F.col(column).isNull())


def fresh(events: DataFrame, key: str, column: str = "ts", retention: str = "45 days") -> DataFrame:
    """Each key once within the retention (ST1)."""
    return timed(events, column).withWatermark(column, retention).dropDuplicatesWithinWatermark([key])


def daily_counts(events: DataFrame, keys: list[str], column: str = "ts", late: str = "36 hours", window: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts of tumbling or sliding windows (ST3)."""
    span = F.window(column, window, slide) if slide else F.window(column, window)
    return timed(events, column).withWatermark(column, late).groupBy(span, *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, keys: list[str], gap: str = "3 days", column: str = "ts", late: str = "36 hours") -> DataFrame:
    """Stories: rows of one key no further apart than the gap (ST5)."""
    return timed(events, column).withWatermark(column, late).groupBy(F.session_window(column, gap), *keys).agg(F.count("*").alias("n"))


def alert_stream(pairs: DataFrame, least: int, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Strong rows to a sink, batch by batch (ST6)."""
    from newsloom.operators.planning import alerts

    return alerts(pairs, least).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


STORE_KEYS = {"event": ["event_id"], "event_stock": ["event_id", "ticker"]}


def current(spark: SparkSession, path: str, name: str, batch: int | None = None, only: DataFrame | None = None) -> DataFrame:
    """A table of the store at ``path`` as it is after a batch (after all, if none is given): of each key the row written
    last. ``only`` has event ids; rows of others aren't gathered."""
    rows = spark.read.parquet(f"{path}/{name}")
    rows = rows if batch is None else rows.filter(F.col("batch") <= batch)
    rows = rows if only is None else rows.join(only.select("event_id").distinct(), "event_id", "left_semi")
    columns = [F.col(c) for c in rows.columns if c != "batch"]
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in STORE_KEYS[name]]).agg(F.max_by(F.struct(*columns), "batch").alias("r")).select("r.*")


def absorb(incoming: DataFrame, path: str, checkpoint: str, days: int = store.WINDOW_DAYS) -> StreamingQuery:
    """Late evidence into the tables of an event store (ST4): each batch is matched with the stored events of the
    window and merged. Only rows that are new or touched are written, as the folder ``batch=n`` of each table (the first
    store is batch 0), so a batch that is run again after a failure writes the same folder; ``current`` reads the
    store. The first and last day of a batch go to the driver, so that the scan for candidates is pruned by day."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = graph.written(batch)
        first, last = batch.agg(F.date_sub(F.min("event_date"), days), F.date_add(F.max("event_date"), days)).first()
        near = spark.read.parquet(f"{path}/event").filter(F.col("batch") <= number).filter(F.col("event_date").between(F.lit(first), F.lit(last)))
        events = current(spark, path, "event", number, near)
        found = graph.written(store.find_existing(batch.select("event_id", "title", "cluster_key", "event_date", "event_types", "tickers"), events, days))
        touched = found.select("event_id").distinct()
        rows = batch.select("event_id", F.explode("stocks").alias("s")).select("event_id", "s.*")
        merged = store.merge_stocks(rows, current(spark, path, "event_stock", number, touched), found).drop("log")
        own = rows.join(found.select(F.col("incoming_id").alias("event_id")), "event_id", "left_anti").select(*merged.columns)
        merged.unionByName(own).write.mode("overwrite").parquet(f"{path}/event_stock/batch={number + 1}")
        store.merge_events(batch.select(*events.columns), events.join(touched, "event_id", "left_semi"), found).write.mode("overwrite").parquet(f"{path}/event/batch={number + 1}")

    return incoming.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(stream: DataFrame, mode: str, folder: str, name: str) -> DataFrame:
    """Runs a stream over all that is there and returns what it put out, by way of files in a shared folder."""
    path = f"{folder}/{name}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{path}/out")

"""Landed sources by name, read as a table or as a stream of files (SC1, SC3, SC4, SC10-SC12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamReader

from newsloom.sources import landing


class FileStream:
    """Stands for a session where a reader asks for ``read``: files are read as they land, so many a batch at most."""

    def __init__(self, spark: SparkSession, files_per_batch: int = 1000):
        self._spark, self._files = spark, files_per_batch

    @property
    def read(self) -> DataStreamReader:
        return self._spark.readStream.option("maxFilesPerTrigger", self._files)


#: Readers that judge each record by itself. The second exchange judges whole files and is read as a table only.
SOURCES = {
    "feed": landing.rss, "atom": landing.atom, "index": landing.document_index, "exchange": landing.exchange_announcements,
    "forum": landing.forum, "videos": landing.videos, "event_files": landing.event_files,
}


def landed(spark: SparkSession, name: str, path: str, stream: bool = False, files_per_batch: int = 1000, **options) -> DataFrame:
    """What a source's landed files hold, in the shape of its reader; ``options`` are the reader's. Both ways of reading give the same
    rows; an unknown name is a ``KeyError``; a folder without files gives no rows."""
    return SOURCES[name](FileStream(spark, files_per_batch) if stream else spark, path, **options)


def rejected(spark: SparkSession, path: str, schema, form: str = "json", stream: bool = False, files_per_batch: int = 1000, **options: str) -> DataFrame:
    """The records that a reader skips, named (``landing.unreadable``), as a table or a stream."""
    return landing.unreadable(FileStream(spark, files_per_batch) if stream else spark, path, schema, form, **options)

"""Evolving stories as keyed state with timers (ST4): late evidence is matched with a ticker's open stories, and what changes comes out.

A row is one (event, ticker). Rows wait until the watermark has passed their day and are then taken in order of time and
id, so that the order of arrival, late rows and restarts change nothing. A row continues the open story that an
equal cluster key names, else the one of the most similar title (the rule of ``store.find_existing`` within the ticker, bounds and
rounding included); it is merged as ``store.merge_stocks`` and ``store.merge_events`` merge. A story is dropped when no row that can
still come lies within ``days`` of it. Nothing of the store is read: a ticker's open stories are its state.

Defined results: rows later than ``late`` behind the newest are dropped by the watermark; undated rows never match and must be split off
(``streams.split_undated``); null keys are empty, null titles have no words; repeated rows change nothing a second
time; a null ticker is a ticker, a null impact 0. Rows that wait are kept as they come, a piece for each Arrow batch and day, so that a batch is in
memory at a time. A day of one ticker is held in memory when it is taken, its open stories by word."""

from __future__ import annotations

import difflib
import json
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from newsloom.functions import text
from newsloom.operators import store

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGE = "ticker string, event_id string, incoming_id string, at timestamp, change string, detail string, impact_score int, direction string"
COLUMNS = [x.split()[0] for x in CHANGE.split(", ")]
ROW = ["event_id", "at", "day", "title", "words", "cluster_key", "event_types", "has_official", "relationship", "impact_score", "direction"]
DAY_MS = 86_400_000


def half_up(value: float) -> float:
    """Rounded to four places as ``round`` of the SQL functions does."""
    return float(Decimal(repr(value)).quantize(Decimal("0.0001"), ROUND_HALF_UP))


class Shelf:
    """The open stories of one ticker while some days are taken: by id, by key and by word."""

    def __init__(self, stories: dict[str, dict], days: int, similarity: float):
        self.stories, self.days, self.similarity = stories, days, similarity
        self.by_key: dict[str, set[str]] = {}
        self.by_word: dict[str, set[str]] = {}
        self.touched: set[str] = set()
        for event_id in stories:
            self._shelve(event_id)

    def _shelve(self, event_id: str) -> None:
        story = self.stories[event_id]
        self.by_key.setdefault(story["cluster_key"], set()).add(event_id)
        for word in story["words"]:
            self.by_word.setdefault(word, set()).add(event_id)

    def _unshelve(self, event_id: str) -> None:
        for word in self.stories[event_id]["words"]:
            self.by_word[word].discard(event_id)

    def score(self, row: dict, story: dict) -> float:
        """The likeness of a row and a story, or -1 where words and lengths rule it out."""
        a, b = set(row["words"]), set(story["words"])
        jaccard = len(a & b) / len(a | b) if a and b else 0.0
        contained = len(a & b) / min(len(a), len(b)) if a and b else 0.0
        bonus = store.CATEGORY_BONUS if set(row["event_types"]) & set(story["event_types"]) else 0.0
        both = lambda ratio: half_up(max(0.5 * jaccard + 0.3 * ratio + 0.2 * contained, 0.8 * contained))
        size = len(row["title"]) + len(story["title"])
        if both(2 * min(len(row["title"]), len(story["title"])) / size if size else 1.0) + bonus + 0.0002 < self.similarity:
            return -1.0
        return half_up(both(difflib.SequenceMatcher(None, row["title"], story["title"]).ratio()) + bonus)

    def match(self, row: dict) -> str | None:
        near = lambda event_id: event_id != row["event_id"] and abs(row["day"] - self.stories[event_id]["day"]) <= self.days
        same = [e for e in self.by_key.get(row["cluster_key"], ()) if near(e)] if row["cluster_key"] else []
        if same:
            return min((-max(self.score(row, self.stories[e]), 0.0), e) for e in same)[1]
        alike = {e for word in row["words"] for e in self.by_word.get(word, ()) if near(e)}
        scored = ((-self.score(row, self.stories[e]), e) for e in alike)
        return min((x for x in scored if -x[0] >= self.similarity), default=(0, None))[1]

    def take(self, ticker, row: dict) -> list[tuple]:
        """The changes that a row makes."""
        known = self.stories.get(row["event_id"])
        found = row["event_id"] if known else self.match(row)
        if found is None:
            self.stories[row["event_id"]] = dict(row)
            self._shelve(row["event_id"])
            self.touched.add(row["event_id"])
            return [self._change(ticker, row["event_id"], row, "event added", f"{ticker} ({row['relationship']})", row)]
        story = self.stories[found]
        raised, turned = row["impact_score"] > story["impact_score"], row["direction"] != story["direction"]
        out = []
        if raised or turned:
            old, new = (story["impact_score"], row["impact_score"]) if raised else (story["direction"], row["direction"])
            out.append(self._change(ticker, found, row, "impact raised" if raised else "direction changed", f"{ticker} {old} -> {new}", row))
            story |= {name: row[name] for name in ("relationship", "impact_score", "direction")}
        story["event_types"] = list(dict.fromkeys([*story["event_types"], *row["event_types"]]))
        story["day"] = min(story["day"], row["day"])
        if row["has_official"] and not story["has_official"]:
            self._unshelve(found)
            story |= {name: row[name] for name in ("title", "words", "has_official")}
            self._shelve(found)
        self.touched.add(found)
        return out

    @staticmethod
    def _change(ticker, event_id: str, row: dict, change: str, detail: str, now: dict) -> tuple:
        return ticker, event_id, row["event_id"], row["at"], change, detail, now["impact_score"], now["direction"]


class Stories(StatefulProcessor):
    """Per ticker: rows that wait, by day and piece, and open stories, by id. A timer at the end of each day takes its rows."""

    def __init__(self, days: int, similarity: float):
        self.days, self.similarity = days, similarity

    def init(self, handle: StatefulProcessorHandle) -> None:
        text_of = lambda name: StructType([StructField(name, StringType())])
        self.handle = handle
        self.waiting = handle.getMapState("waiting", text_of("piece"), text_of("rows"))  # by day/number
        self.pieces = handle.getMapState("pieces", text_of("day"), text_of("n"))
        self.open = handle.getMapState("open", text_of("event_id"), text_of("story"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            by_day: dict[int, list] = {}
            for row in batch[ROW].to_dict("records"):
                row |= {"words": list(row["words"]), "event_types": list(row["event_types"]), "has_official": bool(row["has_official"])}
                by_day.setdefault(int(row["day"]), []).append(row)
            for day, new in by_day.items():
                n = self._pieces(day)
                self.waiting.updateValue((f"{day}/{n}",), (json.dumps(new),))
                self.pieces.updateValue((str(day),), (str(n + 1),))
                if not n:
                    self.handle.registerTimer((day + 1) * DAY_MS - 1)
        yield from ()

    def _pieces(self, day: int) -> int:
        return int(self.pieces.getValue((str(day),))[0]) if self.pieces.containsKey((str(day),)) else 0

    def _taken(self, day: int) -> Iterator[dict]:
        """The rows that wait for a day, which then wait no longer."""
        for n in range(self._pieces(day)):
            yield from json.loads(self.waiting.getValue((f"{day}/{n}",))[0])
            self.waiting.removeKey((f"{day}/{n}",))
        self.pieces.removeKey((str(day),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        day = (expiredTimerInfo.getExpiryTimeInMs() + 1) // DAY_MS - 1
        stories = {k[0]: json.loads(v[0]) for k, v in self.open.iterator()}
        for event_id in [e for e, s in stories.items() if s["day"] + self.days < day]:  # no row of this day or later can continue it
            self.open.removeKey((event_id,))
            del stories[event_id]
        if self._pieces(day):
            shelf, changes = Shelf(stories, self.days, self.similarity), []
            for row in sorted(self._taken(day), key=lambda r: (r["at"], r["event_id"])):
                changes += shelf.take(key[0], row)
            for event_id in shelf.touched:
                self.open.updateValue((event_id,), (json.dumps(shelf.stories[event_id]),))
                self.handle.registerTimer((shelf.stories[event_id]["day"] + self.days + 2) * DAY_MS - 1)  # when it is dropped
            if changes:
                out = pd.DataFrame(changes, columns=COLUMNS)
                yield out.assign(at=pd.to_datetime(out["at"], unit="us"))

    def close(self) -> None:
        pass


def changes(rows: DataFrame, column: str = "ts", late: str = "36 hours", days: int = store.WINDOW_DAYS, similarity: float = store.SIMILARITY) -> DataFrame:
    """Change rows of a stream of (event_id, ticker, ``column``, title, cluster_key, event_types, has_official, relationship,
    impact_score, direction). The session must use the RocksDB state store (``PROVIDER``); ``started`` sets it for one query."""
    folded = text.fold(F.col("title"))
    made = rows.select(
        F.col(column).cast("timestamp").alias("ts"), F.col("ticker").cast("string").alias("ticker"), "event_id", F.unix_micros(F.col(column).cast("timestamp")).alias("at"),
        F.unix_date(F.col(column).cast("date")).alias("day"), folded.alias("title"), F.array_distinct(text.canonical_tokens(folded)).alias("words"),
        F.coalesce("cluster_key", F.lit("")).alias("cluster_key"),
        F.coalesce("event_types", F.array().cast("array<string>")).alias("event_types"), F.coalesce("has_official", F.lit(False)).alias("has_official"), "relationship", F.coalesce("impact_score", F.lit(0)).alias("impact_score"), "direction",
    )
    keyed = made.withWatermark("ts", late).groupBy("ticker")
    return keyed.transformWithStateInPandas(statefulProcessor=Stories(days, similarity), outputStructType=CHANGE, outputMode="Append", timeMode="EventTime")


def drained(stream: DataFrame, folder: str, name: str) -> DataFrame:
    """``streams.drained`` for ``changes``, with the state store that keyed state needs set for this query alone."""
    from newsloom.streaming import streams

    spark, setting = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, PROVIDER)
    try:
        return streams.drained(stream, "append", folder, name).select(*COLUMNS)
    finally:
        spark.conf.set(setting, before) if before else spark.conf.unset(setting)

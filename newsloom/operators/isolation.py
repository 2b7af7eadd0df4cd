"""Failure isolation (RL10): a row that cannot be used is named with its stage and reason, and ends no job.

A ``Step`` makes one column of a row and says, in a column beside it, why it could not: its expressions never raise. Steps of
SQL functions use the ``try_`` forms; Python functions are wrapped by ``attempt``, which returns a value or an error
for every row of an Arrow batch. ``examine`` adds the columns of all steps and the list of failures in one pass over
the rows; ``separate`` writes that once and gives the good rows and the diagnostics.

Defined results: a blank or null input is no failure (its value is null); a row may fail several steps and has a diagnostic for each, in
the order of the steps; repeated rows are diagnosed each; an empty table has neither rows nor diagnostics. ``separate`` raises if a
larger share of rows fails than ``most`` says, so that a broken source does not pass as an empty day."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import dates
from newsloom.operators.graph import written

REASON_CHARS = 120
FAILURES = "array<struct<stage:string,reason:string>>"


@dataclass(frozen=True)
class Step:
    """``column`` takes ``value``; ``reason`` is null unless the row fails at ``stage``."""

    stage: str
    column: str
    value: Column
    reason: Column


def attempt(function: Callable, returns: str) -> Callable[..., Column]:
    """A Python function of one row's values as a function of columns: struct(value, error). What it raises for a row is the row's
    error; nulls are passed on as None."""

    def run(*columns: pd.Series) -> pd.DataFrame:
        done = []
        for row in zip(*columns):
            try:
                done.append((function(*row), None))
            except Exception as error:  # whatever a row's text makes it raise
                done.append((None, f"{type(error).__name__}: {error}"[:REASON_CHARS]))
        return pd.DataFrame(done, columns=["value", "error"], dtype=object)

    run.__annotations__ = {"columns": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, f"struct<value:{returns},error:string>")


def blank(value: Column) -> Column:
    return F.trim(F.coalesce(value.cast("string"), F.lit(""))) == ""


def tried(stage: str, column: str, function: Callable, returns: str, *inputs: Column) -> Step:
    """A step of a Python function; the first input decides whether there is anything to do."""
    got = attempt(lambda first, *more: None if first is None else function(first, *more), returns)(F.when(~blank(inputs[0]), inputs[0]), *inputs[1:])
    return Step(stage, column, got["value"], got["error"])


def dated(stage: str, column: str, raw: Column) -> Step:
    """A step that reads a date of any of the known forms."""
    value = dates.parse_date(raw)
    return Step(stage, column, value, F.when(~blank(raw) & value.isNull(), F.concat(F.lit("no known form: "), F.substring(F.trim(raw), 1, 40))))


def parsed(stage: str, column: str, raw: Column, fields: str) -> Step:
    """A step that reads a JSON object of some fields; what is no such object is named."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    got = F.from_json(F.when(~blank(raw), raw), f"{fields}, _corrupt_record string", options)
    value = F.struct(*[got[name.split()[0]].alias(name.split()[0]) for name in fields.split(", ")])
    bad = got["_corrupt_record"].isNotNull()
    return Step(stage, column, F.when(~bad, value), F.when(bad, F.concat(F.lit("not the expected JSON: "), F.substring(raw, 1, 40))))


def encoded(stage: str, column: str, raw: Column) -> Step:
    """A step that takes text only if it is UTF-8."""
    return Step(stage, column, F.try_validate_utf8(raw), F.when(~F.is_valid_utf8(raw), F.lit("not UTF-8")))


def examine(rows: DataFrame, steps: list[Step]) -> DataFrame:
    """The rows with the steps' columns and ``failures``, in one pass."""
    failures = F.array_compact(F.array(*[F.when(s.reason.isNotNull(), F.struct(F.lit(s.stage).alias("stage"), s.reason.alias("reason"))) for s in steps]))
    return rows.withColumns({s.column: s.value for s in steps} | {"failures": failures.cast(FAILURES)})


def separate(examined: DataFrame, key: str, most: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(good rows, diagnostics (``key``, place, stage, reason)) of examined rows, which are computed once and written. ``most`` is the
    largest share of rows that may fail."""
    kept = written(examined)
    if most < 1:
        total, bad = kept.agg(F.count("*"), F.count(F.when(F.size("failures") > 0, 1))).first()
        if bad > most * total:
            raise ValueError(f"{bad} of {total} rows cannot be used")
    good = kept.filter(F.size("failures") == 0).drop("failures")
    return good, kept.filter(F.size("failures") > 0).select(key, F.posexplode("failures").alias("place", "f")).select(key, "place", "f.*")


def summary(diagnostics: DataFrame, key: str, total: int, source: str = "article_matching", names: int = 2) -> DataFrame:
    """One outcome row of the source report (as ``report.diagnostics`` reads it) for all isolated rows: how many were tried, how many
    were left, and what is wrong with the first few by key. A number and those few reach the driver."""
    bad = diagnostics.select(key).distinct().count()
    first = diagnostics.filter("place = 0").select(F.col(key).cast("string"), "reason").orderBy(key, "reason").limit(names)
    errors = [f"{r[0]}: {r[1]}" for r in first.collect()]
    rows = [(source, bad == 0, False, total, total - bad, total - bad, errors, "; ".join(errors))]
    return diagnostics.sparkSession.createDataFrame(rows, "source string, ok boolean, skipped boolean, attempted long, succeeded long, articles long, errors array<string>, note string")

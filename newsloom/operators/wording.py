"""What scores and directions ask of an event's texts (TX14, TX15), found once for each text.

An event has a row for each company, and rules ask the same of its texts again and again. Here a text gets plain columns, which
rules read; texts needn't be in the rows of companies then. ``rows`` have head_f and text_f, the body is both together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text

# Words of a surprise, of rising and falling, of good and bad news, and of a stop.
SURPRISE = ["beats", "beat", "misses", "miss", "shock", "surprise", "record", "highest", "lowest", "doubles", "halves", "multi-fold", "jumps", "slumps", "surges", "plunges", "collapses", "warns", "profit warning", "sharply", "unexpected", "first time"]
UP = "rises rise rose jumps jump surges surge climbs soars gains gain increases increase higher up rally rallies strengthens expands grows growth boost boosts improves recovery rebound".split() + ["record high"]
DOWN = "falls fall fell drops drop slumps slump declines decline plunges plunge sinks tumbles slides lower down collapse collapses crash crashes weakens slows slowdown contraction shrinks cuts cut glut oversupply loss losses worsens".split() + ["record low"]
GOOD = "approval approved approves nod clearance granted wins won bags secures upgrade upgraded beats outperforms resolved lifted exemption incentive subsidy relief".split() + ["profit rises", "strong demand", "record profit", "expands capacity"]
BAD = "penalty fine fined rejected rejection suspended suspension ban banned recall downgrade downgraded misses shortfall probe investigation raid default fraud strike shutdown halt halted disruption delay delayed cancelled canceled lawsuit breach outage restriction curb crackdown".split() + ["warning letter", "form 483"]
STOPPED = ["disruption", "shutdown", "shortage", "halt", "strike"]

SIDES = ("head", "body")
COLUMNS = ["w_major", "w_surprise", "w_stopped", "w_good", "w_bad", *[f"w_{s}_{what}" for s in SIDES for what in ("up", "down", "ups", "downs")]]


def places(folded: Column, words: list[str]) -> Column:
    """Where some words begin. Places come from the running length of what stands between matches."""
    pattern = text.pattern_of(words)
    gaps = F.transform(F.split(folded, pattern, -1), F.length)
    marks = F.transform(F.regexp_extract_all(folded, F.lit(pattern), F.lit(0)), F.length)
    return F.transform(F.sequence(F.lit(1), F.size(marks)), lambda i: F.aggregate(F.slice(gaps, F.lit(1), i), F.lit(0), lambda a, b: a + b) + F.aggregate(F.slice(marks, F.lit(1), i - 1), F.lit(0), lambda a, b: a + b))


def place_of(folded: Column, term: Column) -> Column:
    """Where a term first occurs; 0 where it doesn't."""
    pattern = F.coalesce(text.phrase_pattern(term), F.lit("(?!)"))
    return F.when(F.regexp_like(folded, pattern), F.length(F.get(F.split(folded, pattern, 2), F.lit(0)))).otherwise(0)


def torn(side: str) -> Column:
    """Has a side words of rising and of falling?"""
    return F.col(f"w_{side}_up") & F.col(f"w_{side}_down")


def worded(rows: DataFrame) -> DataFrame:
    """The rows with COLUMNS, each by one pattern over the text; places only where a side is torn. Columns are plain and used more than
    once, so that Catalyst leaves each step a projection of its own; rows that have them stay as they are."""
    if set(COLUMNS) <= set(rows.columns):
        return rows
    out = rows.withColumn("_body", F.concat_ws(" ", "head_f", "text_f"))
    head, body = F.col("head_f"), F.col("_body")
    has = {"w_major": text.has_magnitude(body)} | {f"w_{n}": text.contains_any(t, words) for n, t, words in (("surprise", body, SURPRISE), ("stopped", body, STOPPED), ("good", head, GOOD), ("bad", head, BAD))}
    both = {f"w_{s}_{n}": text.contains_any(t, words) for s, t in zip(SIDES, (head, body)) for n, words in (("up", UP), ("down", DOWN))}
    at = {f"w_{s}_{n}": F.when(torn(s), places(t, words)) for s, t in zip(SIDES, (head, body)) for n, words in (("ups", UP), ("downs", DOWN))}
    return out.withColumns(has | both).withColumns(at).drop("_body")


def anchored(rows: DataFrame, anchor: Column) -> DataFrame:
    """The rows with w_head_at and w_body_at, the places of their anchor term in torn sides; rows that have them stay as they are."""
    if "w_head_at" in rows.columns:
        return rows
    return rows.withColumns({f"w_{s}_at": F.when(torn(s), place_of(t, anchor)) for s, t in zip(SIDES, (F.col("head_f"), F.concat_ws(" ", "head_f", "text_f")))})


def movement(side: str) -> Column:
    """up, down or null; of both, the nearer to the anchor term, else to the beginning (TX15)."""
    up, down, at = (F.col(f"w_{side}_{n}") for n in ("up", "down", "at"))
    to_up, to_down = (F.array_min(F.transform(f"w_{side}_{n}", lambda p: F.abs(p - F.coalesce(at, F.lit(0))))) for n in ("ups", "downs"))
    return F.when(up & ~down, "up").when(down & ~up, "down").when(torn(side) & (to_up < to_down), "up").when(torn(side) & (to_down < to_up), "down")

"""Occurrences of many phrases in folded texts by one automaton (TX4, LX1).

A lexicon's phrases become sequences of words without plural endings. An Aho-Corasick automaton over words is built once, on the
driver, and sent to the tasks; a text's words, looked up in the automaton's vocabulary, run through it once, whatever
the number of phrases. A sequence that is found is confirmed by the phrase's own pattern, which a task compiles once,
at the place where it stands: word boundaries, every word in singular or plural, words apart by space, dash or slash.
Occurrences of a phrase don't overlap each other and are the leftmost ones; those of different phrases may overlap.

Defined results: null and empty texts have no occurrences; a phrase without letters or digits is never found; places are code points, ends
exclusive; phrases that are equal when folded are one phrase."""

from __future__ import annotations

import re
from array import array
from functools import cached_property

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text

MARKS = "array<struct<phrase:string,start:int,end:int>>"
WORD = re.compile("[a-z0-9]+")


def bare(word: str) -> str:
    """A word without any s at its end."""
    return word.rstrip("s") or "s"


class Automaton:
    """The phrases (folded) of a lexicon; what is compiled or built is made where it is first used."""

    def __init__(self, phrases: list[str]):
        self.phrases = sorted({p for p in phrases if WORD.search(p)})

    @cached_property
    def built(self) -> tuple[dict[str, int], ahocorasick.Automaton | None]:
        words: dict[str, int] = {}
        sequences: dict[tuple[int, ...], list[int]] = {}
        for k, phrase in enumerate(self.phrases):
            key = tuple(words.setdefault(bare(w), len(words) + 1) for w in WORD.findall(phrase))
            sequences.setdefault(key, []).append(k)
        if not sequences:
            return words, None
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, numbers in sequences.items():
            automaton.add_word(key, (len(key), numbers))
        automaton.make_automaton()
        return words, automaton

    @cached_property
    def patterns(self) -> dict[int, tuple[re.Pattern, int]]:
        return {}

    def pattern(self, k: int) -> tuple[re.Pattern, int]:
        """A phrase's pattern, and how many characters it has before its first letter or digit; -1 if its first word has none."""
        if k not in self.patterns:
            first = self.phrases[k].split(" ")[0]
            lead = WORD.search(first)
            self.patterns[k] = (re.compile(text.pattern_of([self.phrases[k]]), re.ASCII), lead.start() if lead else -1)
        return self.patterns[k]

    def __getstate__(self) -> dict:
        return {"phrases": self.phrases}  # built again in each task's process, once

    def occurrences(self, folded: str | None) -> list[tuple[int, int, int]]:
        """(start, end, number of the phrase), in the order in which they end."""
        words, automaton = self.built
        if not folded or automaton is None:
            return []
        starts, ids = [], []
        for m in WORD.finditer(folded):
            starts.append(m.start())
            ids.append(words.get(bare(m[0]), 0))
        found, reached = [], {}
        for last, (length, numbers) in automaton.iter(tuple(ids)):
            for k in numbers:
                pattern, lead = self.pattern(k)
                if lead < 0:
                    if k not in reached:
                        found += [(m.start(), m.end(), k) for m in pattern.finditer(folded)]
                        reached[k] = len(folded)
                    continue
                start = starts[last - length + 1] - lead
                m = pattern.match(folded, start) if start >= reached.get(k, 0) else None
                if m:
                    found.append((start, m.end(), k))
                    reached[k] = m.end()
        return found


def marks_of(automaton: Automaton, texts: pa.Array) -> pa.Array:
    """The occurrences in each of a batch's folded texts. They are kept as numbers of four bytes, and a text is a Python string only
    while it is gone over, so that a batch of texts full of phrases takes little more than its own size."""
    offsets, starts, ends, numbers = (array("i") for _ in range(4))
    offsets.append(0)
    for cell in texts:
        for start, end, number in automaton.occurrences(cell.as_py()):
            starts.append(start)
            ends.append(end)
            numbers.append(number)
        offsets.append(len(numbers))
    offsets, starts, ends, numbers = (pa.Array.from_buffers(pa.int32(), len(a), [None, pa.py_buffer(a)]) for a in (offsets, starts, ends, numbers))
    spans = pa.StructArray.from_arrays([pa.array(automaton.phrases, pa.string()).take(numbers), starts, ends], names=["phrase", "start", "end"])
    return pa.ListArray.from_arrays(offsets, spans)


def marks(sent: Broadcast, folded: Column) -> Column:
    """The occurrences in a column of folded texts of the phrases of an automaton that was sent to the tasks."""

    @F.arrow_udf(MARKS)
    def mark(texts: pa.Array) -> pa.Array:
        return marks_of(sent.value, texts)

    return mark(folded)


def listed(df: DataFrame, *columns: str) -> DataFrame:
    """The phrases of some columns of phrases or of arrays of phrases."""
    arrays = [F.coalesce(F.col(c), F.array().cast("array<string>")) if dict(df.dtypes)[c].startswith("array") else F.array(c) for c in columns]
    return df.select(F.explode(F.concat(*arrays)).alias("phrase"))


def folded_all(phrases: Column) -> Column:
    """An array of phrases, folded."""
    return F.transform(phrases, text.fold)


def occurs(marked: Column, phrase: Column) -> Column:
    return F.exists(marked, lambda m: m["phrase"] == phrase)


def occurs_any(marked: Column, phrases: Column) -> Column:
    return F.exists(marked, lambda m: F.array_contains(phrases, m["phrase"]))


def occurs_outside(marked: Column, phrase: Column, blockers: Column) -> Column:
    """Is there an occurrence of a phrase that lies in none of a blocking phrase (TX6, EX2)? Blockers that only overlap or touch it block
    nothing. Occurrences of blockers are compared by start and end."""
    walls = F.filter(marked, lambda m: F.array_contains(blockers, m["phrase"]))
    inside = lambda m, w: (w["start"] <= m["start"]) & (w["end"] >= m["end"])
    return F.exists(marked, lambda m: (m["phrase"] == phrase) & ~F.exists(walls, lambda w: inside(m, w)))

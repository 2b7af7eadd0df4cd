"""Operator 13: personal data by anchor expansion.

One Aho-Corasick automaton of at-signs, plus signs, digits, schemes and identifier cues runs once over a
text. At each anchor a local parser expands to both sides and validates what it found: an email grows to the
left and right of its at-sign, an address follows its scheme, an account number its cue. Parsers
are deterministic: they use possessive runs only, never step back, and never read what the parser
of that kind has read before, so work grows with the length of the text, whatever it holds.

Kinds. ``email``, ``ip``, ``card`` and ``phone`` are the leftmost matches, not overlapping within a kind, of the patterns
that the query's contract fixes; matches that fail their check (parts above 255, Luhn, number of digits)
are dropped and not tried again. The method adds two: ``address`` is a mail, telephone or web address that names a person
(``mailto:`` and ``sip:`` with a user, ``tel:`` with 5 to 15 digits, ``scheme://user@host``), and ``account`` is the
number behind a cue such as "IBAN" (checked by the remainder of 97) or "account no." (6 to 20 digits, at most three
letters before). Positions are code points, ends exclusive.

Defined results: null text counts as empty and has no spans; every row has its own result, so repeated
rows repeat it and null ids stay; whole texts are read, of any length; spans of different kinds may overlap; other
columns pass by unread, and ``redact`` keeps them under any name; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: In the order in which spans at one place are listed; the first four are fixed by the contract.
KINDS = ["email", "ip", "card", "phone", "address", "account"]
BASE = 4

# What anchors are, all in small letters; texts are compared with A-Z lower-cased.
WEB = ["http://", "https://", "ftp://", "ftps://", "sftp://", "ssh://"]
MAIL = ["mailto:", "sip:", "sips:"]
PHONE = ["tel:", "callto:"]
CUES = [
    "account", "acct", "konto", "kontonummer", "cuenta", "compte", "ssn", "social security", "passport", "passeport", "pasaporte",
    "reisepass", "reisepassnummer", "dni", "nif", "tax id", "steuernummer",
]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
DIGITS = re.compile(r"[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE_RUN = re.compile(r"[ ().0-9-]++")
USER = re.compile(r"[A-Za-z0-9._~!$&'()*+,;=:%-]++@(?:\[[0-9A-Fa-f:.]++\]|[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+)")
MAILBOX = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+")
NUMBER = re.compile(r"\+?[0-9](?:[().-]?[0-9])++")
LINK = re.compile(r"(?i:[ \t]++(?:number|no|nr|num|id|code)\b)?+[ \t]*+[.:#=]*+[ \t]*+")
IDENTIFIER = re.compile(r"[A-Za-z]{0,3}[0-9](?:[ -]?[0-9])*+(?![A-Za-z0-9])")
IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:[ -]?[A-Za-z0-9]){11,30}+")
SPANS = "array<struct<kind:string,start:int,end:int>>"


@cache
def anchors() -> ahocorasick.Automaton:
    """The automaton: each pattern's class and length."""
    automaton = ahocorasick.Automaton()
    words = {"@": "at", "+": "plus", "iban": "iban"} | dict.fromkeys("0123456789", "digit")
    words |= dict.fromkeys(WEB, "web") | dict.fromkeys(MAIL, "mail") | dict.fromkeys(PHONE, "tel") | dict.fromkeys(CUES, "cue")
    for word, kind in words.items():
        automaton.add_word(word, (kind, len(word)))
    automaton.make_automaton()
    return automaton


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    return (sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def iban_end(text: str, at: int) -> int:
    """The end of the longest run from ``at`` that ends at a word's end and leaves 1 when divided by 97; -1 if none."""
    run = IBAN.match(text, at)
    for end in range(run.end() if run else 0, at + 14, -1):
        if text[end - 1].isalnum() and not text[end : end + 1].isalnum():
            letters = re.sub("[ -]", "", text[at:end])
            if len(letters) >= 15 and int("".join(str(int(c, 36)) for c in letters[4:] + letters[:4])) % 97 == 1:
                return end
    return -1


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) of all spans of a text, in order."""
    spans = []
    email_end = ip_next = card_next = 0
    folded = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # only A-Z change, so places stay
    for last, (kind, length) in anchors().iter(folded):
        after = last + 1
        if kind == "digit":
            if last >= card_next:
                run = CARD.match(text, last)
                card_next = run.end() if run else after
                if run and run.end() - last >= 12:
                    digits = run[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        spans.append((last, 2, run.end()))
            if last >= ip_next:
                run = IP.match(text, last)
                ip_next = (run or DIGITS.match(text, last)).end()
                if run and all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in run[0].split(".")):
                    spans.append((last, 1, run.end()))
        elif kind == "at":
            start = last
            while start > email_end and text[start - 1] in LOCAL:
                start -= 1
            run = DOMAIN.match(text, after) if start < last else None
            if run:
                email_end = run.end()
                spans.append((start, 0, email_end))
        elif kind == "plus":
            run = PHONE_RUN.match(text, after + 1) if text[after : after + 1] in set("0123456789") else None
            body = run[0].rstrip(" ().-") if run else ""
            if len(body) >= 2 and 9 <= 1 + len(re.sub("[^0-9]", "", body)) <= 15:
                spans.append((last, 3, after + 1 + len(body)))
        else:
            start = after - length
            if start and text[start - 1].isalnum():
                continue
            if kind in ("web", "mail"):
                run = (USER if kind == "web" else MAILBOX).match(text, after)
                if run:
                    spans.append((start, 4, run.end()))
            elif kind == "tel":
                run = NUMBER.match(text, after)
                if run and 5 <= len(re.sub("[^0-9]", "", run[0])) <= 15:
                    spans.append((start, 4, run.end()))
            elif not text[after : after + 1].isalnum():
                at = LINK.match(text, after).end()
                if kind == "iban":
                    end = iban_end(text, at)
                else:
                    run = IDENTIFIER.match(text, at)
                    end = run.end() if run and 6 <= len(re.sub("[^0-9]", "", run[0])) <= 20 else -1
                if end > 0:
                    spans.append((at, 5, end))
    return sorted(set(spans))


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in find(t.as_py() or "")] for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, span)], names=["doc_id", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for every row; spans by start, then kind as listed."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scanned, f"doc_id long, spans {SPANS}")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans in writing."""
    base = F.filter("spans", lambda s: s["kind"].isin(KINDS[:BASE]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select("doc_id", *[count(kind) for kind in KINDS[:BASE]], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets, overlapping spans by the first one's."""
    parts, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            parts += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced by the kind; ``n_chars``, if there, follows. Texts without spans and all
    other columns stay as they were."""
    place, size = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns
            texts = batch.column(place).to_pylist()
            found = [find(t or "") for t in texts]
            new = [masked(t, spans) if spans else t for t, spans in zip(texts, found)]
            columns[place] = pa.array(new, batch.schema.field(place).type)
            if size >= 0:
                kept = batch.column(size).to_pylist()
                columns[size] = pa.array([len(t) if spans else n for t, spans, n in zip(new, found, kept)], batch.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(work, docs.withColumn("text", F.col("text").cast("string")).schema)

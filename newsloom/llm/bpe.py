"""Operator 1: byte-level BPE encoding and decoding.

Texts are cut into pre-tokens without a regular expression. Every code point gets a class from an
array; each class stands for a transition function of a small automaton, and functions compose
associatively, so prefixes of the composition are found block by block with array lookups. The
automaton's state and the class of the next code point tell where a pre-token starts. The slices
go through a bounded cache of merged pairs, found by a hash and confirmed by their code points; slices
that are new are merged together, all words of one length at a time. Offsets of tokens in the UTF-8 bytes are kept and used to decode.

Defined results: null text counts as empty; empty text has no ids and decodes to no bytes; other
columns of the input are ignored, so their names cannot clash; repeated rows give repeated rows; an
empty table gives no rows. ``encode`` takes every text as ordinary text; ``encode_added`` finds the
vocabulary file's added tokens in a text first, as that file's library does.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The public split pattern these tables stand for knows the contractions
# 's 't 'm 'd and 're 've 'll, and white space as Unicode's White_Space property.
SHORT_ENDS = "stmd"
LONG_ENDS = ("re", "ve", "ll")
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

LETTER, NUMBER, OTHER, SPACE, SPACE_LAST, WHITE, WHITE_LAST, QUOTE1, QUOTE2, GAP = range(10)
START, IN_WHITE, IN_SPACE, IN_LETTER, IN_NUMBER, IN_OTHER, LEFT2, LEFT1, CLOSED = range(9)
BLOCK = 512
CACHE_ENTRIES = 600_000
LONG_WORD = 48
TEXT_CHARS = 1 << 20
NO_RANK = np.int32(2**31 - 1)


def _step(state: int, kind: int) -> int:
    if kind == GAP:
        return START
    if state == LEFT2:
        return LEFT1
    if state == LEFT1:
        return CLOSED
    if kind in (QUOTE1, QUOTE2):
        if state in (IN_SPACE, IN_OTHER):
            return IN_OTHER
        return LEFT1 if kind == QUOTE1 else LEFT2
    return {LETTER: IN_LETTER, NUMBER: IN_NUMBER, OTHER: IN_OTHER, SPACE: IN_SPACE, SPACE_LAST: IN_SPACE}.get(kind, IN_WHITE)


def _starts_piece(state: int, kind: int) -> bool:
    if kind == GAP or state == START:
        return True
    if state in (LEFT2, LEFT1):
        return False
    if kind in (SPACE, WHITE):
        return state not in (IN_WHITE, IN_SPACE)
    if kind in (SPACE_LAST, WHITE_LAST):
        return True
    open_run = {LETTER: IN_LETTER, NUMBER: IN_NUMBER}.get(kind, IN_OTHER)
    return state not in (open_run, IN_SPACE)


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(function of each class, composition table, functions as rows of states, start table)."""
    functions = [tuple(_step(s, k) for s in range(9)) for k in range(10)]
    number = {f: i for i, f in enumerate(dict.fromkeys(functions))}
    todo = list(number)
    generators = list(number)
    while todo:
        f = todo.pop()
        for g in generators:
            h = tuple(g[s] for s in f)
            if h not in number:
                number[h] = len(number)
                todo.append(h)
    rows = np.array(list(number), dtype=np.uint8)
    size = len(rows)
    compose = np.zeros((size, size), dtype=np.uint16)
    for f, i in number.items():
        for g, j in number.items():
            compose[i, j] = number[tuple(g[s] for s in f)]
    of_class = np.array([number[f] for f in functions], dtype=np.uint16)
    starts = np.array([[_starts_piece(s, k) for k in range(10)] for s in range(9)])
    return of_class, compose, rows, starts


@lru_cache(1)
def class_table() -> np.ndarray:
    kinds = np.full(0x110000, OTHER, dtype=np.uint8)
    category = unicodedata.category
    for c in range(0x110000):
        major = category(chr(c))[0]
        if major == "L":
            kinds[c] = LETTER
        elif major == "N":
            kinds[c] = NUMBER
    kinds[WHITE_SPACE] = WHITE
    kinds[0x20] = SPACE
    return kinds


def classes(codes: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """The class of each code point, with what the automaton must know of the code points after it."""
    kinds = class_table()[codes]
    kinds[gaps] = GAP
    white = (kinds == SPACE) | (kinds == WHITE)
    ends = white.copy()
    ends[:-1] &= ~white[1:] & (kinds[1:] != GAP)
    ends[-1:] = False
    kinds[ends] += 1  # SPACE -> SPACE_LAST, WHITE -> WHITE_LAST
    quotes = np.flatnonzero(codes == 0x27)
    quotes = quotes[kinds[quotes] == OTHER]
    if len(quotes):
        padded = np.append(codes, np.zeros(2, codes.dtype))
        padded[gaps] = 0
        one, two = padded[quotes + 1], padded[quotes + 2]
        kinds[quotes[np.isin(one, [ord(c) for c in SHORT_ENDS])]] = QUOTE1
        for a, b in LONG_ENDS:
            kinds[quotes[(one == ord(a)) & (two == ord(b))]] = QUOTE2
    return kinds


def piece_starts(codes: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """Positions at which a pre-token starts; positions of gaps are among them."""
    n = len(codes)
    if not n:
        return np.zeros(0, dtype=np.int64)
    of_class, compose, rows, starts = automaton()
    kinds = classes(codes, gaps)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, GAP, dtype=np.uint8)
    padded[:n] = kinds
    functions = of_class[padded].reshape(blocks, BLOCK).T.copy()  # a row: the k-th code point of every block
    flat, width = compose.ravel(), compose.shape[1]
    for k in range(1, BLOCK):
        functions[k] = flat[functions[k - 1].astype(np.int32) * width + functions[k]]
    begin = np.empty(blocks, dtype=np.uint8)
    state, table = START, rows.tolist()
    for b, f in enumerate(functions[-1].tolist()):
        begin[b] = state
        state = table[f][state]
    states = np.empty((BLOCK, blocks), dtype=np.uint8)
    states[0] = begin
    states[1:] = rows.ravel()[functions[:-1].astype(np.int32) * 9 + begin]
    before = states.T.ravel()[:n]
    return np.flatnonzero(starts.ravel()[before.astype(np.int16) * 10 + kinds])


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: base64 and number on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def read_json(path: str) -> dict[bytes, int]:
    """The same of a byte-level vocabulary in JSON, whose ids must follow the order of its merges.
    Its tokens write each byte as a printable character: bytes that print stand for themselves,
    the others for the code points from 256 on."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown}
    byte_of.update((chr(256 + i), b) for i, b in enumerate(b for b in range(256) if b not in set(shown)))
    ranks, last = {}, -1
    for token, number in model["vocab"].items():
        if len(token) == 1:
            ranks[bytes([byte_of[token]])] = number
    for merge in model["merges"]:
        token = "".join(merge.split(" ") if isinstance(merge, str) else merge)
        number = model["vocab"][token]
        if number < last:
            raise ValueError("the ids of this vocabulary don't follow its merges")
        ranks[bytes(byte_of[c] for c in token)] = last = number
    return ranks


def read_added(path: str) -> dict[str, int]:
    """Added tokens of a JSON vocabulary: strings that are found in a text as they stand."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens") or []
    if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized") for t in added):
        raise ValueError("this vocabulary has added tokens that aren't plain strings")
    return {t["content"]: t["id"] for t in added}


class Grown:
    """An array with room to grow."""

    def __init__(self, kind):
        self.room, self.size = np.zeros(1024, dtype=kind), 0

    def extend(self, more: np.ndarray) -> None:
        if self.size + len(more) > len(self.room):
            self.room = np.concatenate([self.values, np.zeros(max(len(self.room), len(more)), self.room.dtype)])
        self.room[self.size : self.size + len(more)] = more
        self.size += len(more)

    @property
    def values(self) -> np.ndarray:
        return self.room[: self.size]


class HashTable:
    """Numbers found by unsigned 64-bit keys (not 0), many keys at once; open addressing."""

    def __init__(self, room: int):
        bits = max(6, (room - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, dtype=np.uint64)
        self.values = np.full(1 << bits, -1, dtype=np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where there is none."""
        slots = self._slots(keys)
        there = self.keys[slots]
        out = np.where(there == keys, self.values[slots], np.int32(-1))
        rest = np.flatnonzero((there != keys) & (there != 0))
        while len(rest):
            slots[rest] = (slots[rest] + 1) & self.mask
            there = self.keys[slots[rest]]
            same = there == keys[rest]
            out[rest[same]] = self.values[slots[rest[same]]]
            rest = rest[~same & (there != 0)]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Puts distinct keys that are not there yet."""
        slots = self._slots(keys)
        while len(keys):
            first = np.zeros(len(keys), dtype=bool)
            first[np.unique(slots, return_index=True)[1]] = True
            put = first & (self.keys[slots] == 0)
            self.keys[slots[put]], self.values[slots[put]] = keys[put], values[put]
            rest = ~put
            slots = slots[rest]
            slots = (slots + (self.keys[slots] != 0)) & self.mask
            keys, values = keys[rest], values[rest]


@lru_cache(1)
def powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    base = 0x2545F4914F6CDD1D
    both = []
    for b in (base, pow(base, -1, 1 << 64)):
        out, done = np.ones(count, dtype=np.uint64), 1
        while done < count:
            step = np.uint64(pow(b, done, 1 << 64))
            out[done : 2 * done] = out[: min(done, count - done)] * step
            done *= 2
        both.append(out)
    return both[0], both[1]


def piece_hashes(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash (not 0) of the code points of each piece."""
    up, down = powers(1 << (len(codes)).bit_length())
    mixed = codes * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0xA0761D6478BD642F)
    mixed ^= mixed >> np.uint64(29)
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(mixed * up[: len(codes)], out=sums[1:])
    ends = np.append(starts[1:], len(codes))
    hashes = (sums[ends] - sums[starts]) * down[starts]
    return hashes ^ (hashes >> np.uint64(31)) | np.uint64(1)


class Merges:
    """The ranks of a rank file, with merging of many words at once."""

    def __init__(self, path: str):
        self.ranks = ranks = read_json(path) if path.endswith(".json") else read_ranks(path)
        self.added = read_added(path) if path.endswith(".json") else {}
        self.size = max([*ranks.values(), *self.added.values()]) + 1
        self.tokens: list[bytes] = [b""] * self.size
        for token, rank in [*ranks.items(), *((t.encode(), i) for t, i in self.added.items())]:
            self.tokens[rank] = token
        # the longest of the strings that start at one place is taken
        self.cut_added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.blob = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        self.blob_start = np.cumsum(self.lengths) - self.lengths
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[(left << 20) | right] = rank
        self.table = HashTable(len(pairs) * 4)
        self.table.add(np.array(list(pairs), dtype=np.uint64) + np.uint64(1), np.arange(len(pairs), dtype=np.int32))
        self.pair_ranks = np.array(list(pairs.values()), dtype=np.int32)
        self.forget()

    def forget(self) -> None:
        """Empties the cache of merged words."""
        self.cache = HashTable(CACHE_ENTRIES * 4)
        self.ids, self.id_starts, self.id_counts = Grown("<u4"), Grown(np.int64), Grown(np.int64)
        self.codes, self.code_starts, self.code_counts = Grown("<u4"), Grown(np.int64), Grown(np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that two adjacent tokens make, NO_RANK if they make none."""
        found = self.table.find(((left.astype(np.uint64) << np.uint64(20)) | right.astype(np.uint64)) + np.uint64(1))
        return np.where(found >= 0, self.pair_ranks[found], NO_RANK)

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by_length.setdefault(len(word), []).append(i)
        for length, places in by_length.items():
            if length > LONG_WORD:
                for i in places:
                    out[i] = self._merge_long(words[i])
                continue
            for low in range(0, len(places), 4096):
                part = places[low : low + 4096]
                block = np.frombuffer(b"".join(words[i] for i in part), dtype=np.uint8).reshape(len(part), length)
                for i, ids in zip(part, self._merge_block(self.of_byte[block])):
                    out[i] = ids
        return out

    def _merge_block(self, ids: np.ndarray) -> list[bytes]:
        count, width = ids.shape
        used = np.full(count, width)
        if width > 1:
            ranks = self.rank_of(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(count, width - 1)
            live = np.arange(count)
            while width > 1:
                at = ranks[live].argmin(axis=1)
                best = ranks[live, at]
                keep = best != NO_RANK
                live, at, best = live[keep], at[keep], best[keep]
                if not len(live):
                    break
                columns = np.arange(width - 1)
                moved = columns[None, :] > at[:, None]
                rows = ids[live]
                rows[:, :-1] = np.where(moved, rows[:, 1:], rows[:, :-1])
                rows[np.arange(len(live)), at] = best
                rows[:, -1] = -1
                ids[live] = rows
                near = ranks[live]
                near[:, :-1] = np.where(moved[:, :-1], near[:, 1:], near[:, :-1])
                near[:, -1] = NO_RANK
                used[live] -= 1
                each = np.arange(len(live))
                has_left = at > 0
                e, a = each[has_left], at[has_left]
                near[e, a - 1] = self.rank_of(rows[e, a - 1], rows[e, a])
                has_right = at < used[live] - 1
                near[each[~has_right], np.minimum(at[~has_right], width - 2)] = NO_RANK
                e, a = each[has_right], at[has_right]
                near[e, a] = self.rank_of(rows[e, a], rows[e, a + 1])
                ranks[live] = near
        raw = ids.astype("<u4")
        return [raw[i, :n].tobytes() for i, n in enumerate(used.tolist())]

    def _merge_long(self, word: bytes) -> bytes:
        """A heap of pairs over a linked list, for words that a rectangle of pairs would not suit."""
        ids = self.of_byte[np.frombuffer(word, dtype=np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks, tokens, gone = self.ranks, self.tokens, [False] * n
        whole = np.array(ids)
        first = self.rank_of(whole[:-1], whole[1:])
        heap = [(int(first[i]), i, ids[i], ids[i + 1]) for i in np.flatnonzero(first != NO_RANK).tolist()]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if not gone[i] else n
            if gone[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], gone[j] = rank, True
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and (y := after[x]) < n and (r := ranks.get(tokens[ids[x]] + tokens[ids[y]])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return np.array([ids[i] for i in range(n) if not gone[i]], dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed; texts are taken together up to TEXT_CHARS code points."""
        out: list[bytes] = []
        for ids, counts in self.encode_parts(texts):
            packed, ends = ids.tobytes(), (np.cumsum(counts) * 4).tolist()
            out += [packed[a:b] for a, b in zip([0, *ends], ends)]
        return out

    def encode_parts(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of some texts one after another, how many each of these texts has)."""
        low, chars = 0, 0
        for high, text in enumerate(texts):
            chars += len(text)
            if chars >= TEXT_CHARS or high == len(texts) - 1:
                yield self._encode(texts[low : high + 1])
                low, chars = high + 1, 0

    def encode_added(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """As ``encode_parts``, but added tokens inside a text have their own ids, and the texts between
        them are encoded each for itself."""
        if self.cut_added is None or not any(map(self.cut_added.search, texts)):
            yield from self.encode_parts(texts)
            return
        for text in texts:
            between = self.cut_added.split(text)
            own = [np.array([self.added[t]], "<u4") for t in self.cut_added.findall(text)] + [np.zeros(0, "<u4")]
            ids = np.concatenate([x for packed, i in zip(self.encode(between), own) for x in (np.frombuffer(packed, "<u4"), i)])
            yield ids, np.array([len(ids)])

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "\0".join(texts) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        gaps = np.cumsum([len(t) + 1 for t in texts]) - 1
        starts = piece_starts(codes, gaps)
        hashes = piece_hashes(codes, starts)
        at_gaps = np.searchsorted(starts, gaps)
        hashes[at_gaps] = 0  # a gap is a piece of its own, and has no ids
        if max(self.id_counts.size, self.ids.size // 8, self.codes.size // 16) > CACHE_ENTRIES:
            self.forget()
        if not self.id_counts.size:
            self._remember([b""], codes[gaps[:1]], [1])
        bounds = np.append(starts, len(codes))
        sizes = np.diff(bounds)
        found = self.cache.find(hashes)
        found[at_gaps] = 0
        new = np.flatnonzero(found < 0)
        if len(new):
            keys, first, inverse = np.unique(hashes[new], return_index=True, return_inverse=True)
            found[new] = self._learn(joined, codes, bounds, new[first], keys) + inverse
        other = self._differ(codes, starts, sizes, found)
        other = other[hashes[other] != 0]
        if len(other):  # pieces whose hash is another piece's
            words: dict[str, int] = {}
            inverse = [words.setdefault(joined[a:b], len(words)) for a, b in zip(bounds[other].tolist(), bounds[other + 1].tolist())]
            first = np.unique(inverse, return_index=True)[1]
            found[other] = self._learn(joined, codes, bounds, other[first], None) + np.array(inverse)
        lengths = self.id_counts.values[found]
        ends = np.cumsum(lengths)
        ids = self.ids.values[np.repeat(self.id_starts.values[found] - (ends - lengths), lengths) + np.arange(ends[-1])]
        at = ends[at_gaps]
        return ids, np.diff(at, prepend=0)

    def _differ(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Pieces whose code points are not those of the word they were found as."""
        same_size = self.code_counts.values[found] == sizes
        known = np.where(same_size, self.code_starts.values[found], 0)
        place = np.repeat(np.where(same_size, known - starts, 0), sizes) + np.arange(len(codes))
        kept = self.codes.values
        wrong = kept[np.minimum(place, len(kept) - 1)] != codes
        differ = ~same_size
        if wrong.any():
            differ |= np.add.reduceat(wrong, starts) > 0
        return np.flatnonzero(differ)

    def _learn(self, joined: str, codes: np.ndarray, bounds: np.ndarray, at: np.ndarray, keys: np.ndarray | None) -> int:
        """Merges the pieces ``at`` and keeps them, by ``keys`` if given; the number of the first."""
        number, low, high = self.id_counts.size, bounds[at], bounds[at + 1]
        packed = self.merge_words([joined[a:b].encode() for a, b in zip(low.tolist(), high.tolist())])
        sizes = high - low
        ends = np.cumsum(sizes)
        self._remember(packed, codes[np.repeat(low - (ends - sizes), sizes) + np.arange(ends[-1])], sizes)
        if keys is not None and number + len(keys) <= 2 * CACHE_ENTRIES:
            self.cache.add(keys, np.arange(number, number + len(keys), dtype=np.int32))
        return number

    def _remember(self, packed: list[bytes], codes: np.ndarray, sizes) -> None:
        counts = np.fromiter((len(x) // 4 for x in packed), dtype=np.int64, count=len(packed))
        sizes = np.asarray(sizes, dtype=np.int64)
        self.id_starts.extend(self.ids.size + np.cumsum(counts) - counts)
        self.id_counts.extend(counts)
        self.ids.extend(np.frombuffer(b"".join(packed), dtype="<u4"))
        self.code_starts.extend(self.codes.size + np.cumsum(sizes) - sizes)
        self.code_counts.extend(sizes)
        self.codes.extend(codes)

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """First byte of each token in the UTF-8 text."""
        lengths = self.lengths[ids]
        return np.cumsum(lengths) - lengths

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """Bytes of the tokens, each put at its offset."""
        if not len(ids):
            return b""
        lengths = self.lengths[ids]
        place = np.repeat(self.blob_start[ids] - offsets, lengths)
        return self.blob[place + np.arange(len(place))].tobytes()


@lru_cache(2)
def merges(path: str) -> Merges:
    return Merges(path)


def _encode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    tool = merges(path)
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            ids = tool.encode([t or "" for t in part.column(1).to_pylist()])
            offsets = [tool.offsets(np.frombuffer(x, dtype="<u4")).astype("<u4").tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(offsets, pa.binary())], names=["doc_id", "ids", "offsets"])


def _decode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    tool = merges(path)
    for batch in batches:
        for low in range(0, batch.num_rows, 512):
            part = batch.slice(low, 512)
            raw = [tool.decode(np.frombuffer(a, dtype="<u4").astype(np.int64), np.frombuffer(b, dtype="<u4").astype(np.int64)) for a, b in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(raw, pa.binary())], names=["doc_id", "ids", "decoded"])


def encode_documents(docs: DataFrame, ranks_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, ids, offsets): ids and byte offsets of the tokens, packed as little-endian unsigned
    32-bit integers. No shuffle: each partition of the input is encoded where it is read."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        lambda batches: _encode_batches(batches, ranks_path), "doc_id long, ids binary, offsets binary"
    )


def decode_documents(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, ids, decoded): the bytes that the ids stand for."""
    return encoded.select("doc_id", "ids", "offsets").mapInArrow(lambda batches: _decode_batches(batches, ranks_path), "doc_id long, ids binary, decoded binary")


def _digest_batches(decoded: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in decoded:
        ids, raw = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        digests = [pa.array([hashlib.sha256(x).hexdigest() for x in side]) for side in (ids, raw)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), *digests], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def round_trip(docs: DataFrame, ranks_path: str) -> DataFrame:
    """Digests of the encoded and the decoded documents. Encoding, decoding and digests run one
    after another in one Python worker, some hundred documents at a time, so ids never travel."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        lambda batches: _digest_batches(_decode_batches(_encode_batches(batches, ranks_path), ranks_path)),
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )

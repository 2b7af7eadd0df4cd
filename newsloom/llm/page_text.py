"""Operator 2: main text of HTML pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags, each with the path of open tags
(names, classes, ids, roles). A bidirectional LSTM in numpy reads, for every block of the page in
order, hashed vectors of its tag path and of its words, and says whether the block belongs to the article.
The network is trained here, on pages built from layouts with known labels, filled with words of
a bounded sample of the given pages (``SAMPLE_PAGES``); its weights are a few thousand numbers that
go to the tasks with the function. In part of them names of classes and ids mean nothing, so that tags, links, lengths
and places must tell. Every page is then labelled where it is read; a long page is read in stretches of
``STRETCH`` blocks, forwards and backwards, with the network's state carried on.

Defined results: null or empty html has an empty text; scripts, styles, templates, frames, drawings, comments and markup never
count as text; character references are decoded, white space inside a block becomes one space, blocks are
joined in page order by one space; unclosed tags end with their parents; tags may be nested to any depth, at a fixed
cost each; text without tags is one block; a block whose score is exactly 0 is left out; repeated rows have a row each;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES = 64
PATH_SIZE, LEAF_SIZE, WORD_SIZE, FACTS = 320, 64, 24, 5
INPUT = PATH_SIZE + LEAF_SIZE + WORD_SIZE + FACTS
HIDDEN = 16
TRAIN_PAGES, EPOCHS, BATCH, RATE = 1500, 10, 32, 0.01
PAGES_AT_ONCE, STRETCH = 128, 8192
SAMPLE_WORDS = 1 << 15
LABEL = ""  # stands before main blocks in training pages only

# HTML's void elements, elements whose content is no text, and inline elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style template iframe svg".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mrow mi mn mo msup msub mfrac msqrt mtext".split())
#: An opening tag closes an open one of these within the nearest block.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

OPENING = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*+))")
#: What stands between a tag's name and its end, where quotes hold.
QUOTED = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@lru_cache(50_000)
def _names(attributes: str) -> tuple[str, ...]:
    out = []
    for kind, *values in ATTRIBUTE.findall(attributes):
        out += [x.lower() for x in NAME_PART.findall(next((v for v in values if v), ""))]
    return tuple(out)


@lru_cache(50_000)
def _slot(kind: str, token: str, size: int) -> int:
    return zlib.crc32(f"{kind}:{token}".encode()) % size


class Node(NamedTuple):
    """An open tag: its name, the slots of its path so far as bits, and the nearest two block tags with their names."""

    name: str
    bits: int
    blocks: tuple[tuple[str, tuple[str, ...]], ...]


ROOT = Node("", 0, ())


def opened(parent: Node, name: str, parts: tuple[str, ...]) -> Node:
    bits = parent.bits if name in ("html", "body") else parent.bits | 1 << _slot("tag", name, PATH_SIZE)
    for part in parts:
        bits |= 1 << _slot("name", part, PATH_SIZE)
    return Node(name, bits, parent.blocks if name in INLINE else ((name, parts), *parent.blocks[:1]))


@lru_cache(20_000)
def _path_vector(bits: int, blocks: tuple[tuple[str, tuple[str, ...]], ...]) -> np.ndarray:
    vector = np.zeros(PATH_SIZE + LEAF_SIZE, dtype=np.float32)
    raw = np.frombuffer(bits.to_bytes(PATH_SIZE // 8, "little"), dtype=np.uint8)
    vector[:PATH_SIZE] = np.unpackbits(raw, bitorder="little")
    for depth, (name, parts) in enumerate(blocks or (("", ()),)):
        for token in (name, *parts):
            vector[PATH_SIZE + _slot(f"leaf{depth}", token, LEAF_SIZE)] = 1
    return vector


class Tags:
    """The tags of a page from left to right, in one scan: what is read for a tag is passed by it. An unclosed comment runs to the end; a tag
    ends at the first > outside of quotes, or at the first > if quotes don't end; behind the last > all is text."""

    def __init__(self, page: str):
        self.page, self.last, self.ends = page, page.rfind(">"), None

    def _end(self, at: int) -> int:
        """Behind the end of a tag whose attributes begin at ``at``."""
        found = QUOTED.match(self.page, at) if self.ends is None else None
        if found:
            return found.end()
        if self.ends is None:  # quotes don't end: ends are worked out once for all places, from the right
            self.ends = self._all_ends()
        places, ends = self.ends
        k = bisect_left(places, at)
        return ends[k] if k < len(ends) and ends[k] else self.page.index(">", at) + 1

    def _all_ends(self) -> tuple[list[int], list[int]]:
        """Quotes and >, and where a tag ends that is outside of quotes there; 0 where quotes don't end."""
        places = [m.start() for m in re.finditer("[>\"']", self.page)]
        ends, seen = [0] * (len(places) + 1), {}
        for k in range(len(places) - 1, -1, -1):
            mark = self.page[places[k]]
            if mark == ">":
                ends[k] = places[k] + 1
            else:
                ends[k] = ends[seen[mark] + 1] if mark in seen else 0
                seen[mark] = k
        return places, ends

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, closes, name, attributes) of the next tag, or of what is skipped as one, without a name."""
        found = OPENING.search(self.page, at)
        if not found:
            return None
        start, at = found.span()
        if found[0] == "<!--":
            end = self.page.find("-->", at)
            return start, end + 3 if end >= 0 else len(self.page), False, "", ""
        if at > self.last:  # no tag can end here, but a comment can begin
            comment = self.page.find("<!--", start)
            return (comment, len(self.page), False, "", "") if comment >= 0 else None
        if not found[2]:
            return start, self.page.index(">", at) + 1, False, "", ""
        end = self._end(at)
        return start, end, bool(found[1]), found[2].lower(), self.page[at : end - 1]


def leaves(page: str) -> list[tuple[Node, str, int]]:
    """(innermost open tag, text, characters inside links) of the page's blocks, in order."""
    out: list[tuple[Node, str, int]] = []
    stack: list[Node] = [ROOT]
    blocks: list[int] = []  # where block tags are in the stack
    open_names: Counter[str] = Counter()
    text: list[str] = []
    linked, at, size = 0, 0, len(page)
    place: Node | None = None

    def flush() -> None:
        nonlocal linked, place
        if text:
            whole = " ".join(entities.unescape("".join(text)).split())
            if whole:
                out.append((place or ROOT, whole, min(linked, len(whole))))
            text.clear()
        linked, place = 0, None

    def add(piece: str) -> None:
        nonlocal linked, place
        if place is None and not piece.isspace():
            place = stack[-1]
        text.append(piece)
        if open_names["a"]:
            linked += len(piece)

    def shut(k: int) -> None:
        open_names.subtract(x.name for x in stack[k:])
        del stack[k:]
        while blocks and blocks[-1] >= k:
            blocks.pop()

    tags = Tags(page)
    while at < size:
        found = tags.next(at)
        if not found:
            add(page[at:])
            break
        if found[0] > at:
            add(page[at : found[0]])
        _, at, closing, name, rest = found
        if not name:
            continue
        if name == "br":
            add(" ")
            continue
        if name not in INLINE:
            flush()
        if closing:
            if open_names[name] > 0:
                k = len(stack) - 1
                while stack[k].name != name:
                    k -= 1
                shut(k)
            continue
        if name in RAW:
            if not rest.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.end() if end else size
            continue
        if name in VOID:
            continue
        # only the nearest block can end by an opening tag
        if name not in INLINE and blocks and (stack[blocks[-1]].name == "p" or stack[blocks[-1]].name in CLOSES.get(name, ())):
            shut(blocks[-1])
        if name not in INLINE:
            blocks.append(len(stack))
        stack.append(opened(stack[-1], name, _names(rest) if rest else ()))
        open_names[name] += 1
    flush()
    return out


class _WordSlots(dict):
    """The slot of each word, computed once while the table is small enough."""

    def __missing__(self, word: str) -> int:
        slot = zlib.crc32(word.encode()) % WORD_SIZE
        if len(self) < 200_000:
            self[word] = slot
        return slot


WORD_SLOTS = _WordSlots()


def features(blocks: list[tuple[Node, str, int]]) -> np.ndarray:
    made, slot = np.zeros((len(blocks), INPUT), dtype=np.float32), WORD_SLOTS.__getitem__
    for row, (node, text, linked) in zip(made, blocks):
        row[: PATH_SIZE + LEAF_SIZE] = _path_vector(node.bits, node.blocks)
        words = text.split()
        counts = np.bincount(np.fromiter(map(slot, words), np.int64, len(words)), minlength=WORD_SIZE)
        low = PATH_SIZE + LEAF_SIZE
        row[low : low + WORD_SIZE] = np.sqrt(counts / len(words))
        row[low + WORD_SIZE :] = np.log1p(len(text)) / 5, linked / len(text), len(words) < 4, text[-1] in ".!?…", np.log1p(len(words)) / 5
    return made


class Network:
    """A bidirectional LSTM with one output a step."""

    def __init__(self, seed: int):
        draw = np.random.default_rng(seed)
        make = lambda *shape: (draw.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.w = {"out": make(2 * HIDDEN, 1), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.w |= {f"x{d}": make(INPUT, 4 * HIDDEN), f"h{d}": make(HIDDEN, 4 * HIDDEN), f"b{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.w[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, kept: list | None = None, state: list | None = None) -> np.ndarray:
        """Hidden states of one direction; x is (time, pages, inputs). A padded step changes nothing. ``state`` has
        what an earlier stretch ended with, and then what this one ends with."""
        steps, pages = x.shape[:2]
        inputs = x @ self.w[f"x{d}"] + self.w[f"b{d}"]
        h, c = state if state else (np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32))
        out = np.zeros((steps, pages, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = inputs[t] + h @ self.w[f"h{d}"]
            gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            new_c = f * c + i * g
            tanh_c = np.tanh(new_c)
            m = mask[t][:, None]
            if kept is not None:
                kept.append((t, h, c, i, f, o, g, tanh_c, m))
            h, c = m * o * tanh_c + (1 - m) * h, m * new_c + (1 - m) * c
            out[t] = h
        if state is not None:
            state[:] = h, c
        return out

    def long_scores(self, blocks: list) -> np.ndarray:
        """Scores of one page's blocks, with the features of one stretch at a time."""
        states, lows = {d: np.zeros((len(blocks), HIDDEN), np.float32) for d in "fb"}, range(0, len(blocks), STRETCH)
        for d, order in (("f", lows), ("b", reversed(lows))):
            state: list = []
            for low in order:
                x = features(blocks[low : low + STRETCH])[:, None, :]
                states[d][low : low + STRETCH] = self._run(x, np.ones(x.shape[:2], np.float32), d, None, state)[:, 0]
        return (np.concatenate([states["f"], states["b"]], axis=1) @ self.w["out"])[:, 0] + self.w["bias"]

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        states = np.concatenate([self._run(x, mask, d, None) for d in "fb"], axis=2)
        return (states @ self.w["out"])[:, :, 0] + self.w["bias"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        kept = {"f": [], "b": []}
        states = np.concatenate([self._run(x, mask, d, kept[d]) for d in "fb"], axis=2)
        z = (states @ self.w["out"])[:, :, 0] + self.w["bias"]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * mask / mask.sum()
        grads = {"out": np.einsum("tph,tp->h", states, error)[:, None], "bias": error.sum(keepdims=True)[0]}
        for k, d in enumerate("fb"):
            from_out = error[:, :, None] * self.w["out"][k * HIDDEN : (k + 1) * HIDDEN, 0]
            dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            gh = np.zeros_like(self.w[f"h{d}"])
            dh, dc = np.zeros((x.shape[1], HIDDEN), np.float32), np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, h, c, i, f, o, g, tanh_c, m in reversed(kept[d]):
                dh = dh + from_out[t]
                inner, cell = m * dh, m * dc
                cell = cell + inner * o * (1 - tanh_c**2)
                dz = np.concatenate([cell * g * i * (1 - i), cell * c * f * (1 - f), inner * tanh_c * o * (1 - o), cell * i * (1 - g**2)], axis=1)
                dz_all[t] = dz
                gh += h.T @ dz
                dh = dz @ self.w[f"h{d}"].T + (1 - m) * dh
                dc = cell * f + (1 - m) * dc
            grads[f"h{d}"] = gh
            grads[f"x{d}"] = np.tensordot(x, dz_all, axes=([0, 1], [0, 1]))
            grads[f"b{d}"] = dz_all.sum(axis=(0, 1))
        return grads


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(r) for r in rows)
    x, mask = np.zeros((steps, len(rows), INPUT), np.float32), np.zeros((steps, len(rows)), np.float32)
    for k, r in enumerate(rows):
        x[: len(r), k], mask[: len(r), k] = r, 1
    return x, mask


# Layouts of training pages. Containers of an article, and parts that are none.
MAIN = ["<article>", "<main>", '<div class="content">', '<div id="main-content">', '<div class="post">', '<div class="entry-content">', '<section class="story">', '<div class="article-body">', '<div id="article">', '<main><article>', '<div class="container"><article>', '<div id="content"><div class="text">', '<div class="prose">', '<div class="story-body">', '<div class="page">', '<div class="wrapper"><div class="body-copy">', "<div>", "<section>", ""]
SMALL_TALK = "home login search subscribe newsletter cookies accept privacy terms contact about share follow advert sponsored related more menu close sign up next previous".split()
ASIDES = {
    "list": ["<nav>", '<div class="menu">', '<div id="navigation">', '<ul class="nav">', '<div class="breadcrumbs">', '<div class="related">', '<div class="share social">', '<div class="tags">', '<aside class="links">', '<div class="toc">', '<div class="widget">', '<div class="masthead">', '<div class="topbar">', '<div class="recirc">', '<div class="most-read">', '<ul class="pagination">', "<ul>", "<div>"],
    "text": ["<header>", "<footer>", "<aside>", '<div class="ad">', '<div class="ads">', '<div class="advert">', '<div class="advertisement">', '<div class="banner">', '<div class="sponsor">', '<div class="promo">', '<div class="sidebar">', '<div id="sidebar">', '<div class="cookie-notice">', '<div class="notice">', '<div class="cookie consent">', '<div class="alert">', '<div class="popup modal">', '<div class="newsletter">', '<form class="signup">', "<form>", '<div class="footer">', '<div class="header">', '<div id="header">', '<div class="copyright">', '<div role="navigation">', '<div role="complementary">', '<div role="banner">', '<div role="contentinfo">', '<div class="subscribe">', '<div class="teaser">', '<div class="paywall">', '<div class="author bio">', "<dialog>", '<div class="disclaimer">', '<div class="masthead">', '<div class="legal">', '<div class="colophon">', '<div class="gdpr">', '<div class="recirc">'],
    "talk": ['<section class="comments">', '<div id="comments">', '<div class="comment">', '<ol class="comment-list">', '<div class="reader-comments">', '<div class="discussion">', '<div class="responses">', '<section id="comments">', '<div class="reviews">', '<div class="disqus thread">', '<div class="replies">', '<ul class="reply-list">', '<div id="respond">'],
}
#: Where layouts put parts inside an article.
INSIDE = {"list": ['<div class="related">', '<div class="share social">', '<div class="tags">', '<nav class="toc">', '<div class="recirc">'], "text": ["<aside>", '<div class="ad">', '<div class="advert">', '<div class="promo">', '<div class="newsletter">', "<form>", '<div class="notice">', "<footer>", '<div class="sponsor">'], "talk": ASIDES["talk"]}
#: Containers of whole pages: generated names, and names that tell how a page is laid out, not what a part of it holds.
AROUND = ['<div id="root">', '<div id="app">', '<div id="__next">', '<div class="has-sidebar">', '<div class="header-fixed">', '<div class="has-sidebar header-fixed">', '<div class="layout with-sidebar">', '<div class="nav-open menu-left">', '<div class="two-columns footer-sticky">', '<div class="no-ads">', '<div class="page-with-comments">', '<div class="container sidebar-right">', '<div id="page">']
LETTERS = "abcdefghijklmnopqrstuvwxyz"
NOISE = ["row", "col", "box", "wrap", "inner", "block", "clearfix", "x1", "x2", "grid", "main", "page", "site", "item"]
NAMED = re.compile(r' (?:class|id)="[^"]*"')
#: Tags that say without a name what they hold; a part of another tag and without a name is made of links or is short.
TELLING = ("<nav", "<header", "<footer", "<aside", "<form", "<dialog")


def _close(opened: str) -> str:
    return "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", opened)))


def training_page(draw: random.Random, words: list[str]) -> str:
    """A page of a random layout; its main blocks begin with LABEL."""

    def sentence(low: int, high: int) -> str:
        out = " ".join(draw.choices(words, k=draw.randint(low, high)))
        return out[:1].upper() + out[1:] + draw.choice([".", ".", ".", "", "!"])

    nameless = draw.random() < 0.3  # names of this page mean nothing
    extra = draw.random() < 0.25  # names that mean nothing stand beside those that do

    def made_up() -> str:
        letters = "".join(draw.choices(LETTERS, k=draw.randint(2, 9)))
        return draw.choice([letters, f"css-{letters[:3]}{draw.randint(0, 99)}", f"{letters[:2].upper()}{letters[2:]} {letters[::-1]}", f"sc-{letters}"])

    def unnamed(markup: str) -> str:
        if nameless:
            return NAMED.sub(lambda _: draw.choice(["", f' class="{made_up()}"', f' class="{made_up()}"']), markup)
        return NAMED.sub(lambda m: f'{m[0][:-1]} {made_up()}"' if draw.random() < 0.5 else m[0], markup) if extra else markup

    def options() -> str:
        return "<select>" + "".join(f"<option>{sentence(1, 12)}</option>" for _ in range(draw.randint(1, 6))) + "</select>"

    def table() -> str:
        width, cell = draw.randint(1, 4), lambda tag: f"<{tag}>{LABEL}{sentence(1, draw.choice([2, 4, 25]))}</{tag}>"
        head = "<tr>" + "".join(cell("th") for _ in range(width)) + "</tr>" if draw.random() < 0.6 else ""
        rows = "".join("<tr>" + "".join(cell("th" if k == 0 and draw.random() < 0.1 else "td") for k in range(width)) + "</tr>" for _ in range(draw.randint(1, 6)))
        head = f"<caption>{LABEL}{sentence(1, 8)}</caption>" + head if draw.random() < 0.2 else head
        return "<table>" + (f"<thead>{head}</thead><tbody>{rows}</tbody>" if head and draw.random() < 0.4 else head + rows) + "</table>"

    def long_list() -> str:
        tag, most = draw.choice(["ul", "ol", "ol"]), draw.choice([5, 5, 12, 40])
        if draw.random() < 0.2:
            return "<dl>" + "".join(f"<dt>{LABEL}{sentence(1, 4)}</dt><dd>{LABEL}{sentence(3, 40)}</dd>" for _ in range(draw.randint(1, 8))) + "</dl>"
        item = draw.choice(["<li>{}</li>", "<li>{}</li>", "<li><p>{}</p></li>"])
        return f"<{tag}>" + "".join(item.format(f"{LABEL}{sentence(*draw.choice([(1, 6), (5, 25)]))}") for _ in range(draw.randint(1, most))) + f"</{tag}>"

    def part(kinds: dict[str, list[str]], kind: str) -> str:
        opened = draw.choice(kinds[kind])
        bare = "class" not in opened and "id=" not in opened and "role" not in opened
        if kind != "list" and (nameless or bare) and not opened.startswith(TELLING):
            kind = "short"
        if draw.random() < 0.15:
            opened = f'<div class="{draw.choice(NOISE)}">' + opened
        if kind == "list":
            items = [f'<a href="/{k}">{draw.choice(words if draw.random() < 0.6 else SMALL_TALK)}</a>' for k in range(draw.randint(2, 9))]
            body = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if draw.random() < 0.7 and not opened.startswith("<ul") else "".join(f"<li>{x}</li>" if opened.startswith("<ul") else f"{x} " for x in items)
        elif kind == "short":
            bits = [" ".join(draw.choices(SMALL_TALK, k=draw.randint(1, 4))) if draw.random() < 0.7 else f'<a href="/">{sentence(1, 3)}</a>' for _ in range(draw.randint(1, 3))]
            body = "".join(draw.choice(["<p>{}</p>", "<div>{}</div>", "<span>{}</span> "]).format(b) for b in bits)
        elif kind == "text":
            bits = [sentence(2, 25) if draw.random() < 0.6 else " ".join(draw.choices(SMALL_TALK, k=draw.randint(1, 5))) for _ in range(draw.randint(1, 3))]
            body = bits[0] if draw.random() < 0.4 else "".join(draw.choice(["<p>{}</p>", "<div>{}</div>", "<h3>{}</h3>", "<li>{}</li>"]).format(b) for b in bits)
            if "<form" in opened:
                body += draw.choice(["<label>Email</label><input><button>Send</button>", options(), f"<label>{sentence(1, 3)}</label>{options()}<button>Send</button>"])
        else:
            body = f"<h3>{draw.choice(['Comments', 'Discussion', sentence(1, 3)])}</h3>" if draw.random() < 0.6 else ""
            body += "".join(draw.choice(['<div class="comment"><p>{}</p></div>', "<p>{}</p>", "<li><p>{}</p></li>", "<li>{}</li>", "<div><b>{}</b></div>"]).format(sentence(3, 60)) for _ in range(draw.randint(1, 6)))
        return unnamed(opened) + body + _close(opened)

    if draw.random() < 0.04:  # nothing but text, with or without line breaks
        body = LABEL + draw.choice([" ", "<br>", "<br><br>"]).join(sentence(5, 60) for _ in range(draw.randint(1, 6)))
        return draw.choice(["{}", "<html><body>{}</body></html>", "<pre>{}</pre>", "<body><div>{}</div>"]).format(body)
    opened = draw.choice(MAIN)
    if opened and draw.random() < 0.15:
        opened = f'<div class="{draw.choice(NOISE)}">' + opened
    blocks = []
    if draw.random() < 0.8:
        head = f"<h1>{LABEL}{sentence(1, 12)}</h1>"
        blocks.append(f"<header>{head}</header>" if opened and draw.random() < 0.1 else head)
    mostly = draw.choice([None] * 8 + [0.85, 0.96])  # some articles are lists or tables
    for _ in range(draw.choice([1, 2, 3, 5, 8, 14]) if mostly is None else 2):
        kind = draw.random() if mostly is None else mostly
        body = f"{LABEL}{sentence(1, 120 if draw.random() < 0.7 else 12)}"
        if kind < 0.75:
            blocks.append(f"<p><b>{body}<br>" if kind < 0.08 else f"<p>{body}</p>")
        elif kind < 0.83:
            blocks.append(f"<h2>{LABEL}{sentence(1, 8)}</h2>")
        elif kind < 0.9:
            blocks.append(long_list())
        elif kind < 0.95:
            blocks.append(f"<blockquote>{body}</blockquote>")
        else:
            blocks.append(f"<div>{body}</div>" if draw.random() < 0.4 else table())
    if opened:
        for _ in range(draw.choice([0, 0, 0, 1, 2])):
            blocks.insert(draw.randint(1, len(blocks)), part(INSIDE, draw.choice(["list", "text", "text"])))
        if draw.random() < 0.2 and not nameless:
            blocks.append(part(INSIDE, "talk"))
    before = [part(ASIDES, draw.choice(["list", "list", "text"])) for _ in range(draw.randint(0, 4))]
    after = [part(ASIDES, draw.choice(["list", "text", "text", "talk"])) for _ in range(draw.randint(0, 4))]
    main = unnamed(opened) + "".join(blocks) + _close(opened)
    if draw.random() < 0.08:
        after.insert(draw.randint(0, len(after)), options())
    whole = f"{''.join(before)}{main}{''.join(after)}"
    for _ in range(draw.choice([0, 0, 0, 1, 1, 2])):
        outer = draw.choice(AROUND) if draw.random() < 0.6 else f'<div class="{made_up()}">'
        whole = f"{outer}{whole}</div>"
    return f"<html><head><title>{sentence(1, 9)}</title></head><body>{whole}</body></html>"


@lru_cache(4)
def trained(words: tuple[str, ...], seed: int = 11, pages: int = TRAIN_PAGES, epochs: int = EPOCHS) -> Network:
    """A network fitted to training pages filled with these words."""
    draw, net = random.Random(seed), Network(seed)
    cases = []
    for _ in range(pages):
        blocks = leaves(training_page(draw, list(words)))
        labels = np.array([t.startswith(LABEL) for _, t, _ in blocks], dtype=np.float32)
        cases.append((features([(p, t.lstrip(LABEL) or ".", n) for p, t, n in blocks]), labels))
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.w.items()}
    step = 0
    for epoch in range(epochs):
        draw.shuffle(cases)
        order = sorted(range(0, len(cases), BATCH), key=lambda _: draw.random())
        for low in order:
            part = cases[low : low + BATCH]
            x, mask = _padded([c[0] for c in part])
            labels = np.zeros_like(mask)
            for k, (_, y) in enumerate(part):
                labels[: len(y), k] = y
            step += 1
            rate = RATE * (1 - 0.9 * epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for name, g in net.gradients(x, mask, labels).items():
                m, v = moments[name]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                net.w[name] -= rate * m / (np.sqrt(v) + 1e-8)
    return net


def main_texts(net: Network, pages: list[str]) -> list[str]:
    """The main text of each page."""
    cut = [leaves(p) for p in pages]
    out = [""] * len(pages)
    for k, blocks in enumerate(cut):
        if len(blocks) > STRETCH:
            out[k] = " ".join(text for (_, text, _), s in zip(blocks, net.long_scores(blocks)) if s > 0)
    order = sorted((k for k in range(len(pages)) if 0 < len(cut[k]) <= STRETCH), key=lambda k: len(cut[k]))
    low = 0
    while low < len(order):
        high = low + 1  # pages of like length, and no more cells than a few large pages have
        while high < len(order) and high - low < PAGES_AT_ONCE and (high - low + 1) * len(cut[order[high]]) < 20_000:
            high += 1
        part = order[low:high]
        x, mask = _padded([features(cut[k]) for k in part])
        scores = net.scores(x, mask)
        for column, k in enumerate(part):
            out[k] = " ".join(text for (_, text, _), s in zip(cut[k], scores[:, column]) if s > 0)
        low = high
    return out


def _extract(batches: Iterator[pa.RecordBatch], net: Network) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(main_texts(net, part.column(2).to_pylist()), pa.string())], names=["page_id", "url", "text"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for page in batch.column(0).to_pylist():
            words = sorted({w for _, text, _ in leaves(page or "") for w in text.split()})
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string())], names=["word"])


def sample_words(pages: DataFrame, most: int = SAMPLE_PAGES) -> tuple[str, ...]:
    """Words of the pages with the ``most`` smallest ids, SAMPLE_WORDS of them at most, by their hashes. The pages are read in
    tasks; the words alone come to the driver."""
    ids = [r[0] for r in pages.select("page_id").filter("page_id is not null").distinct().orderBy("page_id").limit(most).collect()]
    if not ids:
        return tuple(SMALL_TALK)
    words = pages.filter(F.col("page_id").isin(ids)).select(F.col("html").cast("string")).mapInArrow(_words, "word string").distinct()
    rows = words.filter(F.length("word") <= 100).orderBy(F.xxhash64("word"), "word").limit(SAMPLE_WORDS).collect()
    return tuple(sorted(r["word"] for r in rows)) or tuple(SMALL_TALK)


def extract(pages: DataFrame, net: Network | None = None) -> DataFrame:
    """(page_id, url, text) of every page."""
    net = net or trained(sample_words(pages))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(lambda b: _extract(b, net), "page_id long, url string, text string")

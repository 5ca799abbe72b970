"""Main text of web pages: a bidirectional LSTM in numpy labels every block of a page.

A page becomes the sequence of its leaf blocks. Each is a vector of its tag path (elements with their classes and
ids, hashed), its words (hashed) and a few measures; the network reads the sequence in both directions, so that every
block is judged in the light of the whole page. The weights in html_weights.npz are made by ``html_train.py`` of this
subpackage from generated pages, seeded, and can be made again at any time.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexar.session import ship

from .common import text_of

#: How HTML elements lay out.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript iframe object svg canvas annotation annotation-xml head title select textarea audio video map".split())
#: What may stand in a head; any other tag begins the body, as </head> may be left out.
IN_HEAD = frozenset("head title meta link base style script noscript template basefont bgsound noframes".split())
#: An opening tag of the first kind ends an open element of the second.
ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that closing or ending tags inside them do not reach beyond.
SCOPE = frozenset("html body table td th ul ol dl article section main aside nav header footer div form".split())
SPACE = re.compile(r"\s+")

PATH_DIM, WORD_DIM, MEASURES = 128, 24, 10
INPUT_DIM = PATH_DIM + WORD_DIM + MEASURES
HIDDEN = 20
WEIGHTS = Path(__file__).with_name("html_weights.npz")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    link_chars: int


class Leaves(HTMLParser):
    """Collects a page's leaf blocks: runs of text between block-level tags, white space as one space."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.silent: list[str] = []
        self.parts: list[str] = []
        self.links = 0
        self.link_chars = 0
        self.blocks: list[Block] = []
        self.where: tuple[str, ...] = ()

    def _flush(self) -> None:
        if self.parts:
            text = SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                self.blocks.append(Block(text, self.where, self.link_chars))
        self.parts, self.link_chars = [], 0

    def _pop_to(self, tag: str, scope: frozenset[str]) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                for t, _ in self.stack[k:]:
                    self.links -= t == "a"
                del self.stack[k:]
                return
            if self.stack[k][0] in scope:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "body" and self.silent and self.silent[0] in ("head", "title"):
            self.silent.clear()
        if self.silent == ["head"] and tag not in IN_HEAD:
            self.silent.clear()
        if self.silent:
            if (tag == self.silent[-1] or self.silent == ["head"] and tag in SILENT) and tag not in VOID:
                self.silent.append(tag)
            return
        if tag in SILENT:
            if tag in BLOCKS:
                self._flush()
            self.silent.append(tag)
            return
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in BLOCKS:
            self._flush()
            for end in ENDS.get(tag, ()):
                self._pop_to(end, SCOPE - {end})
            if tag in SCOPE or tag[0] == "h":
                self._pop_to("p", SCOPE)
        if tag in VOID:
            return
        names = [tag]
        for k, v in attrs:
            if k in ("class", "id", "role") and v:
                names += [x for x in re.split(r"[\s_\-]+", v.lower()) if x]
        self.links += tag == "a"
        self.stack.append((tag, tuple(names)))

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            if tag == "head" and self.silent[0] == "head":
                self.silent.clear()
            elif tag == self.silent[-1]:
                self.silent.pop()
            return
        if tag in BLOCKS:
            self._flush()
        if tag == "br":
            self.parts.append(" ")
        elif tag not in VOID:
            self._pop_to(tag, frozenset() if tag in SCOPE else SCOPE)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID or tag == "br":
            self.handle_starttag(tag, attrs)
        elif tag in ("svg", "math") or any(t == "math" for t, _ in self.stack):  # closed in foreign content
            if self.silent == ["head"]:
                self.silent.clear()
        else:  # a slash in an ordinary opening tag means nothing in HTML
            self.handle_starttag(tag, attrs)

    def handle_data(self, data: str) -> None:
        if self.silent == ["head"] and data.strip():  # text begins the body
            self.silent.clear()
        if self.silent:
            return
        if not self.parts:
            self.where = tuple(n for _, names in self.stack for n in names)
        self.parts.append(data)
        if self.links:
            self.link_chars += len(data.strip())

    def parse_html_declaration(self, i: int) -> int:
        try:
            return super().parse_html_declaration(i)
        except AssertionError:  # a declaration that the parser does not know is a comment up to the next >
            return self.parse_bogus_comment(i)

    def unknown_decl(self, data: str) -> None:
        return

    def close(self) -> None:
        super().close()
        self._flush()


def blocks_of(html: str | None) -> list[Block]:
    """The leaf blocks of a page in order. Never raises on broken markup; an element left open ends with the page."""
    parser = Leaves()
    try:
        parser.feed(html or "")
        parser.close()
    except (AssertionError, ValueError):  # the parser's own complaint about a declaration: what came before it stays
        parser._flush()
    return parser.blocks


@lru_cache(maxsize=1 << 16)
def _bucket(word: str, size: int) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % size


class _WordBuckets(dict):
    """Buckets of lower-cased words, a bounded number of which is remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 16:
            self.clear()
        out = self[word] = zlib.crc32(word.lower().encode("utf-8", "replace")) % WORD_DIM
        return out


_words = _WordBuckets()


def vectors(blocks: list[Block]) -> np.ndarray:
    """(blocks, INPUT_DIM)."""
    x = np.zeros((len(blocks), INPUT_DIM), np.float32)
    n = len(blocks)
    for k, b in enumerate(blocks):
        row = x[k]
        row[[_bucket(p, PATH_DIM) for p in b.path]] = 1.0
        words = b.text.split(" ")
        row[PATH_DIM : PATH_DIM + WORD_DIM] = np.bincount([_words[w] for w in words], minlength=WORD_DIM)
        chars = max(len(b.text), 1)
        marks = sum(map(b.text.count, ".!?,;:"))
        last = b.path[-1] if b.path else ""
        row[-MEASURES:] = (
            min(math.log1p(len(words)) / 5, 2), min(b.link_chars / chars, 1), min(marks / len(words), 1), k / n, min(n / 50, 2),
            b.text[-1] in ".!?", last[:1] == "h" and last[1:].isdigit(), k == 0, k == n - 1, "li" in b.path,
        )
    x[:, PATH_DIM : PATH_DIM + WORD_DIM] /= np.maximum(np.linalg.norm(x[:, PATH_DIM : PATH_DIM + WORD_DIM], axis=1, keepdims=True), 1)
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def _states(x: np.ndarray, net: dict[str, np.ndarray]) -> np.ndarray:
    """Hidden states of both directions, (time, 2 * HIDDEN). Both advance in one loop, one forward and one backward.

    Gates: input, forget, output, candidate. All four are one tanh, as a sigmoid is a tanh of half the argument."""
    n = len(x)
    half = np.r_[np.full(3 * HIDDEN, 0.5), np.ones(HIDDEN)].astype(np.float32)
    z = np.empty((n, 2, 4 * HIDDEN), np.float32)
    z[:, 0] = (x @ net["wf"] + net["bf"]) * half
    z[:, 1] = ((x @ net["wb"] + net["bb"]) * half)[::-1]
    u = np.stack([net["uf"], net["ub"]]) * half
    h = np.zeros((2, 1, HIDDEN), np.float32)
    c = np.zeros((2, HIDDEN), np.float32)
    out = np.empty((n, 2, HIDDEN), np.float32)
    for t in range(n):
        a = np.tanh(z[t] + np.matmul(h, u)[:, 0])
        g = 0.5 * a[:, : 3 * HIDDEN] + 0.5
        c = g[:, HIDDEN : 2 * HIDDEN] * c + g[:, :HIDDEN] * a[:, 3 * HIDDEN :]
        h = (g[:, 2 * HIDDEN :] * np.tanh(c))[:, None]
        out[t] = h[:, 0]
    return np.hstack([out[:, 0], out[::-1, 1]])


@lru_cache(maxsize=1)
def weights() -> dict[str, np.ndarray]:
    with np.load(WEIGHTS) as f:
        return {k: f[k].astype(np.float32) for k in f.files}


def label(blocks: list[Block], net: dict[str, np.ndarray]) -> np.ndarray:
    """Probability that each block is main text, in the context of all blocks of the page."""
    if not blocks:
        return np.zeros(0)
    x = vectors(blocks)
    return _sigmoid(_states(x, net) @ net["wo"] + x @ net["wx"] + net["bo"])


def main_text(html: str | None, net: dict[str, np.ndarray] | None = None) -> str:
    """The main text: blocks with a probability of at least a half, in page order, joined by blank lines."""
    blocks = blocks_of(html)
    keep = label(blocks, net or weights())
    return "\n\n".join(b.text for b, p in zip(blocks, keep) if p >= 0.5)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) per row of pages; n_chars counts code points.

    Null, empty and textless pages give an empty text. Very long pages and blocks are read whole. Repeated rows and ids
    give a row each, in the same way. Other columns play no part. An empty table gives an empty result. Pages do not influence each other; nothing is shuffled or capped.
    """
    ship(pages.sparkSession)
    net = weights()

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, net) for h in pages], dtype=object)

    rows = pages.select(F.col(id_col), F.col(url_col), run(text_of(html_col)).alias("text"))
    return rows.select(id_col, url_col, "text", F.char_length("text").cast("long").alias("n_chars"))

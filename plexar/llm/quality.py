"""Quality rules as a short-circuit cascade, ordered by rejection per cost as estimated on a sample."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexar.session import ship

from .common import fresh, text_of, words_in

SYMBOLS = "#*$%&|<>"
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: Rows on which costs and rejections are estimated: the first that the scan meets. They decide the order only.
SAMPLE_ROWS = 400
#: Longer texts are left out of that sample (not of anything else), so that it stays small.
SAMPLE_CHARS = 200_000


class Features:
    """Counts over one whole text, each computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return words_in(self.text)

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, ASCII_SPACE))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        """Lines with a word."""
        return [x for x in self.text.split("\n") if x.strip(ASCII_SPACE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words covered by 3-word windows that occur twice or more in the text, the first included."""
        n = len(self.words)
        if n < 4:  # two windows need four words
            return 0
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in self.words), np.int64, n)
        # windows numbered in two steps, so that no product overflows
        _, pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
        _, which, count = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
        hit = count[which] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= hit
        return int(covered.sum())


@dataclass(frozen=True)
class Rule:
    """rejects: whether a text with these features is to go."""

    name: str
    rejects: Callable[[Features], bool]
    base: bool = False


#: A text is kept if no rule rejects it. Integer arithmetic only, so that SQL agrees.
RULES = (
    Rule("few_words", lambda f: f.n_words < 50, base=True),
    Rule("repeated_windows", lambda f: 100 * f.n_repeat_words > 50 * f.n_words, base=True),
    Rule("symbols", lambda f: 10 * f.n_symbols > f.n_words),
    Rule("repeated_lines", lambda f: 100 * f.n_dup_lines > 60 * len(f.lines)),
    Rule("word_length", lambda f: not 2 * f.n_words <= f.word_chars <= 20 * f.n_words),
)


def order_rules(sample: list[str], rules=RULES) -> tuple[Rule, ...]:
    """The rules by rejection per cost, best first.

    Each rule runs alone over the sample (features are computed anew, so a rule pays for all it needs). Ties, and
    samples without rows, keep the given order.
    """
    if not sample:
        return tuple(rules)
    value = []
    for k, r in enumerate(rules):
        began, n = time.perf_counter(), 0
        for t in sample:
            n += r.rejects(Features(t))
        value.append((-n / max(time.perf_counter() - began, 1e-9), k))
    return tuple(rules[k] for _, k in sorted(value))


def verdict(f: Features, rules) -> str | None:
    """The name of the first rule that rejects, None if none does. Later rules are not evaluated."""
    return next((r.name for r in rules if r.rejects(f)), None)


def _sample(docs: DataFrame, text_col: str) -> list[str]:
    some = docs.where(F.length(text_of(text_col)) <= SAMPLE_CHARS).select(text_of(text_col)).limit(SAMPLE_ROWS)
    return [r[0] for r in some.collect()]


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """Per row of docs: (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept).

    All counts are over the whole text and are always computed; base_failed is the two base rules, and the others are
    a cascade that rows which failed do not enter. Null, empty and blank texts have no words: counts 0 (a blank text
    has no line with a word), base_failed true. Repeated rows and ids give a row each. An empty table gives an empty
    result. The sample decides the order of rules, never a result.
    """
    ship(docs.sparkSession)
    rest = order_rules(_sample(docs, text_col), [r for r in rules if not r.base])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b["text"]:
                f = Features(t)
                failed = f.n_words < 50 or 100 * f.n_repeat_words > 50 * f.n_words
                out.append((f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, failed, not failed and verdict(f, rest) is None))
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
            yield pd.DataFrame(out, columns=names).assign(id=b["id"].to_numpy())

    kind = docs.schema[id_col].dataType
    schema = "id string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    rows = docs.select(F.col(id_col).cast("string").alias("id"), text_of(text_col).alias("text"))
    return rows.mapInPandas(run, schema).withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def quality_filter(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows of docs that no rule rejects, all columns unchanged; base rules are part of the cascade.

    Only the text goes to Python, as one boolean comes back. Corner cases as in ``quality_report``.
    """
    ship(docs.sparkSession)
    ordered = order_rules(_sample(docs, text_col), rules)

    @F.pandas_udf("boolean")
    def keeps(texts: pd.Series) -> pd.Series:
        return pd.Series([verdict(Features(t), ordered) is None for t in texts], dtype=bool)

    (keep,) = fresh(docs, "keep")
    return docs.withColumn(keep, keeps(text_of(text_col))).where(F.col(keep)).drop(keep)

"""Basic graph patterns over (s, p, o) triples: every pattern is a filter, patterns meet in equi-joins on variables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Pattern = tuple[str, str, str]


def match(triples: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """One column for each variable (a term beginning with ?), one row for each solution, repeats kept.

    Patterns are joined in the given order, each next one with a variable in common where there is one."""
    if not patterns:
        raise ValueError("no patterns")
    left, out = list(patterns), None
    while left:
        have = set() if out is None else set(out.columns)
        k = next((i for i, p in enumerate(left) if have & {t[1:] for t in p if t.startswith("?")}), 0)
        rows = _rows(triples, left.pop(k))
        on = [c for c in rows.columns if c in have]
        out = rows if out is None else out.join(rows, on) if on else out.crossJoin(rows)
    return out


def _rows(triples: DataFrame, pattern: Pattern) -> DataFrame:
    df, first = triples, {}
    for col, term in zip(("s", "p", "o"), pattern):
        if not term.startswith("?"):
            df = df.where(F.col(col) == term)
        elif term in first:
            df = df.where(F.col(col) == F.col(first[term]))
        else:
            first[term] = col
    return df.select(*[F.col(c).alias(v[1:]) for v, c in first.items()])


def select(triples: DataFrame, text: str) -> DataFrame:
    """``SELECT [DISTINCT] ?a ?b | * WHERE { s p o . ... } [LIMIT n]``; terms are ?variables, <iris>, "texts" or names."""
    m = re.fullmatch(r"(?is)\s*SELECT\s+(DISTINCT\s+)?(.+?)\s+WHERE\s*\{(.*)\}\s*(?:LIMIT\s+(\d+))?\s*", text)
    if not m:
        raise ValueError("not a SELECT query over a basic graph pattern")
    terms = re.findall(r'\?\w+|<[^>]*>|"(?:[^"\\]|\\.)*"|[^\s.]+|\.', m[3])
    patterns, now = [], []
    for t in [*terms, "."]:
        if t == ".":
            if now and len(now) != 3:
                raise ValueError(f"a pattern has three terms: {' '.join(now)}")
            patterns += [tuple(now)] if now else []
            now = []
        else:
            now.append(t[1:-1] if t[0] in '<"' else t)
    out = match(triples, patterns)
    if m[2].strip() != "*":
        out = out.select(*[v.lstrip("?") for v in m[2].split()])
    out = out.distinct() if m[1] else out
    return out.limit(int(m[4])) if m[4] else out

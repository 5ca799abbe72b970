"""Toxicity by a weighted finite-state grammar over clauses.

The lexicon maps a word to a class (insult or threat with a weight, target, negation, report, future, break, other).
Five weighted transducers read classes and rewrite them: targets mark the insults and threats beside them, insults and
marked threats become hits, and negations and reports before them make hits lighter. ``grammar`` is their composition.
What is scored is each clause's path through it, and a text's score is the logistic of the sum over its clauses less
the prior odds.

Function words and threats are fixed lists in four languages. Insults begin with a fixed English list and are learnt
from labelled texts in any language: whole words and word stems whose occurrences favour toxic texts. Occurrences are
counted once for each pair of neighbouring words, so that copies and near copies of a text count once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Hashable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexar.session import ship

from .common import text_of

#: The seed lexicon and the function words of the grammar, English, German, French and Spanish.
INSULTS = "idiot moron stupid pathetic loser scum trash worthless disgusting clown imbecile jerk vermin dumb filthy".split()
THREATS = (
    "kill hurt destroy stab shoot strangle burn crush".split()
    + "töte töten umbringen verletzen erschießen erwürgen".split()
    + "tuer tuerai tue frapper détruire étrangler brûler".split()
    + "matar mataré mato herir destruir disparar estrangular quemar".split()
)
TARGETS = (
    "you your yours yourself u he she they them him her his their these those".split()
    + "du dich dir dein deine ihr euch sie ihn ihm diese".split()
    + "tu toi vous votre elle ils elles lui eux".split()
    + "tú ti usted ustedes él ella ellos ellas vosotros".split()
)
NEGATIONS = (
    "not no never neither nor isn't aren't wasn't weren't don't doesn't didn't".split()
    + "nicht kein keine keinen niemals nie weder".split()
    + "pas jamais n'est aucun aucune ni".split()
    + "nunca jamás tampoco ningún ninguna".split()
)
REPORTS = (
    "said says wrote writes quoted quote claimed reported called allegedly".split()
    + "sagte sagt schrieb schreibt behauptete angeblich".split()
    + "dit disait écrit écrivait affirmait prétendait".split()
    + "dijo dice escribió escribe afirmó supuestamente".split()
)
FUTURES = "will shall gonna going should must".split() + "werde werden wird".split() + "vais va allons".split() + "voy vamos".split()

SEED_WEIGHT = 3.5
#: Labelled texts that the lexicon is learnt from: those of the least hashed ids, up to this many.
TRAIN_ROWS = 6000
#: Longer labelled texts teach nothing (they are scored like any other), so that what reaches the driver is bounded.
TRAIN_CHARS = 100_000
#: A learnt term: occurrences in different contexts, share of them in toxic texts, and evidence (G squared).
LEAST_CONTEXTS, LEAST_SHARE, LEAST_EVIDENCE, MOST_WEIGHT = 6, 0.8, 30.0, 6.0
#: A term that does occur in harmless texts counts by this share of its log odds: toxic texts hold several, a
#: harmless one a stray. LEAST_SHARE (0.8, 0.85, 0.9) and DISCOUNT (0.25, 0.35, 0.5, 0.65) are chosen on rows that may be
#: learnt from only: learnt on those of remainder 0 and judged on 2, and the other way round, at sf0.01 and sf0.1. Of the
#: settings within a standard error of the fewest errors (40 of 2,922), the one that finds most toxic texts.
DISCOUNT = 0.5
STEMS = (4, 5, 6)
NEGATED, REPORTED, AIMED = 0.25, 0.4, 1.25
REACH = 3

TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;\n]")
#: Classes of words, and what the transducers write besides.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, FUTURE, BREAK, INSULT_AT, THREAT_AT, HIT = range(11)
SYMBOLS = 11


@dataclass
class Lexicon:
    """Classes of words, weights of whole words and stems, and the prior log odds against toxicity."""

    weights: dict[str, float] = field(default_factory=lambda: dict.fromkeys(INSULTS, SEED_WEIGHT))
    stems: dict[str, float] = field(default_factory=dict)
    threats: dict[str, float] = field(default_factory=lambda: dict.fromkeys(THREATS, SEED_WEIGHT))
    prior: float = 2.0

    def __post_init__(self):
        self.classes = {w: c for c, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (FUTURE, FUTURES)) for w in words}
        self.classes |= dict.fromkeys(".!?;\n", BREAK) | dict.fromkeys(self.weights, INSULT) | dict.fromkeys(self.threats, THREAT)

        self._marks = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_marks": None}

    def may_hold(self, low: str) -> bool:
        """Whether a lower-cased text holds the letters of an insult or threat anywhere: one pass over all of them at
        once. Texts without any have no path that scores."""
        if self._marks is None:
            import ahocorasick

            self._marks = ahocorasick.Automaton()
            for t in (*self.weights, *self.stems, *self.threats):
                self._marks.add_word(t, 0)
            self._marks.make_automaton()
        return len(self._marks) > 0 and next(self._marks.iter(low), None) is not None

    def lexical(self, tokens: list[str]) -> list[tuple[int, float]]:
        """(class, weight) of each token: what the transducers read."""
        out = []
        for t in tokens:
            c = self.classes.get(t)
            if c is None:
                w = max((self.stems[t[:n]] for n in STEMS if t[:n] in self.stems), default=None) if self.stems else None
                out.append((OTHER, 0.0) if w is None else (INSULT, w))
            elif c == INSULT:
                out.append((c, self.weights[t]))
            elif c == THREAT:
                out.append((c, self.threats[t]))
            else:
                out.append((c, 0.0))
        return out


def clauses(tape: list[tuple[int, float]]) -> Iterator[list[tuple[int, float]]]:
    now: list[tuple[int, float]] = []
    for x in tape:
        if x[0] == BREAK:
            if now:
                yield now
            now = []
        else:
            now.append(x)
    if now:
        yield now


@dataclass(frozen=True)
class Transducer:
    """A weighted finite-state transducer over symbols: arcs[state][symbol] holds (next state, output, factor) for every
    arc, and a state or symbol without arcs ends a path. Paths begin in state 0 and end in a final state."""

    arcs: list[dict[int, list[tuple[int, int, float]]]]
    final: list[bool]


def transducer(start: Hashable, step: Callable[[Hashable, int], Iterable[tuple[Hashable, int, float]]], final: Callable[[Hashable], bool] = lambda s: True) -> Transducer:
    """The transducer of the states that ``step`` reaches from start, numbered in the order met."""
    number, order, arcs = {start: 0}, [start], []
    for state in order:  # grows as states are met
        row: dict[int, list[tuple[int, int, float]]] = {}
        for x in range(SYMBOLS):
            for to, out, factor in step(state, x):
                if to not in number:
                    number[to] = len(order)
                    order.append(to)
                row.setdefault(x, []).append((number[to], out, factor))
        arcs.append(row)
    return Transducer(arcs, [final(s) for s in order])


def compose(a: Transducer, b: Transducer) -> Transducer:
    """b reads what a writes; factors multiply."""

    def step(state: Hashable, x: int) -> Iterator[tuple[Hashable, int, float]]:
        for to_a, y, f in a.arcs[state[0]].get(x, ()):
            for to_b, z, g in b.arcs[state[1]].get(y, ()):
                yield (to_a, to_b), z, f * g

    return transducer((0, 0), step, lambda s: a.final[s[0]] and b.final[s[1]])


def target_transducer() -> Transducer:
    """Marks insults and threats with a target beside them. A target to come is guessed: a state is (words since a
    target, words in which one must come, words in which none may), and a path whose guess fails ends."""
    far = REACH + 1

    def step(state: Hashable, x: int) -> Iterator[tuple[Hashable, int, float]]:
        since, due, barred = state
        if x == TARGET:
            if not barred:
                yield (0, 0, 0), x, 1.0
            return
        if due == 1:  # the last word in which a target could come
            return
        since_next, due, barred = min(since + 1, far), max(due - 1, 0), max(barred - 1, 0)
        if x not in (INSULT, THREAT):
            yield (since_next, due, barred), x, 1.0
            return
        marked = INSULT_AT if x == INSULT else THREAT_AT
        if barred < REACH:
            yield (since_next, due or REACH, barred), marked, 1.0
        if not due:
            yield (since_next, 0, REACH), marked if x == INSULT and since <= REACH else x, 1.0

    return transducer((far, 0, 0), step, lambda s: not s[1])


def insult_transducer() -> Transducer:
    """An insult is a hit, a heavier one beside a target."""
    hits = {INSULT: (HIT, 1.0), INSULT_AT: (HIT, AIMED)}
    return transducer(0, lambda s, x: [(s, *hits.get(x, (x, 1.0)))])


def threat_transducer() -> Transducer:
    """A threat is a hit with a target after it only, and a heavier one after a word of the future."""
    def step(future: Hashable, x: int) -> list[tuple[Hashable, int, float]]:
        if x == THREAT_AT:
            return [(future, HIT, AIMED if future else 1.0)]
        return [(future or x == FUTURE, OTHER if x == THREAT else x, 1.0)]

    return transducer(False, step)


def negation_transducer() -> Transducer:
    """A hit within REACH words after a negation is lighter."""
    def step(left: Hashable, x: int) -> list[tuple[Hashable, int, float]]:
        return [(REACH if x == NEGATION else max(left - 1, 0), x, NEGATED if x == HIT and left else 1.0)]

    return transducer(0, step)


def report_transducer() -> Transducer:
    """A hit after a word of reporting is lighter."""
    def step(reported: Hashable, x: int) -> list[tuple[Hashable, int, float]]:
        return [(reported or x == REPORT, x, REPORTED if x == HIT and reported else 1.0)]

    return transducer(False, step)


@cache
def grammar() -> Transducer:
    """The composition of all of them, from classes of words to hits with factors."""
    return reduce(compose, (target_transducer(), insult_transducer(), threat_transducer(), negation_transducer(), report_transducer()))


def clause_score(clause: list[tuple[int, float]]) -> float:
    """Weight of the clause's path through the grammar: that of its hits, each by the factor of its arc. Guesses that
    the clause does not bear out end, so that one path is left."""
    arcs = grammar().arcs
    paths = {0: 0.0}
    for cls, w in clause:
        after: dict[int, float] = {}
        for state, total in paths.items():
            for to, out, factor in arcs[state].get(cls, ()):
                after[to] = max(after.get(to, -math.inf), total + w * factor if out == HIT else total)
        paths = after
    return max(total for state, total in paths.items() if grammar().final[state])


def score_text(text: str | None, lex: Lexicon) -> float:
    """0 to 1. Null, empty and wordless texts get the prior."""
    low, total = (text or "").lower(), 0.0
    if lex.may_hold(low):
        tape = lex.lexical(TOKEN.findall(low))
        total = sum(clause_score(c) for c in clauses(tape) if any(k in (INSULT, THREAT) for k, _ in c))
    return 1 / (1 + math.exp(min(lex.prior - total, 700.0)))


def _contexts(text: str | None) -> Iterator[tuple[str, int]]:
    """(word, number of its context) for every word of a text; a context is the word and its neighbours."""
    words = [t for t in TOKEN.findall((text or "").lower()) if t not in ".!?;\n"]
    for a, w, b in zip(["", *words], words, [*words[1:], ""]):
        yield w, hash((a, w, b))


def _frequent(texts: list[str | None]) -> set[str]:
    """Terms that occur LEAST_CONTEXTS times or more. Terms are words and stems, the latter with a star."""
    words: Counter[str] = Counter()
    for text in texts:
        words.update(t for t in TOKEN.findall((text or "").lower()) if t not in ".!?;\n")
    stems: Counter[str] = Counter()
    for w, n in words.items():
        for k in STEMS:
            if len(w) > k:
                stems[f"{w[:k]}*"] += n
    return {t for c in (words, stems) for t, n in c.items() if n >= LEAST_CONTEXTS}


def _gather(texts: list[str | None], most: dict[str, float]) -> tuple[dict[str, set[int]], int]:
    """(contexts of each term in most, number of different contexts of all words). A term with more contexts than its
    number in most is decided, and no more of them are kept."""
    seen: dict[str, set[int]] = {t: set() for t in most}
    left = dict(seen)
    every = []
    for text in texts:
        own = []
        for w, context in _contexts(text):
            own.append(context)
            for term in (w, *(f"{w[:n]}*" for n in STEMS if len(w) > n)):
                if (s := left.get(term)) is not None:
                    s.add(context)
                    if len(s) > most[term]:
                        del left[term]
        every.append(np.unique(np.array(own, np.int64)))
    return seen, len(np.unique(np.concatenate(every))) if every else 0


def learn(rows: Iterable[tuple[str | None, int]]) -> Lexicon:
    """A lexicon from (text, label 0 or 1). Without both labels it is the seed lexicon.

    Toxic texts come first: only terms with enough contexts there are then looked for in the others."""
    split: tuple[list, list] = ([], [])
    for text, label in rows:
        split[label].append(text)
    texts = [len(s) for s in split]
    lex = Lexicon()
    if not all(texts):
        return lex
    toxic, n1 = _gather(split[1], dict.fromkeys(_frequent(split[1]), math.inf))
    toxic = {t: c for t, c in toxic.items() if len(c) >= LEAST_CONTEXTS}
    # beyond these numbers a term's share of toxic contexts is too small, whatever else comes
    most = {t: math.floor(len(c) * (1 / LEAST_SHARE - 1) + 1e-9) for t, c in toxic.items()}  # the next one is one too many
    most |= {w: max(most.get(w, 0), len(toxic.get(w, ())), LEAST_CONTEXTS) for w in INSULTS}
    harmless, n0 = _gather(split[0], most)
    seen, total = (harmless, toxic), (max(n0, 1), max(n1, 1))
    share = total[1] / sum(total)

    def weight(term: str) -> float | None:
        a, b = len(seen[1].get(term, ())), len(seen[0].get(term, ()))
        if a < LEAST_CONTEXTS or a / (a + b) < LEAST_SHARE:
            return None
        g = 2 * (a * math.log(a / ((a + b) * share)) + (b * math.log(b / ((a + b) * (1 - share))) if b else 0.0))
        odds = math.log((a + 0.5) / (b + 0.5)) - math.log(total[1] / total[0])
        if g < LEAST_EVIDENCE:
            return None
        return MOST_WEIGHT if odds >= MOST_WEIGHT else odds * DISCOUNT

    weights, stems = dict(lex.weights), {}
    for term in seen[1]:
        w = weight(term)
        if w is not None and term not in lex.threats:
            (stems if term.endswith("*") else weights)[term.rstrip("*")] = w
    for w in INSULTS:  # a seed word that labelled texts use harmlessly loses its weight
        a, b = len(seen[1].get(w, ())), len(seen[0].get(w, ()))
        if a + b >= LEAST_CONTEXTS and a / (a + b) < 0.5:
            weights.pop(w, None)
    classes = Lexicon().classes
    weights = {w: v for w, v in weights.items() if classes.get(w, INSULT) == INSULT}
    return Lexicon(weights, stems, lex.threats, max(0.5, math.log(texts[0] / texts[1])))


def held_out(id_col: str):
    """Rows that no label is learnt from: CRC-32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Lexicon:
    """Learns from labelled rows that are not held out, up to TRAIN_ROWS ids by hash; that many ids reach the driver.
    Rows of null id, text or
    label teach nothing, nor do texts of more than TRAIN_CHARS characters."""
    few = labels.select(F.col(id_col).alias("k"), F.col(label_col).alias("y")).where(F.col("k").isNotNull() & F.col("y").isin(0, 1) & ~held_out("k"))
    few = few.groupBy("k").agg(F.max("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(TRAIN_ROWS)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(few), F.col("id") == F.col("k"))
    rows = rows.where(F.length("text") <= TRAIN_CHARS)
    return learn((r[0], int(r[1])) for r in rows.select("text", "y").dropDuplicates().orderBy(F.xxhash64("text"), "text", "y").limit(2 * TRAIN_ROWS).toLocalIterator())


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
             threshold: float = 0.7, lexicon: Lexicon | None = None) -> DataFrame:
    """(id, held_out, score, predicted) per row of docs. Whole texts are scored; the score uses nothing but the text.

    Null, empty and wordless texts get the prior's score; very long texts are scored like any other, and an id labelled
    twice has its greatest label. Repeated rows and ids give a row each; a null id is not
    held out. An empty documents table gives an empty result; an empty labels table leaves the seed lexicon.
    """
    ship(docs.sparkSession)
    lex = lexicon or train(docs, labels, id_col, text_col, label_col)

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series([score_text(t, lex) for t in texts], dtype=float)

    rows = docs.select(F.col(id_col).alias("k"), scores(text_of(text_col)).alias("score"))
    return rows.select(F.col("k").alias(id_col), held_out("k").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

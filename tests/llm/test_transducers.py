"""The composed grammar against a plain reading of its rules, and minimal pairs in four languages."""

import random

import pytest

from plexar.llm import toxicity as t


def plain(clause):
    """Every insult and threat weighted by what stands around it, by looking at positions."""
    at = lambda k, kind: [j for j, (c, _) in enumerate(clause) if c == kind and j < k]
    total = 0.0
    for k, (c, w) in enumerate(clause):
        ahead = any(x == t.TARGET for x, _ in clause[k + 1 : k + 1 + t.REACH])
        before = any(k - j <= t.REACH + 1 for j in at(k, t.TARGET))
        if c == t.INSULT:
            w *= t.AIMED if ahead or before else 1
        elif c == t.THREAT and ahead:
            w *= t.AIMED if at(k, t.FUTURE) else 1
        else:
            continue
        if any(k - j <= t.REACH for j in at(k, t.NEGATION)):
            w *= t.NEGATED
        total += w * (t.REPORTED if at(k, t.REPORT) else 1)
    return total


def test_composition_equals_rules():
    r = random.Random(8)
    for _ in range(20_000):
        classes = r.choices([t.OTHER, t.INSULT, t.THREAT, t.TARGET, t.NEGATION, t.REPORT, t.FUTURE], [4, 2, 2, 2, 1, 1, 1], k=r.randrange(1, 15))
        clause = [(c, r.choice([1.0, 3.5]) if c in (t.INSULT, t.THREAT) else 0.0) for c in classes]
        assert t.clause_score(clause) == pytest.approx(plain(clause))


def test_compose_is_sequential_application():
    a, b = t.negation_transducer(), t.report_transducer()
    both = t.compose(a, b)

    def run(m, symbols):
        state, out, weight = 0, [], 1.0
        for x in symbols:
            ((state, y, f),) = m.arcs[state][x]
            out.append(y)
            weight *= f
        return out, weight

    r = random.Random(2)
    for _ in range(500):
        tape = r.choices([t.OTHER, t.HIT, t.NEGATION, t.REPORT], k=9)
        mid, f = run(a, tape)
        out, g = run(b, mid)
        assert run(both, tape) == (out, pytest.approx(f * g))


def test_one_accepting_path():
    """Guesses are decided by the clause: of all paths of a clause one reaches a final state."""
    g, r = t.grammar(), random.Random(4)
    for _ in range(2000):
        paths = [0]
        for x in r.choices(range(t.BREAK), k=10):
            paths = [to for s in paths for to, _, _ in g.arcs[s].get(x, ())]
        assert sum(g.final[s] for s in paths) == 1


PAIRS = [  # insult, aimed, negated, reported; threat with and without a target
    ("moron", "you are a moron", "you are not a moron", "they wrote you are a moron", "I will kill you", "I will kill the process"),
    ("trottel", "du bist ein Trottel", "du bist kein Trottel", "angeblich bist du ein Trottel", "ich werde töten dich", "ich werde töten den Prozess"),
    ("crétin", "tu es un crétin", "tu es pas un crétin", "on écrivait tu es un crétin", "je vais tuer toi", "je vais tuer le processus"),
    ("imbécil", "tú eres un imbécil", "tú nunca eres un imbécil", "dijo tú eres un imbécil", "voy a matar a ustedes", "voy a matar el proceso"),
]


@pytest.mark.parametrize("word, aimed, negated, reported, threat, idle", PAIRS)
def test_minimal_pairs(word, aimed, negated, reported, threat, idle):
    lex = t.Lexicon(weights={word: t.SEED_WEIGHT})
    s = lambda x: t.score_text(x, lex)
    assert s(aimed) >= 0.7 and s(aimed) > s(word) > s(negated) and s(reported) < s(aimed)
    assert s(threat) >= 0.7 and s(idle) < 0.5 and s(idle) == s("")

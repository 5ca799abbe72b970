"""Near copies at a similarity against brute force."""

import random

import corpus_pipeline as cp
import pytest
from test_corpus import DOC, brute_fingerprint, none, odd, words  # noqa: F401

from plexar.llm import near_copies


def jaccard(a, b):
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    x, y = sets
    return len(x & y) / len(x | y) if x | y else 1.0


def brute_kept(rows):
    """(id, text) of the least row of each group."""
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if jaccard(rows[a][1] or "", rows[b][1] or "") >= 0.8 - 1e-9:
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(find(k), []).append((i is None, i or 0))
    return sorted(str(min(v)[1] if not min(v)[0] else None) for v in least.values())


def edited(n, seed):
    """Texts of 5 to 150 words and copies with up to a few words changed, on both sides of the threshold."""
    r = random.Random(seed)
    base = [words(m, f"{seed}/{m}").split() for m in (5, 6, 8, 9, 20, 60, 90, 150)]
    out = []
    for k in range(n):
        w = list(base[k % len(base)])
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = words(1, r.random())
        out.append((k, " ".join(w + words(r.randint(0, 3), k).split())))
    return out + [(900, None), (901, " "), (902, ""), (903, "One two")] + [(910 + k, words(70, "shared") + " " + words(70, k)) for k in range(12)]


@pytest.mark.parametrize("seed", [2, 6])
def test_equals_brute_force(spark, seed):
    rows = edited(160, seed)
    got = near_copies.keep_one_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(x["doc_id"]) for x in got) == brute_kept(rows) and len(got) < len(rows)


def test_pipeline_stage_reaches_its_threshold(spark):
    """A copy at similarity 0.8 or more whose four-word fingerprint is far beyond four bits goes."""
    base = words(200, "far").split()
    for seed in range(100):
        r = random.Random(seed)
        w = list(base)
        for at in r.sample(range(10, 190), 4):
            w[at] = words(1, f"{seed}/{at}")
        a, b = " ".join(base), " ".join(w)
        if bin(brute_fingerprint(a) ^ brute_fingerprint(b)).count("1") > 4 and jaccard(a, b) >= 0.8:
            break
    else:
        raise AssertionError("no such pair")
    docs = spark.createDataFrame([(1, a, "en", "s", 1), (2, b, "en", "s", 1), (3, words(200, "other"), "en", "s", 1)], DOC)
    assert sorted(x["doc_id"] for x in cp.near_dedup(spark, docs, "").collect()) == [1, 3]


def test_odd(spark, odd):  # noqa: F811
    got = near_copies.keep_one_similar(odd)
    assert got.columns == odd.columns
    # 12 lines, no words, the long text, "É x", "x", and the other text of id 3
    assert sorted(x["doc_id"] for x in got.collect()) == [1, 3, 3, 6, 7, 8]
    assert near_copies.keep_one_similar(none(spark)).count() == 0


def test_bands_meet_at_the_threshold():
    """Of pairs of sets at similarity 0.8, at least 99 in 100 share a band; at 0.3, fewer than 1 in 10."""
    import numpy as np

    rng = np.random.default_rng(3)

    def met(n, both):
        hits = 0
        for _ in range(400):
            x = np.unique(rng.integers(-(1 << 62), 1 << 62, 2 * n - both))
            hits += bool(set(near_copies.bands_of(np.sort(x[:n]))) & set(near_copies.bands_of(np.sort(x[n - both :]))))
        return hits / 400

    assert met(180, 160) >= 0.99 and met(9, 8) >= 0.99 and met(130, 60) < 0.1


def test_differing_bytes(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    a = rng.integers(0, 4, (200, 100)).astype(np.uint64) * np.uint64(85)
    b = np.where(rng.random((200, 100)) < 0.5, a, rng.integers(0, 1 << 40, (200, 100)).astype(np.uint64))
    rows = [(near_copies.bytes_of(x).tolist(), near_copies.bytes_of(y).tolist(), int((x.astype(np.uint8) != y.astype(np.uint8)).sum())) for x, y in zip(a, b)]
    df = spark.createDataFrame(rows, "a array<long>, b array<long>, n int")
    assert df.where(near_copies.differing("a", "b") == near_copies.F.col("n")).count() == 200


def test_large_group_is_not_compared_pair_by_pair(spark, monkeypatch):
    """300 near copies of one text are joined with few comparisons, and one stays."""
    base = words(300, "large").split()
    rows = []
    for k in range(300):
        w = list(base)
        w[random.Random(k).randrange(300)] = f"own{k}"
        rows.append((k, " ".join(w)))
    compared = []
    save = near_copies.Scratch.save

    def counted(self, df, name="t"):
        out = save(self, df, name)
        if name == "compared":
            compared.append(out.count())
        return out

    monkeypatch.setattr(near_copies.Scratch, "save", counted)
    got = near_copies.keep_one_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [x["doc_id"] for x in got] == [0] and sum(compared) < 300 * 2 * near_copies.BANDS
    assert compared[-1] < 300


def test_choosing_centres_takes_a_row_for_each_member(spark, monkeypatch):
    """No table written after the index of a large group of near copies has more than two rows for each member, and the
    centre is the text that the others were made from."""
    base = words(300, "centre").split()
    rows = [(0, " ".join(base))]
    for k in range(1, 200):
        w = list(base)
        for at in random.Random(k).sample(range(0, 300, 5), 3):
            w[at] = f"own{k}x{at}"
        rows.append((k, " ".join(w)))
    made, first = [], []
    save = near_copies.Scratch.save

    def counted(self, df, name="t"):
        out = save(self, df, name)
        if made or name == "sizes":
            made.append((name, out.count()))
            if name == "open" and not first:
                first.extend(x["s"] for x in out.collect())
        return out

    monkeypatch.setattr(near_copies.Scratch, "save", counted)
    got = near_copies.keep_one_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [x["doc_id"] for x in got] == [0]
    assert max(n for _, n in made) <= 2 * len(rows), made
    assert first == [near_copies.name_of(near_copies.shingle_set(rows[0][1]))]


def test_majorities(spark):
    """The bitwise majority of each group, of whichever rows."""
    import numpy as np

    rng = np.random.default_rng(8)
    x, g = rng.integers(-(1 << 63), (1 << 63) - 1, (50, near_copies.WORDS), dtype=np.int64), rng.integers(0, 3, 50)
    rows = [(int(k), row.tolist()) for k, row in zip(g, x)]
    got = {r["mg"]: r["m"] for r in near_copies.majorities(spark.createDataFrame(rows, "g long, sig array<long>")).collect()}
    bits = (x.view(np.uint64)[:, :, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    for k in range(3):
        most = 2 * bits[g == k].sum(axis=0) > (g == k).sum()
        assert got[k] == [int(sum(1 << j for j in range(64) if row[j])) - (1 << 64) * int(row[63]) for row in most]


def test_drifted_copies_are_paired_by_their_differences(spark, monkeypatch):
    """Copies that drift away from a text in different degrees, most below the threshold: the groups are those of all
    pairs, and few pairs are compared, although all share bands."""
    base = words(150, "drift").split()
    texts = []
    for k in range(240):
        r = random.Random(k)
        w = list(base)
        for at in r.sample(range(150), r.choice([1, 2, 6, 8, 9, 10])):
            w[at] = f"own{k}x{at}"
        texts.append(w)
    for k in range(40):  # copies of drifted copies, which lie far from the middle but near one other
        w = list(texts[3 * k])
        w[random.Random(900 + k).randrange(150)] = f"again{k}"
        texts.append(w)
    rows = [(k, " ".join(w)) for k, w in enumerate(texts)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    root = list(range(len(rows)))
    for _ in range(len(rows)):
        new = [min([root[i], *(root[j] for j in range(len(rows)) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))]) for i in range(len(rows))]
        if new == root:
            break
        root = new
    compared = {}
    save = near_copies.Scratch.save

    def counted(self, df, name="t"):
        out = save(self, df, name)
        if name in ("compared", "many"):
            compared.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(near_copies.Scratch, "save", counted)
    for stars in (1, 3):
        compared.clear()
        monkeypatch.setattr(near_copies, "STARS", stars)
        got = near_copies.keep_one_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted(x["doc_id"] for x in got) == sorted(set(root)) and len(got) > 20
        assert compared["many"][0] > 100 and compared["compared"][-1] < len(rows) * 4, compared

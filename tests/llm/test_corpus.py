"""Every corpus operator against a plain version, and on odd rows: nulls, empty and long texts, repeats, clashing names."""

import collections
import hashlib
import math
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from plexar.llm import decontam, html_extract, line_dedup, mixing, quality, secrets, simhash, toxicity, unit_dedup, warc
from plexar.llm.common import Scratch, components

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 6))) for _ in range(n))


def lines(n, seed, each=9):
    return "\n".join(words(each, f"{seed}-{k}") for k in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with everything that may go wrong; the extra columns clash with names that operators use."""
    long = lines(3000, "long")
    rows = [
        (1, lines(12, "a"), "en", "s1", 5), (2, lines(12, "a"), "en", "s1", 5), (2, lines(12, "a"), "en", "s1", 5), (None, lines(12, "a"), None, None, None), (None, None, None, None, None),
        (3, None, "en", "s2", None), (4, "", "en", "s2", 0), (5, " \t\n\n ", "en", "s3", 4), (6, long, "fr", "s1", 1), (7, "É x " * 30, "fr", "s3", 3), (8, "x", None, "s2", 1), (3, "other row of three", "en", None, 2),
    ]
    df = spark.createDataFrame(rows, DOC)
    return df.withColumns({"id": F.lit("i"), "th": F.lit(1), "pos": F.lit(2), "size": F.lit("z"), "w": F.lit(0), "l": F.lit(0), "score": F.lit(0), "__keep": F.lit(9), "__id": F.lit(9), "value": F.lit("v"), "h": F.lit(0), "u": F.lit(0), "fp": F.lit(1), "bytes": F.lit(1), "url": F.lit("u")})


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, words(30, "bench")), (2, words(30, "bench")), (3, None), (4, "short one"), (5, "")], "item_id long, text string")


def none(spark, schema=DOC):
    return spark.createDataFrame([], schema)


# --- 1


def brute_mix(rows, weights=(3, 1, 2)):
    size = collections.Counter()
    for _, text, source in rows:
        size[source] += len(SPACE.findall(text or ""))
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    budget, target, left = 1.5 * sum(size.values()), {}, set(names)
    while True:
        level = (budget - sum(target.values())) / sum(w[s] for s in left)
        over = {s for s in left if level * w[s] > 2 * size[s]}
        if not over:
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= over
    return size, target | {s: level * w[s] for s in left}


def test_mix(spark):
    r = random.Random(3)
    rows = [(k, words(r.randint(0, 60), k), r.choice(["b", "a", "ä", None, "Z"]) if k % 3 else "hot") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_plan(df).collect()
    size, target = brute_mix(rows)
    taken = collections.Counter()
    for x in got:
        assert x["target"] == pytest.approx(target[x["source"]]) and x["source_size"] == size[x["source"]] and 0 <= x["taken"] <= 2 * x["size"]
        taken[x["source"]] += x["taken"]
    assert all(abs(taken[s] - target[s]) <= 31 for s in size) and sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    again = mixing.mix_plan(df.repartition(7)).collect()
    assert sorted((x["doc_id"], x["taken"]) for x in again) == sorted((x["doc_id"], x["taken"]) for x in got)
    mixed = mixing.mix(df).collect()
    assert sorted((x["doc_id"], x["repeats"]) for x in mixed) == sorted((x["doc_id"], x["repeats"]) for x in got if x["repeats"] and x["size"])


def test_mix_odd(spark, odd):
    plan = mixing.mix_plan(odd).collect()
    assert len(plan) == odd.count() and all(x["taken"] == 0 for x in plan if x["size"] == 0)
    assert set(odd.columns) <= set(mixing.mix(odd).columns)
    assert mixing.mix_plan(none(spark)).count() == 0 and mixing.mix(none(spark)).count() == 0


# --- 2


def test_toxicity_grammar():
    lex = toxicity.Lexicon()
    s = lambda t: toxicity.score_text(t, lex)
    assert s("You are an idiot.") >= 0.7 and s("The weather is fine.") < 0.5
    assert s("You are not an idiot.") < s("You are an idiot.")
    assert s('He said that you are an idiot.') < s("You are an idiot.")
    assert s("I will kill you.") >= 0.7 and s("I will kill the process.") < 0.5
    assert s("not. idiot you") > s("not an idiot you")  # a negation ends with its clause
    assert 0 <= s(None) == s("") < 0.5


def test_toxicity_learns(spark):
    r = random.Random(1)
    rows, labels = [], []
    for k in range(600):
        toxic = k % 5 == 0
        w = words(40, k).split()
        if toxic:
            for _ in range(3):
                w.insert(r.randrange(len(w)), "zork" + r.choice(["ab", "cd", "ef", "gh", "ij"]))
        rows.append((k, " ".join(w), "xx", "s", 1))
        labels.append((k, 1, int(toxic)))
    copies = [(1000 + k, rows[0][1].replace("zork", "bork"), "xx", "s", 1) for k in range(60)]  # many copies teach nothing
    labels += [(1000 + k, 1, 1) for k in range(60)]
    docs = spark.createDataFrame(rows + copies, DOC)
    lab = spark.createDataFrame([*labels, (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    lex = toxicity.train(docs, lab)
    assert "zork" in lex.stems and not any(x in lex.weights for x in rows[0][1].split() if not x.startswith("zork"))
    got = toxicity.toxicity(docs, lab, lexicon=lex).where("held_out AND doc_id < 1000").collect()
    assert all((x["predicted"] == 1) == (x["doc_id"] % 5 == 0) for x in got) and len(got) > 150


def test_toxicity_odd(spark, odd):
    lab = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(odd, lab).collect()
    assert len(got) == odd.count() and all(0 <= x["score"] <= 1 for x in got) and not [x for x in got if x["doc_id"] is None and x["held_out"]]
    assert toxicity.toxicity(none(spark), lab.limit(0)).count() == 0


# --- 3


def brute_lines(rows, n=3):
    first, out = {}, []
    for i, text in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)):
        ls = (text or "").split("\n")
        gone = set()
        for p in range(len(ls) - n + 1):
            if first.setdefault(tuple(ls[p : p + n]), (i, p)) != (i, p):
                gone |= set(range(p, p + n))
        out.append((i, len(gone), None if text is None else "\n".join(x for p, x in enumerate(ls) if p not in gone)))
    return out


def test_line_dedup(spark):
    r = random.Random(5)
    pool = [words(4, k) for k in range(30)]
    rows = [(k, "\n".join(pool[(r.randrange(30) if r.random() < 0.3 else j) % 30] for j in range(r.randint(0, 9)))) for k in range(120)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x["doc_id"], x["n_removed"], x["text"]) for x in got) == sorted(brute_lines(rows))


def test_line_dedup_leaves_texts_without_repeats_in_place(spark, monkeypatch):
    """Only documents that lose lines go through the join of texts; beyond the bound all do, with the same result."""
    r = random.Random(6)
    pool = [words(4, k) for k in range(40)]
    rows = [(k if k % 9 else None, "\n".join([f"{k}/{j}" for j in range(4)] if k % 3 else pool[r.randrange(30) :][:5])) for k in range(60)] + [(70, None), (71, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    few = line_dedup.line_dedup(docs)
    assert "LeftAnti" in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", 0)
    all_ = line_dedup.line_dedup(docs)
    assert few.schema == all_.schema
    key = lambda x: tuple(map(str, x))
    got = sorted(few.collect(), key=key)
    assert got == sorted(all_.collect(), key=key) and len(got) == len(rows) and any(x["n_removed"] for x in got)


def test_line_dedup_odd(spark, odd):
    got = line_dedup.line_dedup(odd).collect()
    assert len(got) == odd.count() and set(odd.columns) <= set(got[0].asDict())
    by = collections.defaultdict(list)
    for x in got:
        by[x["doc_id"]].append(x)
    assert by[1][0]["n_removed"] == 0 and [x["text"] for x in by[2]] == ["", ""] and all(x["n_removed"] == 12 for x in by[2])  # repeated rows agree
    assert {x["text"] for x in by[None]} == {None, ""} and by[6][0]["n_removed"] == 0 and by[4][0]["n_lines"] == 1
    assert line_dedup.line_dedup(none(spark)).count() == 0


# --- 4


def brute_fingerprint(text):
    w = [x.translate({k: k + 32 for k in range(65, 91)}) for x in SPACE.findall(text or "")]
    g = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows):
    fp = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if bin(fp[a] ^ fp[b]).count("1") <= 4:
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted((str(i), f"{fp[k]:016x}", str(least.get(find(k)))) for k, (i, _) in enumerate(rows))


def near_copies(n, seed=2):
    r = random.Random(seed)
    out = []
    for k in range(n):
        base = words(120, f"near{k % 6}").split()
        for _ in range(r.randint(0, 3)):
            base[r.randrange(len(base))] = words(1, r.random())
        out.append((k, " ".join(base)))
    return out + [(900 + k, words(k, f"solo{k}")) for k in range(30)]


def test_simhash(spark):
    rows = near_copies(150) + [(5, "A b\tC\x0bD e"), (6, "a B c d E"), (None, None), (8, ""), (9, " "), (10, "É a b c d e"), (None, words(120, "near1"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(str(x["doc_id"]), x["fingerprint"], str(x["component_id"])) for x in simhash.simhash_groups(df).collect()]
    assert sorted(got) == brute_groups(rows)


@pytest.mark.parametrize(("page", "fan"), [(4, 2), (16, 32)])
def test_simhash_divided_nodes(spark, monkeypatch, page, fan):
    """Nodes of several pages, and groups of pages; nothing is lost."""
    import numpy as np

    monkeypatch.setattr(simhash, "PAGE_FAN", fan)
    monkeypatch.setattr(simhash, "node_masks", lambda radius, n, page: [m for m in simhash.block_masks(radius + 1)])
    fps = [int(x) for x in np.unique(np.array([simhash.fingerprint(t) for _, t in near_copies(400, 8)], np.int64))]
    scratch = Scratch(spark)
    links = simhash.links_of(spark.createDataFrame([(x,) for x in fps], "fp long"), scratch, 4, page).collect()

    def groups(pairs):
        root = {x: x for x in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for x, y in pairs:
            root[max(find(x), find(y))] = min(find(x), find(y))
        return {x: find(x) for x in fps}

    assert groups((r[0], r[1]) for r in links) == groups((x, y) for x in fps for y in fps if ((x ^ y) & (2**64 - 1)).bit_count() <= 4)


def test_simhash_tree_prunes():
    """All links come through the tree, which prunes most pairs before they are compared."""
    import numpy as np

    rng = np.random.default_rng(1)
    f = np.unique(rng.integers(-(1 << 62), 1 << 62, 6000))
    f = f[np.argsort(simhash.gray_rank(f.astype(np.uint64)))]
    stats = {}
    one = np.array([0])
    simhash.tree_links(f, np.array([len(f)]), one, one, 4, stats)
    assert stats["pruned"] > 10_000 and stats["compared"] < 0.35 * len(f) ** 2 / 2


def test_simhash_index_links():
    import numpy as np

    rng = np.random.default_rng(4)
    for n, flips in ((1, 0), (40, 3), (900, 6), (900, 64)):
        centre = rng.integers(0, 1 << 62, 6).astype(np.uint64)
        f = centre[rng.integers(0, 6, n)]
        for _ in range(flips):
            f ^= (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) * (rng.random(n) < 0.5).astype(np.uint64)
        f = np.unique(f)
        f = f[np.argsort(simhash.gray_rank(f))]
        some = np.flatnonzero(np.arange(len(f)) % 7 < 3)  # laid out as two pages, paired within and between
        f = np.r_[f[some], np.delete(f, some)]
        sizes = np.array([x for x in (len(some), len(f) - len(some)) if x])
        p, q = np.triu_indices(len(sizes))
        a, b = simhash.tree_links(f.view(np.int64), sizes, p, q, 4)
        assert len(a) < max(len(f), 1)

        def groups(pairs, f=f):
            root = {int(x): int(x) for x in f}

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x

            for x, y in pairs:
                root[max(find(int(x)), find(int(y)))] = min(find(int(x)), find(int(y)))
            return {x: find(x) for x in root}

        want = [(f[i], f[j]) for i in range(len(f)) for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 4) if j < i]
        assert groups(zip(a.view(np.uint64), b.view(np.uint64))) == groups(want)


def test_simhash_odd(spark, odd):
    assert simhash.simhash_groups(odd).count() == odd.count() and simhash.simhash_groups(none(spark)).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [x["doc_id"] for x in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 6, 7, 8] and ids.count(None) == 2
    assert simhash.keep_one(none(spark)).count() == 0


def test_components(spark):
    r = random.Random(1)
    pairs = [(k, k + 1) for k in range(60)] + [(100, 200 + k) for k in range(50)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(70)] + [(5, 5)]
    got = {x["node"]: x["root"] for x in components(spark, Scratch(spark), spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {}
    for a, b in pairs:
        if a != b:
            ra, rb = (root.setdefault(x, {x}) for x in (a, b))
            if ra is not rb:
                ra |= rb
                for x in rb:
                    root[x] = ra
    assert got == {x: min(s) for x, s in root.items()}


# --- 5


def test_forest_held_out(spark):
    """Findings of another seed are judged right."""
    rows = [(k, f"{b} {t} {a}", p, y) for k, (t, b, a, p, y) in enumerate(secrets.labelled_findings(600, seed=77))]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string, y int")).collect()
    y = {r[0]: r[3] for r in rows}
    best = collections.defaultdict(bool)
    for x in got:
        best[x["doc_id"]] |= x["is_secret"]
    right = sum(best[k] == bool(v) for k, v in y.items())
    assert right / len(y) > 0.93


def test_secrets(spark, odd):
    key, token = "AKIA" + "Q7WZ" * 4, "0641917ea4e9feb9cda83477b57ac2654884f485"
    rows = [(1, f"foo bar {key} baz", "", "s", 1), (2, f'and token = "{token}" here', "", "s", 1), (3, "mail kpro.66@mail3.example.com and 4691172130117446", "", "s", 1), (4, f"see sha256 checksum {token} of build", "", "s", 1)]
    df = spark.createDataFrame(rows, DOC)
    found = {(x["doc_id"], x["value"]) for x in secrets.scan(df).where("is_secret").collect()}
    assert found == {(1, key), (2, token)}
    clean = {x["doc_id"]: x["text"] for x in secrets.redact(df).collect()}
    assert clean[1] == "foo bar [secret] baz" and clean[3] == rows[2][1]
    assert secrets.scan(odd).count() == 0 and secrets.redact(odd).count() == odd.count()
    assert secrets.scan(none(spark)).count() == 0


# --- 6


def plain(text):
    return [w for w in SPACE.findall("".join(c for c in (text or "").lower() if c not in decontam.PUNCTUATION))]


def grams(w, k=5):
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]


def brute_leaks(docs, items):
    least = {}
    for i, t in items:
        w = tuple(plain(t))
        if w:
            least[w] = min(least.get(w, i), i)
    out = set()
    for d, t in docs:
        w = plain(t)
        for iw, i in least.items():
            k = min(len(iw), 5)
            g = collections.Counter(grams(list(iw), k))
            best = None
            for s in range(max(len(w) - len(iw), 0) + 1):
                c = collections.Counter(grams(w[s : s + len(iw)], k))
                both, all_ = sum((c & g).values()), sum((c | g).values())
                if c and both / all_ >= 0.8 and (best is None or both / all_ > best[0]):
                    best = (both / all_, s)
            if best:
                out.add((d, i, best[1], round(best[0], 9)))
    return out


def test_decontamination(spark):
    r = random.Random(4)
    items = [(k, words(r.randint(3, 45), f"item{k}")) for k in range(20)] + [(50, "a b " * 12), (51, words(20, "item3"))]
    docs = []
    for k in range(80):
        w = words(r.randint(0, 120), f"doc{k}").split()
        if k % 2:
            passage = items[r.randrange(len(items))][1].split()
            for _ in range(r.randint(0, 2)):
                if passage and k % 4 == 1:
                    passage[r.randrange(len(passage))] = "changed"
            at = r.randint(0, len(w))
            w[at:at] = [x.upper() + "," for x in passage]
        docs.append((k, " ".join(w)))
    docs += [(100, None), (101, ""), (102, "a b " * 40)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"], x["start"], round(x["similarity"], 9)) for x in decontam.contaminated(d, b).collect()}
    assert got == brute_leaks(docs, items) and len(got) > 20
    assert {x["doc_id"] for x in decontam.decontaminate(d, b).collect()} == {k for k, _ in docs} - {x[0] for x in got}


def test_decontamination_odd(spark, odd, bench):
    rows = odd.unionByName(odd.where("doc_id = 8").withColumn("text", F.lit("x. " + words(30, "bench").title() + " y")))
    got = decontam.contaminated(rows, bench).collect()
    assert [(x["doc_id"], x["item_id"], x["start"]) for x in got] == [(8, 1, 1)]
    clean = decontam.decontaminate(rows, bench)
    assert clean.columns == odd.columns and clean.count() == odd.count() - 1
    assert decontam.contaminated(none(spark), bench).count() == 0 and decontam.decontaminate(odd, bench.limit(0)).count() == odd.count()


def test_blocks_hold_the_radius(spark):
    """Every fingerprint within RADIUS meets in a block, and is taken once; the keys select."""
    assert decontam.BLOCKS * (decontam.ERRORS + 1) > decontam.RADIUS and decontam.block_edges()[-1] == 64
    r = random.Random(8)
    rows = []
    for k in range(300):
        a = r.getrandbits(64)
        b = a ^ sum(1 << x for x in r.sample(range(64), r.randint(0, decontam.RADIUS)))
        rows.append((k, *(x - (1 << 64) if x >= 1 << 63 else x for x in (a, b)), 30))
    df = spark.createDataFrame(rows, "k int, a long, b long, len int")
    filed = df.select("k", "a", F.explode(decontam.near_keys("a", "len")).alias("key"))
    met = df.select(F.col("k").alias("k2"), "b", F.explode(decontam.own_keys("b", "len")).alias("x")).join(filed, F.col("x.key") == F.col("key"))
    met = met.where(decontam.first_block("a", "b") == F.col("x.b"))
    assert met.where("k = k2").count() == 300 and met.where("k <> k2").count() < 0.8 * 300 * 299


def test_short_items(spark):
    """Items of fewer than five words match their very words."""
    d = spark.createDataFrame([(1, "say Yes, or no! now"), (2, "yes or"), (3, "yes or no"), (4, "yes or not"), (5, "it is so")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "Yes or no"), (2, "so"), (3, "!")], "item_id long, text string")
    assert {(x["doc_id"], x["item_id"], x["start"], x["n_words"]) for x in decontam.contaminated(d, b).collect()} == {(1, 1, 1, 3), (3, 1, 0, 3), (5, 2, 2, 1)}


def test_items_found_at_the_limit(spark):
    """Of windows whose similarity lies between 0.8 and 0.9, at least 99 in 100 are found by their fingerprints."""
    r = random.Random(12)
    items = [(k, words(r.randint(20, 60), f"limit{k}")) for k in range(60)]
    docs = []
    for k, t in items:
        for c in range(5):
            w = t.split()
            w[r.randrange(len(w))] = f"changed{c}"
            docs.append((1000 * k + c, " ".join([*words(r.randint(0, 9), f"before{k}{c}").split(), *w, "end"])))
    want = brute_leaks(docs, items)
    want = {x[:2] for x in want if x[3] < 0.9}
    found = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(x["doc_id"], x["item_id"]) for x in found.collect()}
    assert len(want) > 100 and len(want & got) >= 0.99 * len(want)


# --- 7


def test_warc(spark, tmp_path):
    big = "<p>" + "é" * 300_000 + "</p>"
    rows = [(4, "http://a/", big), (2, "http://b/ x\r\ny", big), (9, None, big), (5, "u", "short"), (6, "u", "short"), (7, "u", None), (8, "u", ""), (1, "u", "WARC/1.1\r\n\r\n" * 20), (None, "u", big), (None, "u", "alone" * 30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(x["page_id"], x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"]) for x in warc.round_trip(pages).collect()}
    want = set()
    for i, _, h in rows:
        b = (h or "").encode()
        visit = h == big and i != 2
        want.add((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if visit else "response", 2 if visit else None))
    assert got == want
    archive = warc.record_chunks(pages, chunk=50_000).cache()
    assert archive.agg(F.max(F.length("data"))).first()[0] < 51_000 and archive.where("chunk > 5").count() > 0
    assert warc.read_records(archive).count() == len(rows)
    assert warc.export(archive, str(tmp_path / "w")).agg(F.sum("records")).first()[0] == len(rows)
    files = {(x["id"], x["payload_digest"]) for x in warc.read_files(spark, str(tmp_path / "w")).collect()}
    assert files == {("" if i is None else str(i), hashlib.sha256((h or "").encode()).hexdigest()) for i, _, h in rows}
    assert warc.round_trip(pages.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "u", big)] * 2 + [(3, "u", big)], pages.schema)
    assert sorted((x["page_id"], x["record_type"]) for x in warc.round_trip(twice).collect()) == [(1, "response"), (1, "response"), (3, "revisit")]


def test_warc_damage():
    head = warc.header("response", "1", None, hashlib.sha256(b"abc").hexdigest(), 3, None)
    for data in (head + b"abd\r\n\r\n", head + b"ab", b"x\r\n\r\n"):
        p = warc.Parser()
        with pytest.raises(ValueError):
            p.feed(data)
            p.result()
    p = warc.Parser()
    for k in range(0, len(head), 7):  # a header may be cut anywhere
        p.feed(head[k : k + 7])
    p.feed(b"abc\r\n\r\n")
    assert p.result()[1:4] == (3, hashlib.sha256(b"abc").hexdigest(), "response")


# --- 8


def test_units(spark, odd):
    rows = [(1, "One two three four five\nshort\n\nSix seven eight nine ten"), (2, "x y z v w q\n  ONE  two three\tfour FIVE \nshort\nSix seven eight nine ten"), (3, "Six seven eight nine ten\nSix seven eight nine ten\ntail of five words here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x["id"], x["start"], x["n_chars"], x["n_words"], x["first_id"], x["first_start"]) for x in unit_dedup.duplicate_units(df, unit="line", min_run=0).collect())
    assert got == [(2, 12, 27, 5, 1, 0), (2, 46, 24, 5, 1, 31), (3, 0, 24, 5, 1, 31), (3, 25, 24, 5, 1, 31)]
    clean = {x["doc_id"]: x["text"] for x in unit_dedup.remove_units(df, unit="line", min_run=0).collect()}
    assert clean == {1: rows[0][1], 2: "x y z v w q\nshort", 3: "tail of five words here"}
    spans = {x["doc_id"]: [rows[x["doc_id"] - 1][1][a : a + n] for a, n in x["removed"]] for x in unit_dedup.remove_units(df, unit="line", min_run=0).collect()}
    assert spans[3] == ["Six seven eight nine ten"] * 2 and spans[1] == []
    p = spark.createDataFrame([(1, "a b c d e\nf\n\nnext one here and there"), (2, "pre pre pre pre pre\n \nA b c d e\nF")], "doc_id long, text string")
    assert [(x["id"], x["start"]) for x in unit_dedup.duplicate_units(p, unit="paragraph", min_run=0).collect()] == [(2, 22)]
    assert {x["doc_id"]: x["text"] for x in unit_dedup.remove_units(p, unit="paragraph", min_run=0).collect()}[2] == "pre pre pre pre pre"
    out = unit_dedup.remove_units(odd).collect()
    assert len(out) == odd.count() and {x["text"] for x in out if x["doc_id"] == 2} == {""} and all(x["removed"] == [] for x in out if x["doc_id"] in (1, 6))
    assert unit_dedup.duplicate_units(none(spark)).count() == 0 and unit_dedup.remove_units(none(spark)).count() == 0


# --- 9


def test_html(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><script>var x='</p><p>no';</script></head><body><header><a href=/>Home</a></header><nav><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></nav>
      <div class="cookie notice">We use cookies.</div><article><h1>Head  &amp; tail</h1><p>First <b>bold</b> &eacute;&#33; text,
      more.<p>Second paragraph, with some words in it.</p></article><aside>Related things</aside><div class="comments"><h3>Comments</h3><p>I liked this.</p></div><form><label>Mail</label><input></form><footer>&copy; Us</footer></body></html>"""
    assert html_extract.main_text(page) == "Head & tail\n\nFirst bold é! text, more.\n\nSecond paragraph, with some words in it."
    rows = [(1, "u", page), (1, "u", page), (None, None, None), (3, "u", ""), (4, "u", "<<<p>&#x0;<![CDATA[ x"), (5, "u", "<!-- never closed"), (6, "u", "<div>" * 3000 + "deep")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) and all(x["n_chars"] == len(x["text"]) for x in got) and [x["text"] for x in got if x["page_id"] in (None, 3)] == ["", ""]
    assert html_extract.extract(none(spark, "page_id long, url string, html string")).count() == 0


def test_html_held_out():
    """The committed weights on generated pages that training did not see."""
    from plexar.llm.html_train import accuracy

    blocks, pages = accuracy(html_extract.weights(), 150, seed=4242)
    assert blocks > 0.98 and pages > 0.88


def test_html_network_sees_context():
    """A block's label depends on the blocks around it, on both sides."""
    net = html_extract.weights()
    b = html_extract.blocks_of("<p>One short text.</p><p>Two short text.</p><p>Three short text.</p>")
    whole, alone = html_extract.label(b, net), html_extract.label(b[:1], net)
    assert len(whole) == 3 and abs(whole[0] - alone[0]) > 1e-6


# --- 10


def brute_quality(text):
    t = text or ""
    w = SPACE.findall(t)
    seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    ls = [x for x in t.split("\n") if SPACE.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(ls) - len(set(ls)), len(covered)


def test_quality(spark, odd):
    r = random.Random(9)
    rows = [(k, "\n".join(r.choice([words(5, r.randrange(12)), "# $ |", "", " ", words(9, k)]) for _ in range(r.randint(0, 25)))) for k in range(150)]
    rows += [(200 + k, lines(9, f"good{k}")) for k in range(5)]
    df = spark.createDataFrame([*rows, (900, None)], "doc_id long, text string")
    text = dict(rows) | {900: None}
    for x in quality.quality_report(df).collect():
        n, chars, sym, dup, rep = brute_quality(text[x["doc_id"]])
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == (n, chars, sym, dup, rep)
        assert x["base_failed"] == (n < 50 or 100 * rep > 50 * n) and not (x["base_failed"] and x["kept"])
    kept = {x["doc_id"] for x in quality.quality_report(df).where("kept").collect()}
    assert kept and kept == {x["doc_id"] for x in quality.quality_filter(df).collect()}
    got = quality.quality_filter(odd)
    assert got.columns == odd.columns and {x["doc_id"] for x in got.collect()} == {1, 2, 6, None}
    assert quality.quality_report(odd).count() == odd.count() and quality.quality_report(none(spark)).count() == 0 and quality.quality_filter(none(spark)).count() == 0


def test_quality_cascade():
    """Order follows rejection per cost; a rejected text enters no later rule."""
    calls = []

    def rule(name, rejects, cost):
        def f(x):
            calls.append(name)
            sum(range(cost))
            return rejects(x)

        return quality.Rule(name, f)

    rules = [rule("dear", lambda x: True, 200_000), rule("cheap", lambda x: True, 1), rule("idle", lambda x: False, 1)]
    order = quality.order_rules(["a"] * 20, rules)
    assert [r.name for r in order] == ["cheap", "dear", "idle"]
    calls.clear()
    assert quality.verdict(quality.Features("x"), order) == "cheap" and calls == ["cheap"]
    assert quality.order_rules([], rules) == tuple(rules)
    assert math.isclose(quality.Features("a b c").word_chars, 4)

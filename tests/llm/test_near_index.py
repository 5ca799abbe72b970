"""The pipeline's near-dedup goes through SimHash and its Gray-order index over masked bit patterns."""

import numpy as np

from plexar.llm import near_copies, simhash
from test_corpus import words


def test_pair_chance():
    """Sets of similarity 0.8 are within the radius and share a masked pattern."""
    rng, masks, hits = np.random.default_rng(4), simhash.wide_masks(50_000, near_copies.WORDS, near_copies.APART), 0
    for k in range(400):
        n = (9, 45, 300)[k % 3]
        x = rng.integers(-(1 << 63), (1 << 63) - 1, n + n // 9, dtype=np.int64)
        a, b = near_copies.simhash_of(np.sort(x[:n])), near_copies.simhash_of(np.sort(x[n // 9 :]))
        assert int(np.bitwise_count((a ^ b).view(np.uint64)).sum()) <= near_copies.RADIUS
        hits += bool((simhash.nodes_of(a[None], masks) == simhash.nodes_of(b[None], masks)).any())
    assert hits >= 399


def test_links_over_pages(spark):
    """Links of several words, over nodes of many pages, connect what pairs that share a node and are near connect."""
    from plexar.llm.common import Scratch, components

    rng, words_, radius, apart = np.random.default_rng(5), 2, 12, 8
    base = rng.integers(-(1 << 63), (1 << 63) - 1, (20, words_), dtype=np.int64)
    fp = base[rng.integers(0, 20, 400)]
    for row in fp:
        for bit in rng.integers(0, 64 * words_, rng.integers(0, 9)):
            row[bit // 64] ^= np.int64(np.uint64(1 << int(bit % 64)).astype(np.int64))
    scratch = Scratch(spark)
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(fp)], "s long, sig array<long>")
    links, _ = simhash.wide_links(rows, scratch, words_, radius, apart, page=4)
    got = {r["node"]: r["root"] for r in components(spark, scratch, links).collect()}
    u = fp.view(np.uint64)
    nodes = simhash.nodes_of(fp, simhash.wide_masks(400, words_, apart))
    root = list(range(400))

    def of(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(400):
        near = np.bitwise_count(u[i] ^ u[:i]).sum(axis=1) <= radius
        for j in np.flatnonzero(near & (nodes[i] == nodes[:i]).any(axis=1)):
            x, y = sorted((of(i), of(int(j))))
            root[y] = x
    assert {k: got.get(k, k) for k in range(400)} == {k: of(k) for k in range(400)}


def test_stage_uses_index(spark, monkeypatch):
    import corpus_pipeline as cp

    calls = []
    real = near_copies.wide_links
    monkeypatch.setattr(near_copies, "wide_links", lambda *a, **k: calls.append(1) or real(*a, **k))
    text = words(80, "x")
    rows = [(1, text, "en", "s", 1), (2, text + " end", "en", "s", 1), (3, words(80, "y"), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in cp.near_dedup(spark, docs, "").collect()) == [1, 3] and calls

"""SimHash near-dedup with a Gray-order hierarchical index over masked bit patterns.

Fingerprints within ``radius`` bits of each other agree on at least one of ``radius + 1`` blocks of bits, on two of
``radius + 2`` and so on. The upper nodes of the index are these shared masked patterns; with more fingerprints more
blocks are shared, so that a node's expected size stays below PAGE. Below the patterns, a node's fingerprints are
sorted by Gray rank over the whole cluster and cut into pages of PAGE, and a page into groups of FAN, groups of groups
and so on; each group carries the bits that all its members share (``and`` and ``or`` of its members). All links come
from one descent through these groups: two groups are compared by the bits in which all members of one differ from
all of the other; beyond the radius, the whole pair of groups is pruned; a pair in which even the differing bits of all
members together stay within the radius is linked as a whole; any other is opened. Pages of a node that has several
are paired by the same rule, on groups of pages.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, fresh, text_of

#: Fingerprints of a page, children of a group, pages of a node that are paired at once, and rows a task pairs at once.
PAGE, FAN, PAGE_FAN, AT_ONCE = 2048, 4, 32, 1 << 18


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The signed 64-bit SimHash of a text; 0 without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z are lowered, only 09-0D and 20 split
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size)
    start, k = end - size, min(shingle, len(words))
    starts, ends = start[: len(words) - k + 1].tolist(), (end[k - 1 :] - 1).tolist()
    total = np.zeros(64, np.int64)
    for i in range(0, len(starts), 8192):
        h = np.array([xxh64_intdigest(line[a:b], 42) for a, b in zip(starts[i : i + 8192], ends[i : i + 8192])], np.uint64)
        total += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * total > len(starts))
    return int(bits.view(">u8")[0].astype(np.uint64).astype(np.int64))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 4) -> DataFrame:
    """(id, fp): one row per row of docs, fp signed 64-bit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "fp": np.array([fingerprint(t, shingle) for t in b["text"]], np.int64)})

    rows = docs.select(F.col(id_col).cast("string").alias("id"), text_of(text_col).alias("text"))
    kind = docs.schema[id_col].dataType
    return rows.mapInPandas(run, "id string, fp long").select(F.col("id").cast(kind).alias("id"), "fp")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of a code word in the reflected Gray sequence: the prefix XOR of its bits."""
    r = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node's least connected node: links (node, least) that connect what (a, b) connect."""
    names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(names))
    while True:
        least = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], least)
        np.minimum.at(new, root[v], least)
        np.minimum.at(new, u, least)
        np.minimum.at(new, v, least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    own = np.arange(len(names)) != root
    return names[own], names[root[own]]


def block_masks(blocks: int) -> list[int]:
    """Masks of that many blocks that cover 64 bits."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [((1 << b) - (1 << a)) for a, b in itertools.pairwise(edges)]


def node_masks(radius: int, n: int = 0, page: int = PAGE) -> list[int]:
    """Masks of the upper nodes: of radius + k blocks every k, of which any pair within radius agrees on some; k is the
    least for which n random fingerprints make nodes of at most ``page`` members, and decides cost only."""
    for k in range(1, 9):
        masks = [functools.reduce(int.__or__, some) for some in itertools.combinations(block_masks(radius + k), k)]
        if n / 2.0 ** min(m.bit_count() for m in masks) <= page:
            break
    return masks


class Tree:
    """Groups over pages of fingerprints. Level 0 is the fingerprints themselves; a group of a level holds up to FAN
    neighbours of the level below, all of one page; at the top a page is one group."""

    def __init__(self, fp: np.ndarray, sizes: np.ndarray):
        self.lo, self.hi, self.sizes = [fp], [fp], [sizes.astype(np.int64)]
        while self.sizes[-1].max(initial=0) > 1:
            below = self.sizes[-1]
            own = -(-below // FAN)
            first = np.repeat(np.cumsum(below) - below, own) + FAN * (np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own))
            self.lo.append(np.bitwise_and.reduceat(self.lo[-1], first))
            self.hi.append(np.bitwise_or.reduceat(self.hi[-1], first))
            self.sizes.append(own)
        self.start = [np.cumsum(x) - x for x in self.sizes]
        self.page = [np.repeat(np.arange(len(x)), x) for x in self.sizes]

    def children(self, level: int, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(groups of the level below, whether there), FAN for each."""
        p = self.page[level][group]
        local = (group - self.start[level][p])[:, None] * FAN + np.arange(FAN)
        return self.start[level - 1][p][:, None] + local, local < self.sizes[level - 1][p][:, None]

    def members(self, level: int, group: int) -> np.ndarray:
        p = self.page[level][group]
        a = (group - self.start[level][p]) * FAN**level
        return self.start[0][p] + np.arange(a, min(a + FAN**level, self.sizes[0][p]))


def _bits(x: np.ndarray) -> np.ndarray:
    """Set bits of each word, or of each row of words."""
    return np.bitwise_count(x) if x.ndim == 1 else np.bitwise_count(x).sum(axis=1)


def tree_links(fp: np.ndarray, sizes: np.ndarray, first: np.ndarray, second: np.ndarray, radius: int, stats: dict | None = None, names: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) of signed fingerprints that connect what pairs within radius connect, between the pages first[k] and
    second[k] (the same page: within it). fp is laid out page after page, each by Gray rank. stats counts pairs of groups
    pruned and linked whole, and pairs of fingerprints compared. fp may have several words a row; names then stand for the
    rows in links."""
    u = fp.astype(np.uint64)
    names = u if names is None else names
    tree = Tree(u, sizes)
    top = len(tree.sizes) - 1
    todo = [(top, tree.start[top][first], tree.start[top][second])]
    out_a: list[np.ndarray] = []
    out_b: list[np.ndarray] = []
    held = 0
    count = stats if stats is not None else {}
    while todo:
        level, i, j = todo.pop()
        if len(i) > AT_ONCE:
            todo.append((level, i[AT_ONCE:], j[AT_ONCE:]))
            i, j = i[:AT_ONCE], j[:AT_ONCE]
        lo, hi = tree.lo[level], tree.hi[level]
        # accumulated differences of the whole groups
        sure = u[i] ^ u[j] if level == 0 else (lo[i] & ~hi[j]) | (~hi[i] & lo[j])
        near = _bits(sure) <= radius
        if level == 0:
            count["compared"] = count.get("compared", 0) + len(i)
            near &= i != j
            a, b = names[i[near]], names[j[near]]
        else:
            count["pruned"] = count.get("pruned", 0) + int((~near).sum())
            i, j = i[near], j[near]
            whole = _bits((hi[i] | hi[j]) & ~(lo[i] & lo[j])) <= radius
            a, b = [names[:0]], [names[:0]]
            for p, q in zip(i[whole], j[whole]):  # every member is within radius of every other: link them in a line
                x, y = tree.members(level, p), tree.members(level, q)
                a += [names[x], names[y]]
                b += [np.full(len(x), names[y[0]]), np.full(len(y), names[x[0]])]
            a, b = np.concatenate(a), np.concatenate(b)
            count["whole"] = count.get("whole", 0) + int(whole.sum())
            i, j = i[~whole], j[~whole]
            (ci, oki), (cj, okj) = tree.children(level, i), tree.children(level, j)
            ok = oki[:, :, None] & okj[:, None, :] & ((i != j)[:, None, None] | np.triu(np.ones((FAN, FAN), bool)))
            r, s, t = np.nonzero(ok)
            if len(r):
                todo.append((level - 1, ci[r, s], cj[r, t]))
        keep = a != b
        if keep.any():
            out_a.append(a[keep].astype(np.int64))
            out_b.append(b[keep].astype(np.int64))
            held += int(keep.sum())
        if held > AT_ONCE:  # a dense group's links shrink to a forest
            x, y = _forest(np.concatenate(out_a), np.concatenate(out_b))
            out_a, out_b, held = [x], [y], 0
    if not out_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return _forest(np.concatenate(out_a), np.concatenate(out_b))


LINKED = "a long, b long, node long, page long, members array<long>"


def _unpacked(members: list, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, names) of pages of members; a member is its fingerprint, or ``words`` words and a name."""
    x = np.concatenate(members).astype(np.int64)
    return (x.reshape(-1, words + 1)[:, :words], x.reshape(-1, words + 1)[:, words]) if words else (x, x)


def _pages(radius: int, page: int, words: int = 0):
    """mapInPandas over rows (node, fp) sorted by node and Gray rank: cuts pages and gives the links within each, as
    (a, b), and the pages of nodes that may have several, as (and, or, node, page, members). Pages are numbered in order
    within the task, the task's number above; a task holds a batch and a page at a time. With words, rows are
    (node, f0, f1 ..., s), and the heads of pages are arrays (lo, hi)."""

    def read(pdf: pd.DataFrame) -> np.ndarray:
        return np.stack([pdf[c].to_numpy() for c in [f"f{k}" for k in range(words)] + ["s"]], axis=1) if words else pdf["fp"].to_numpy()

    def links(fp: np.ndarray, sizes: np.ndarray, every: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tree_links(fp[:, :words], sizes, every, every, radius, names=fp[:, words]) if words else tree_links(fp, sizes, every, every, radius)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        node, fp = np.empty(0, np.int64), np.empty((0, words + 1) if words else 0, np.int64)
        first_node = None  # of the task, which may go on from the task before, as the last may go on in the next
        given = None  # the node of which pages were given before
        for pdf in itertools.chain(batches, [None]):
            if pdf is not None:
                node, fp = np.r_[node, pdf["node"].to_numpy()], np.concatenate([fp, read(pdf)])
            if not len(node):
                continue
            first_node = node[0] if first_node is None else first_node
            begin = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            size = np.diff(np.r_[begin, len(node)])
            pages = -(-size // page)
            start = np.repeat(begin, pages) + page * (np.arange(pages.sum()) - np.repeat(np.cumsum(pages) - pages, pages))
            ends = np.r_[start[1:], len(node)]
            several = np.repeat(pages > 1, pages) | np.isin(node[start], [x for x in (first_node, given, node[-1]) if x is not None])
            if pdf is not None:  # the last page may grow
                rest, start, ends, several = start[-1], start[:-1], ends[:-1], several[:-1]
            else:
                rest = len(node)
            if len(start):
                sizes = ends - start
                every = np.flatnonzero(sizes > 1)
                a, b = links(fp[:rest], sizes, every)
                if len(a):
                    found = {"a": a, "b": b} | ({"lo": None, "hi": None} if words else {})
                    yield pd.DataFrame(found | {"node": None, "page": None, "members": None}).astype({"node": "Int64", "page": "Int64"})
                own = np.flatnonzero(several)
                if len(own):
                    parts = [fp[start[k] : ends[k]] for k in own]
                    low, high = [np.bitwise_and.reduce(x) for x in parts], [np.bitwise_or.reduce(x) for x in parts]
                    none = pd.array([None] * len(own), "Int64")
                    heads = {"a": none, "b": none, "lo": pd.Series([x[:words] for x in low], dtype=object), "hi": pd.Series([x[:words] for x in high], dtype=object)} if words else {"a": low, "b": high}
                    yield pd.DataFrame(heads | {
                        "node": pd.array(node[start[own]], "Int64"),
                        "page": pd.array(number + own, "Int64"), "members": pd.Series([x.ravel() for x in parts], dtype=object)})
                number += len(start)
                given = node[start[-1]]
            node, fp = node[rest:], fp[rest:]

    return run


def _between(radius: int, words: int = 0):
    """mapInPandas over rows (x, y), the members of two pages: the links between them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for x, y in zip(pdf["x"], pdf["y"]):
                fp, names = _unpacked([x, y], words)
                n = len(x) // (words + 1)
                a, b = tree_links(fp, np.array([n, len(fp) - n]), np.array([0]), np.array([1]), radius, names=names if words else None)
                if len(a):
                    yield pd.DataFrame({"a": a, "b": b})

    return run


def page_pairs(heads: DataFrame, radius: int, scratch: Scratch, words: int = 0) -> DataFrame:
    """(node, p, q): pairs of pages, p < q, of one node that may hold a link. heads: (node, page, lo, hi), or lo0, lo1 ... with words.

    Pages are gathered into groups of neighbours until a node has PAGE_FAN of them at most; the groups' pairs are pruned
    and opened level by level, by equi-joins on the groups' numbers."""

    each = [str(k) for k in range(words)] or [""]

    def near(a: str, b: str):
        return F.expr(" + ".join(f"bit_count(({a}lo{k} & ~{b}hi{k}) | (~{a}hi{k} & {b}lo{k}))" for k in each) + f" <= {radius}")

    def side(df: DataFrame, x: str) -> DataFrame:
        return df.select(F.col("node").alias(f"{x}node"), F.col("page").alias(x), *[F.col(c + k).alias(f"{x}{c}{k}") for k in each for c in ("lo", "hi")])

    levels, shift = [heads], PAGE_FAN.bit_length() - 1
    while (levels[-1].groupBy("node").count().agg(F.max("count")).first()[0] or 0) > PAGE_FAN:
        up = levels[-1].groupBy("node", F.shiftright("page", shift).alias("page")).agg(*[f(c + k).alias(c + k) for k in each for f, c in ((F.bit_and, "lo"), (F.bit_or, "hi"))])
        levels.append(scratch.save(up, "groups"))
    pairs = side(levels[-1], "p").join(side(levels[-1], "q"), (F.col("pnode") == F.col("qnode")) & (F.col("p") <= F.col("q")) & near("p", "q"))
    pairs = pairs.select(F.col("pnode").alias("node"), "p", "q")
    for below in reversed(levels[:-1]):
        pairs = scratch.save(pairs.select("node", F.col("p").alias("up"), F.col("q").alias("uq")), "pairs")
        for x in "pq":
            own = side(below, x).withColumn(f"{x}up", F.shiftright(x, shift))
            pairs = pairs.join(own, (F.col("node") == F.col(f"{x}node")) & (F.col(f"u{x}") == F.col(f"{x}up"))).drop(f"{x}node", f"{x}up")
        pairs = pairs.where((F.col("p") <= F.col("q")) & near("p", "q")).select("node", "p", "q")
    return pairs.where("p < q")


def links_of(fps: DataFrame, scratch: Scratch, radius: int = 4, page: int = PAGE) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (column fp) which chains of steps within radius connect.
    page decides cost only."""
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in node_masks(radius, fps.count(), page)]
    # a node's number is a hash of its mask and pattern: equal patterns meet, and a chance meeting is only compared
    node = F.explode(F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for k, m in enumerate(signed)]))
    rank = F.col("fp")
    for k in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, k))
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = scratch.save(fps.select("fp", rank.bitwiseXOR(F.lit(-(1 << 63)).cast("long")).alias("gray")), "gray")
    rows = rows.select(node.alias("node"), "gray", "fp").repartitionByRange(n, "node", "gray").sortWithinPartitions("node", "gray")
    found = scratch.save(rows.select("node", "fp").mapInPandas(_pages(radius, page), LINKED), "pages")
    links = found.where("node IS NULL").select("a", "b")
    pages = found.where("node IS NOT NULL")
    several = scratch.save(pages.groupBy("node").count().where("count > 1").select(F.col("node").alias("n")).coalesce(1), "several")
    if several.limit(1).count() == 0:
        return links
    heads = scratch.save(pages.join(several, F.col("node") == F.col("n"), "left_semi").select("node", "page", F.col("a").alias("lo"), F.col("b").alias("hi")), "heads")
    pairs = scratch.save(page_pairs(heads, radius, scratch), "pairs")
    for side, x in (("p", "x"), ("q", "y")):
        pairs = pairs.join(pages.select(F.col("page").alias("own"), F.col("members").alias(x)), F.col(side) == F.col("own")).drop("own")
    between = pairs.select("x", "y").repartition(n).mapInPandas(_between(radius), "a long, b long")
    return links.unionByName(scratch.save(between, "between"))


def wide_masks(n: int, words: int, apart: int, missed: float = 1e-4, small: int = 64) -> np.ndarray:
    """Masks (a row of words each) for n fingerprints of 64 * words bits: of as many seeded bits as make nodes of ``small``
    random members, ten at least, and so many that all but ``missed`` of pairs that differ in ``apart`` bits agree on one."""
    size, bits = 64 * words, max(10, math.ceil(math.log2(max(n, 1) / small)))
    agree = math.comb(size - apart, bits) / math.comb(size, bits)
    rng = np.random.default_rng(21)
    out = np.zeros((math.ceil(math.log(missed) / math.log1p(-agree)), size), np.uint8)
    for row in out:
        row[rng.choice(size, bits, replace=False)] = 1
    return np.packbits(out, axis=1).view(np.uint64)


def nodes_of(fp: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """(row, mask): the signed number of each node, a hash of the mask and the bits it leaves."""
    out = np.empty((len(fp), len(masks)), np.int64)
    for k, m in enumerate(masks):
        h = np.full(len(fp), k + 1, np.uint64)
        for word in (fp.astype(np.uint64) & m).T:
            h = (h ^ word) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out[:, k] = h.astype(np.int64)
    return out


def wide_links(rows: DataFrame, scratch: Scratch, words: int, radius: int, apart: int, page: int = PAGE) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of names that connect rows (s, sig) within radius that share a node of ``wide_masks``, sig an array of
    words, and (s, nodes). The index is that of ``links_of``, with masks of single bits and fingerprints of several words."""
    masks = wide_masks(rows.count(), words, apart)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                nodes = nodes_of(np.stack(b["sig"].tolist()), masks)
                yield pd.DataFrame({"s": b["s"].to_numpy(), "sig": b["sig"].to_numpy(), "nodes": pd.Series(list(nodes), dtype=object)})

    held = scratch.save(rows.select("s", "sig").mapInPandas(run, "s long, sig array<long>, nodes array<long>"), "nodes")
    flat = held.select(F.explode("nodes").alias("node"), *[F.col("sig")[k].alias(f"f{k}") for k in range(words)], "s")
    rank = F.col("f0")
    for k in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, k))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    flat = flat.repartitionByRange(n, "node", rank).sortWithinPartitions("node", rank)
    found = scratch.save(flat.mapInPandas(_pages(radius, page, words), "a long, b long, lo array<long>, hi array<long>, node long, page long, members array<long>"), "pages")
    links, pages = found.where("node IS NULL").select("a", "b").distinct(), found.where("node IS NOT NULL")
    several = scratch.save(pages.groupBy("node").count().where("count > 1").select(F.col("node").alias("n")).coalesce(1), "several")
    if several.limit(1).count():
        heads = pages.join(several, F.col("node") == F.col("n"), "left_semi")
        heads = heads.select("node", "page", *[F.col(c)[k].alias(f"{c}{k}") for k in range(words) for c in ("lo", "hi")])
        pairs = scratch.save(page_pairs(scratch.save(heads, "heads"), radius, scratch, words), "pairs")
        for side, x in (("p", "x"), ("q", "y")):
            pairs = pairs.join(pages.select(F.col("page").alias("own"), F.col("members").alias(x)), F.col(side) == F.col("own")).drop("own")
        between = pairs.select("x", "y").repartition(n).mapInPandas(_between(radius, words), "a long, b long")
        links = links.unionByName(scratch.save(between, "between"))
    return links, held.select("s", "nodes")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """(id, fingerprint, component_id) per row of docs: SimHash near-duplicate groups.

    Words are lower-cased (A-Z) runs of non-space characters; the fingerprint is the bitwise majority of the XXH64
    (seed 42) of its 4-word shingles, repeats counted; fewer words are one shingle, and texts without words (null,
    empty, blank) have fingerprint 0, linked like any other. Fingerprints within ``radius`` bits are linked;
    component_id is the smallest id reachable, null where a component has none but null ids. Repeated rows and
    repeated ids are rows of their own. An empty table gives an empty result.

    Plan: texts are read once and shrink to (id, fingerprint). Equal fingerprints are one node (pre-aggregated), so
    groups of exact copies cost nothing. The rows of the index are dealt out by ranges of (node, Gray rank), so that no
    node is too large for a task; each task streams its pages and emits at most a spanning forest for each.
    """
    scratch = Scratch(docs.sparkSession)
    own = scratch.save(fingerprints(docs, id_col, text_col, shingle), "fp")
    fps = scratch.save(own.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    comp = components(docs.sparkSession, scratch, links_of(fps, scratch, radius))
    rooted = fps.join(comp, fps.fp == comp.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = scratch.save(rooted, "rooted")
    least = scratch.save(rooted.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r"), "least")
    labels = scratch.save(rooted.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id"), "labels")
    return own.join(labels, F.col("fp") == F.col("f")).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """The rows of docs whose id is the smallest of their group in ``simhash_groups``, all columns unchanged.

    Rows without an id cannot be named by a group and stay. Where an id repeats, one of its rows stays: repeated rows
    are equal, and of different rows with one id the choice is the engine's. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    groups = simhash_groups(docs, id_col, text_col, shingle, radius)
    k_id, k_n = fresh(docs, "id", "n")
    kept = groups.where(F.col(id_col) == F.col("component_id")).groupBy(F.col(id_col).alias(k_id)).agg(F.count("*").alias(k_n))
    kept = scratch.save(kept, "kept")
    # both sides grow with the corpus: sorted and merged at every size
    rows = docs.join(kept.hint("merge"), F.col(id_col) == F.col(k_id), "left").where(F.col(id_col).isNull() | F.col(k_id).isNotNull())
    if kept.where(F.col(k_n) > 1).limit(1).count():  # only then are rows of one id to be told apart
        rows = rows.where(F.col(id_col).isNull()).unionByName(rows.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])

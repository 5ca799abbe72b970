"""Near copies at a similarity: SimHash and its Gray-order index choose pairs, exact shingle sets decide them.

A set of shingles has a SimHash of WORDS words of 64 bits. Two sets of Jaccard similarity 0.8 differ in about 38 of 256
bits, with a deviation of 6. The index of ``simhash`` holds each fingerprint under masked bit patterns (``wide_masks``:
so many that 0.9999 of pairs APART bits away share one), in Gray order, cut into pages and groups; its descent connects
fingerprints within RADIUS bits. What it connects is a group. A group's sets are compared with one of them in each of
STARS rounds: first with its most central one, whose fingerprint is the nearest to the bitwise majority of the group's,
then with the most central of those that are not connected with an earlier one. This joins large groups of copies in as
many comparisons as they have members; choosing a centre is one sum and one join of a row for each member. Before sets
are fetched, a pair is compared by its fingerprints.

What is not connected by then is paired within groups of up to SMALL sets directly, and within larger ones by its
differences from a central set p. The symmetric difference of a and b is that of their differences d(a) = a ^ p and
d(b) = b ^ p, so what two sets share with p plays no part, and similar sets far from p must share much of their
differences. With rare shingles first, the first one that d(a) and d(b) share stands early in both; only these early
shingles are joined, with a condition on their places. This loses no pair, whichever set is p.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, fresh, text_of
from .simhash import wide_links

SHINGLE, SIMILARITY = 5, 0.8
#: Words of a fingerprint, bits by which masks are counted, and bits that a pair may differ in. Sets of 5 and 4 shingles
#: differ the most at similarity 0.8, in 48 bits with a deviation of 6; RADIUS is almost four deviations from there, five from others.
WORDS, APART, RADIUS = 4, 45, 70
#: Bands of minima, and minima of a band.
BANDS, ROWS = 20, 5
#: Rounds of one member, and the largest group whose sets are paired directly (which decides cost only).
STARS, SMALL = 3, 16
#: Tables of row keys up to this many rows are broadcast; larger ones are joined with a shuffle of the texts.
BROADCAST_KEYS = 500_000


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 hashes (seed 42, signed) of a text's shingles; fewer words are one shingle, none give none."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.int64)
    line = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    start, k = np.r_[0, end[:-1]], min(shingle, len(words))
    ends = (end[k - 1 :] - 1).tolist()
    return np.unique(np.array([xxh64_intdigest(line[a:b], 42) for a, b in zip(start[: len(ends)].tolist(), ends)], np.uint64).view(np.int64))


def simhash_of(h: np.ndarray) -> np.ndarray:
    """Signed words of the bitwise majority of a set of hashes, each word over its own mixing of them."""
    total = np.zeros(64 * WORDS, np.int64)
    for i in range(0, len(h), 8192):
        x = h[i : i + 8192, None].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.arange(WORDS, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        total += np.unpackbits(x.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(h)).view(np.int64)


def name_of(h: np.ndarray) -> int:
    """A signed name of a set of hashes: equal sets have equal names."""
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(h.tobytes(), 7)).astype(np.int64))


def bits_apart(a: str, b: str) -> Column:
    """How many bits of two columns of words differ."""
    return F.expr(" + ".join(f"bit_count({a}[{k}] ^ {b}[{k}])" for k in range(WORDS)))


def majorities(members: DataFrame) -> DataFrame:
    """(mg, m): of each group g of members (g, sig) the bitwise majority of their words, from sums that each task begins."""
    bits = [(k, j) for k in range(WORDS) for j in range(64)]
    sums = members.groupBy(F.col("g").alias("mg")).agg(F.count("*").alias("of"), *[F.expr(f"sum(shiftrightunsigned(sig[{k}], {j}) & 1L) AS b{k}_{j}") for k, j in bits])

    def word(k: int) -> str:
        return " + ".join(f"shiftleft(CAST(2 * b{k}_{j} > of AS BIGINT), {j})" for j in range(64))

    return sums.select("mg", F.expr(f"array({', '.join(map(word, range(WORDS)))})").alias("m"))


# --- minima of sets, which choose no pairs here: another sketch of similarity, held by tests


def minima(h: np.ndarray) -> np.ndarray:
    """The least values of a set under BANDS * ROWS orders. Each order is that of h xor a word, times an odd word."""
    rng = np.random.default_rng(20)
    turn, odd = rng.integers(0, 1 << 63, (2, BANDS * ROWS, 1)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 4096):
        x = (h[i : i + 4096].view(np.uint64) ^ turn) * odd
        least = np.minimum(least, (x ^ (x >> np.uint64(31))).min(axis=1))
    return least


def bands_of(h: np.ndarray, least: np.ndarray | None = None) -> np.ndarray:
    """The signed names of a set's bands; none for an empty set."""
    from xxhash import xxh64_intdigest

    if not len(h):
        return np.empty(0, np.int64)
    least = minima(h) if least is None else least
    names = [xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(names, np.uint64).view(np.int64)


def bytes_of(least: np.ndarray) -> np.ndarray:
    """A byte of each minimum, eight in a signed word."""
    out = np.zeros(-(-len(least) // 8) * 8, np.uint8)
    out[: len(least)] = least.astype(np.uint8)
    return out.view(np.int64)


def differing(a: str, b: str) -> Column:
    """How many bytes of two columns of words differ: a byte's bits are folded into its lowest."""

    def word(k: int) -> str:
        x = f"({a}[{k}] ^ {b}[{k}])"
        for shift in (4, 2, 1):
            x = f"({x} | shiftrightunsigned({x}, {shift}))"
        return f"bit_count({x} & {0x0101010101010101}L)"

    return F.expr(" + ".join(map(word, range(-(-BANDS * ROWS // 8)))))


def _sets(rows: DataFrame, shingle: int) -> DataFrame:
    """(s, h): the name and the set of each text of rows (column text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingle_set(t, shingle) for t in b["text"]]
            yield pd.DataFrame({"s": np.array([name_of(h) for h in sets], np.int64), "h": pd.Series(sets, dtype=object)})

    return rows.select("text").mapInPandas(run, "s long, h array<long>")


def similar_groups(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(id, th, s) per row of docs, th the hash of the text and s the name of its set; and (node, root) for every name
    that is linked: texts whose shingle sets have a Jaccard similarity of at least ``similarity``, and chains of them."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.xxhash64(text_of(text_col)).alias("th"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingle_set(t, shingle) for t in b["text"]]
            yield pd.DataFrame({
                "id": b["id"], "th": b["th"], "s": np.array([name_of(h) for h in sets], np.int64), "n": np.array([len(h) for h in sets], np.int32),
                "sig": pd.Series([simhash_of(h) for h in sets], dtype=object, index=b.index)}, index=b.index)

    own = scratch.save(rows.mapInPandas(run, "id string, th long, s long, n int, sig array<long>"), "own")
    # equal sets are one node, known by one of its texts
    meta = own.groupBy("s").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.min(F.struct("id", "th")).alias("k"))
    meta = scratch.save(meta.select("s", "n", "sig", F.col("k.id").alias("i"), F.col("k.th").alias("t")), "meta")
    near_links, _ = wide_links(meta.where("n > 0"), scratch, WORDS, RADIUS, APART)
    shared = components(spark, scratch, near_links).select(F.col("root").alias("g"), F.col("node").alias("s"))

    def side(x: str) -> DataFrame:
        return meta.select(*[F.col(c).alias(c + x) for c in ("s", "n", "sig")])

    near = F.least("na", "nb") >= F.greatest("na", "nb") * similarity - 1e-9
    near &= bits_apart("siga", "sigb") <= RADIUS

    def fetched(names: DataFrame) -> DataFrame:
        """(s, h): the sets of these names (column w), each once."""
        one = scratch.save(meta.join(names, F.col("s") == F.col("w"), "left_semi").select("i", F.col("t").alias("one")), "texts")
        wanted = rows.join(F.broadcast(one) if one.count() <= BROADCAST_KEYS else one, F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("one")), "left_semi")
        sets = scratch.save(_sets(wanted, shingle), "sets")
        if sets.groupBy("s").count().where("count > 1").limit(1).count():  # rows equal in id and text
            sets = sets.dropDuplicates(["s"])
        return sets

    def linked(pairs: DataFrame) -> DataFrame:
        """Those of pairs (sa, sb) whose sets are similar."""
        names = scratch.save(pairs.select(F.explode(F.array("sa", "sb")).alias("w")).distinct(), "wanted")
        sets = fetched(names)
        full = pairs.join(sets.select(F.col("s").alias("sa"), F.col("h").alias("ha")), "sa").join(sets.select(F.col("s").alias("sb"), F.col("h").alias("hb")), "sb")
        full = full.withColumn("both", F.size(F.array_intersect("ha", "hb")))
        same = F.col("both") >= (F.size("ha") + F.size("hb") - F.col("both")) * similarity - 1e-9
        out = scratch.save(full.where(same).select(F.col("sa").alias("a"), F.col("sb").alias("b")), "links")
        scratch.drop(sets, names)
        return out

    def rooted_now(comp: DataFrame | None) -> DataFrame:
        """(g, s, sig, r): r names what s is connected with; sig is null in groups of up to SMALL."""
        if comp is None:
            return shared.withColumn("r", F.col("s"))
        return shared.join(comp, F.col("s") == F.col("node"), "left").select("g", "s", "sig", F.coalesce("root", "s").alias("r"))

    def unlike(x: str, y: str) -> Column:
        """The most shingles in which similar sets of these sizes can differ."""
        return (F.col(x) + F.col(y)) * ((1 - similarity) / (1 + similarity)) + 1e-6

    def by_differences(members: DataFrame) -> DataFrame:
        """Pairs (sa, sb) of sets of members (s, r, p) with one p and different r: all that are similar, and few others."""
        names = scratch.save(members.select(F.explode(F.array("s", "p")).alias("w")).distinct(), "wanted")
        sets = fetched(names)
        both = members.join(sets.select("s", "h"), "s").join(sets.select(F.col("s").alias("p"), F.col("h").alias("hp")), "p")
        d = F.concat(F.array_except("h", "hp"), F.array_except("hp", "h"))
        both = both.select("p", "s", "r", F.size("h").alias("n"), F.size("hp").alias("np"), d.alias("d")).withColumn("nd", F.size("d"))
        alike = F.col("nd") <= unlike("n", "np")
        # a set similar to p only seeks those that are not, which differ from p in more than unlike(their size, p's)
        early = F.when(alike, F.col("nd") / 2 - (F.col("np") - F.col("n")) * ((1 - similarity) / (1 + similarity)) / 2).otherwise(F.col("n") * ((1 - similarity) / similarity))
        early = F.least("nd", F.greatest(F.lit(0), F.floor(early + 1 + 1e-6).cast("int")))
        heads = scratch.save(both.select("p", "s", "r", "n", "nd", alike.alias("alike"), early.alias("early"), "d"), "heads")
        scratch.drop(sets, names)
        # the order is by frequency: shingles that no other difference holds come first, and need no row
        each = heads.select("p", "s", "r", "n", "nd", "early", F.explode("d").alias("x"))
        shared_x = scratch.save(each.groupBy(F.col("p").alias("p0"), F.col("x").alias("x0")).agg(F.count("*").alias("c")).where("c > 1"), "frequent")
        known = each.join(shared_x, (F.col("p") == F.col("p0")) & (F.col("x") == F.col("x0")))
        known = known.groupBy("p", "s", "r", "n", "nd", "early").agg(F.array_sort(F.collect_list(F.struct("c", "x"))).alias("d"))
        known = known.withColumn("alone", F.col("nd") - F.size("d")).where("early > alone")
        places = known.select("p", "s", "r", "n", "nd", "alone", F.posexplode(F.expr("slice(d, 1, early - alone)")).alias("at", "e"))
        places = scratch.save(places.select("p", "s", "r", "n", "nd", (F.col("alone") + F.col("at")).alias("at"), F.col("e.x").alias("x")), "places")
        a, b = (places.select("p", "x", *[F.col(c).alias(c + y) for c in ("s", "r", "n", "nd", "at")]) for y in "ab")
        found = (F.col("sa") < F.col("sb")) & (F.col("ra") != F.col("rb"))
        found &= 2 * F.least(F.col("nda") - F.col("ata"), F.col("ndb") - F.col("atb")) >= F.col("nda") + F.col("ndb") - unlike("na", "nb")
        pairs = a.join(b, ["p", "x"]).where(found).select("sa", "sb")
        # a set similar to p that was not compared with it
        direct = heads.where("alike and s <> p").join(heads.where("s = p").select(F.col("p").alias("p0"), F.col("r").alias("r0")), F.col("p") == F.col("p0"))
        direct = direct.where("r <> r0").select(F.least("s", "p").alias("sa"), F.greatest("s", "p").alias("sb"))
        return pairs.unionByName(direct).distinct()

    sizes = shared.groupBy("g").agg(F.count("*").alias("size"))
    sizes = scratch.save(sizes, "sizes")
    shared = shared.join(sizes, "g").join(meta.select("s", "sig"), "s").select("g", "s", F.when(F.col("size") > SMALL, F.col("sig")).alias("sig"))
    shared = scratch.save(shared, "shared")
    links = comp = tried = centres = first = None

    def most_central(rest: DataFrame) -> DataFrame:
        """(g, s, pr): of each group of rest (g, s, sig, r) the member nearest to their majority, and its r; without sig any."""
        middle = scratch.save(majorities(rest.where("sig IS NOT NULL")), "middle")
        w = F.coalesce(-bits_apart("sig", "m"), F.lit(0))
        near_middle = rest.join(middle, F.col("g") == F.col("mg"), "left").groupBy("g").agg(F.max(F.struct(w.alias("w"), "s", "r")).alias("p"))
        return scratch.save(near_middle.select("g", F.col("p.s").alias("s"), F.col("p.r").alias("pr")), "open")

    def step(pairs: DataFrame) -> None:
        """Compares those of pairs that were not compared yet."""
        nonlocal links, comp, tried
        pairs = scratch.save(pairs if tried is None else pairs.join(tried, ["sa", "sb"], "left_anti"), "compared")
        if pairs.limit(1).count():
            tried = pairs if tried is None else tried.unionByName(pairs)
            new = linked(pairs)
            links = new if links is None else links.unionByName(new)
            comp = components(spark, scratch, links)

    for _ in range(STARS):
        members = scratch.save(rooted_now(comp), "rooted")
        rest = members
        if centres is not None:  # those not connected with an earlier centre of the group
            old = centres.join(members.select("g", "s", "r"), ["g", "s"]).groupBy(F.col("g").alias("og")).agg(F.collect_set("r").alias("roots"))
            rest = scratch.save(members.join(old, F.col("g") == F.col("og")).where(~F.array_contains("roots", F.col("r"))).select(members.columns), "rest")
        open_ = most_central(rest)
        new = open_.select("g", "s")
        first, centres = (new, new) if centres is None else (first, centres.unionByName(new))
        pairs = members.select("g", "s", "r").join(open_.select("g", F.col("s").alias("p"), "pr"), "g").where("r <> pr")
        pairs = pairs.select(F.least("s", "p").alias("sa"), F.greatest("s", "p").alias("sb")).distinct()
        step(pairs.join(side("a"), "sa").join(side("b"), "sb").where(near).select("sa", "sb"))
        scratch.drop(members)
    rooted = scratch.save(rooted_now(comp), "rooted")
    open_ = rooted.groupBy("g").agg(F.min("r").alias("r1"), F.max("r").alias("r2"), F.count("*").alias("size"))
    open_ = scratch.save(open_.where("r1 < r2").select(F.col("g").alias("og"), "size"), "open")
    left = rooted.join(open_, F.col("g") == F.col("og"))
    few = scratch.save(left.where(F.col("size") <= SMALL).select("g", "s", "r").join(meta.select("s", "n", "sig"), "s"), "left")
    a, b = (few.select("g", *[F.col(c).alias(c + x) for c in ("s", "r", "n", "sig")]) for x in "ab")
    pairs = a.join(b, "g").where((F.col("sa") < F.col("sb")) & (F.col("ra") != F.col("rb")) & near).select("sa", "sb")
    # a group's p is its first centre
    chosen = first.select(F.col("g").alias("pg"), F.col("s").alias("p"))
    many = scratch.save(left.where(F.col("size") > SMALL).join(chosen, F.col("g") == F.col("pg")).select("s", "r", "p"), "many")
    if many.limit(1).count():
        pairs = pairs.unionByName(by_differences(many))
    step(pairs.distinct())
    if comp is None:
        comp = own.select(F.col("s").alias("node"), F.col("s").alias("root")).where(F.lit(False))
    scratch.drop(shared)
    kind = docs.schema[id_col].dataType
    return own.select(F.col("id").cast(kind).alias("id"), "th", "s"), comp


def keep_one_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of docs for each group of ``similar_groups``, all columns unchanged: that of the least id, null ids last;
    of different texts with this id, that of the least text hash.

    A row is known by its id and text, so a text that resembles no other stays whatever ids repeat or are null. Texts
    without words (null, empty, blank) are one group. Of rows equal in id and text one stays, the engine's choice. Texts
    are compared whole. Extra columns play no part. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    own, comp = similar_groups(docs, scratch, id_col, text_col, shingle, similarity)
    rooted = own.join(comp, F.col("s") == F.col("node"), "left").select("id", "th", F.coalesce("root", "s").alias("root"))
    rooted = scratch.save(rooted.groupBy("id", "th", "root").agg(F.count("*").alias("rows")), "rooted")
    least = rooted.groupBy(F.col("root").alias("of")).agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("k"), F.max(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("e"))
    k_id, k_th, th = fresh(docs, "kid", "kth", "rth")
    least = scratch.save(least.where("k <> e").select("of", "k"), "least")  # groups of more than one text
    gone = rooted.join(least, F.col("root") == F.col("of")).where(~(F.col("id").eqNullSafe(F.col("k.id")) & (F.col("th") == F.col("k.th"))))
    gone = scratch.save(gone.select(F.col("id").alias(k_id), F.col("th").alias(k_th)), "gone")
    match = F.col(id_col).eqNullSafe(F.col(k_id)) & (F.col(th) == F.col(k_th))
    rows = docs.withColumn(th, F.xxhash64(text_of(text_col)))
    rows = rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone.hint("merge"), match, "left_anti")
    if rooted.where("rows > 1").limit(1).count():  # rows equal in id and text
        rows = rows.dropDuplicates([id_col, th])
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])

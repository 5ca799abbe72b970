"""Benchmark decontamination in DataFrame functions: SimHash of item-sized windows, multi-index Hamming blocks, and
exact weighted-shingle similarity.

Windows of the items' numbers of words are placed in the documents wherever a shingle occurs that some item has, at the
start which the shingle's place in an item of that size implies; a window without any such shingle has similarity 0
with every item. A window's SimHash then finds the items: the 64 bits are cut into BLOCKS blocks, of which one has at
most ERRORS differing bits for any two fingerprints within RADIUS, so items are filed under (size, block, bits) for all
bits within ERRORS of theirs, and an equi-join on these keys gives all items of the window's size within RADIUS. What
it gives is verified by the weighted Jaccard similarity of the shingles.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RUN, Scratch, fresh, text_of

PUNCTUATION = ".,;:!?\"'()[]{}"
PUNCTUATION_RUN = r"[.,;:!?\"'()\[\]{}]+"
SHINGLE = 5
#: At similarity 0.8 (an overlap of 8/9) about 10 of 64 bits differ, with a deviation of 3: one pair in ten thousand
#: lies beyond, and fewer at higher similarities.
RADIUS = 20
#: Blocks of the fingerprint, and the bits that may differ in one of them: BLOCKS * (ERRORS + 1) > RADIUS.
BLOCKS, ERRORS = 7, 2
#: Tables made from a benchmark up to this many rows are broadcast; larger ones are joined with a shuffle.
BROADCAST_SHINGLES = 2_000_000


def plain_words(col: str) -> Column:
    """Words lower-cased, without punctuation."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(text_of(col)), PUNCTUATION_RUN, ""), SPACE_RUN), "")


def shingle_at(words: str, place: Column, size: int) -> Column:
    """Hash of the words from a place on."""
    return F.xxhash64(*[F.col(words)[place + k] for k in range(size)])


def shingles(words: str, size: int = SHINGLE) -> Column:
    """Hashes of the shingles of a column of words, in order; empty below size words."""
    h = F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: shingle_at(words, i, size))
    return F.when(F.size(words) >= size, h).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: str) -> Column:
    """Bitwise majority of a column of hashes. Two bits of each hash are counted at a time, in the halves of a long."""
    return F.expr(f"""
        aggregate(
          transform(sequence(0, 31), b -> named_struct('b', b, 'c',
            aggregate({hashes}, 0L, (s, h) -> s + (shiftrightunsigned(h, b) & 4294967297L)))),
          0L,
          (f, x) -> f | if(2 * (x.c & 4294967295L) > size({hashes}), shiftleft(1L, x.b), 0L)
                      | if(2 * shiftrightunsigned(x.c, 32) > size({hashes}), shiftleft(1L, x.b + 32), 0L))""")


def block_edges(blocks: int = BLOCKS) -> list[int]:
    return [round(64 * i / blocks) for i in range(blocks + 1)]


def block_bits(fp: str, b: int) -> str:
    """SQL for the bits of a block, as a small number."""
    low, high = block_edges()[b : b + 2]
    return f"(shiftrightunsigned({fp}, {low}) & {(1 << (high - low)) - 1}L)"


def block_key(size: str, b: int, bits: str) -> str:
    """SQL for one long for (size, block, bits); a block has up to 10 bits, and there are up to 16 blocks."""
    return f"((cast({size} AS bigint) * 16 + {b}) * 1024 + {bits})"


def flips(width: int, errors: int = ERRORS) -> list[int]:
    """Masks of up to that many bits among width."""
    return [sum(1 << k for k in some) for n in range(errors + 1) for some in itertools.combinations(range(width), n)]


def own_keys(fp: str, size: str) -> Column:
    """(b, key) of each block of a fingerprint."""
    parts = [f"named_struct('b', {b}, 'key', {block_key(size, b, block_bits(fp, b))})" for b in range(BLOCKS)]
    return F.expr(f"array({', '.join(parts)})")


def near_keys(fp: str, size: str) -> Column:
    """The keys of all bits within ERRORS of each block's."""
    parts = []
    for b, (low, high) in enumerate(itertools.pairwise(block_edges())):
        masks = ", ".join(f"{m}L" for m in flips(high - low))
        parts.append(f"transform(array({masks}), m -> {block_key(size, b, f'({block_bits(fp, b)} ^ m)')})")
    return F.expr(f"concat({', '.join(parts)})")


def first_block(a: str, b: str) -> Column:
    """The first block with at most ERRORS differing bits: a pair that meets in several is taken in this one."""
    parts = [f"WHEN bit_count({block_bits(f'({a} ^ {b})', k)}) <= {ERRORS} THEN {k}" for k in range(BLOCKS)]
    return F.expr(f"CASE {' '.join(parts)} ELSE {BLOCKS} END")


def overlap(a: str, b: str) -> Column:
    """Size of the intersection of two multisets."""
    return F.expr(f"""
        if(size(array_distinct({a})) = size({a}) or size(array_distinct({b})) = size({b}),
           size(array_intersect({a}, {b})),
           aggregate(array_intersect({a}, {b}), 0,
             (s, x) -> s + least(size(filter({a}, y -> y = x)), size(filter({b}, y -> y = x)))))""")


def contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text: str = "text", similarity: float = 0.8, scratch: Scratch | None = None) -> DataFrame:
    """(id, item, start, n_words, similarity): for every document and item with a matching window, the best window.

    A window matches if the weighted Jaccard similarity of its 5-word shingles and the item's (shingles weigh as often
    as they occur: sum of least counts by sum of greatest) is at least ``similarity``. Words are lower-cased and lose
    punctuation. start is the number of words before the window. Of equal windows the first is given. A document
    shorter than an item is one window. Items of fewer than 5 words are one shingle, which matches these very words in
    a row; items without words, null ones included, match nothing, as do such documents. Items of equal words are
    one, under the least item. Null ids form one document for each text. Texts are read whole. Repeated rows give one
    result. Extra columns play no part. Empty tables give an empty result.

    Plan: shingle hashes are exploded from the scan as (document, position, hash) within compiled code and meet the
    benchmark's shingles (broadcast up to BROADCAST_SHINGLES rows) at once, so only hits are shuffled. A window needs
    as many hits in its document as the similarity asks for. What is left joins the texts by document.
    """
    found = _matches(docs, bench, id_col, text_col, item_col, item_text, similarity, scratch or Scratch(docs.sparkSession))
    best = found.groupBy("id", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), "len")).alias("b"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), (-F.col("b.s")).alias("start"), F.col("b.len").alias("n_words"), F.col("b.similarity").alias("similarity"))


def benchmark_items(bench: DataFrame, item_col: str, item_text: str) -> DataFrame:
    """(item, len, size, ish, ifp): a row for each sequence of words, with its shingles of ``size`` words and SimHash."""
    items = bench.select(F.col(item_col).alias("item"), plain_words(item_text).alias("w")).where(F.size("w") > 0)
    items = items.groupBy("w").agg(F.min("item").alias("item")).withColumn("size", F.least(F.size("w"), F.lit(SHINGLE)))
    ish = F.coalesce(*[F.when(F.col("size") == k, shingles("w", k)) for k in range(1, SHINGLE + 1)])
    items = items.select("item", F.size("w").alias("len"), "size", ish.alias("ish"))
    return items.select("*", simhash("ish").alias("ifp"))


def _matches(docs: DataFrame, bench: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, similarity: float, scratch: Scratch) -> DataFrame:
    """Every matching window, by (id, th), th the hash of the text."""
    items = scratch.save(benchmark_items(bench, item_col, item_text).coalesce(1), "items")
    places = scratch.save(items.select("size", "len", F.posexplode("ish").alias("q", "g")).distinct().coalesce(1), "places")
    keys = items.select("item", "ifp", "ish", F.explode(near_keys("ifp", "len")).alias("ikey"))
    small = places.count() <= BROADCAST_SHINGLES and items.count() * sum(len(flips(b - a)) for a, b in itertools.pairwise(block_edges())) <= BROADCAST_SHINGLES
    hint = F.broadcast if small else (lambda df: df)
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # SHINGLE numbers at most

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("th"), text_of(text_col).alias("text"))
    words = rows.select("id", "th", plain_words("text").alias("w"))
    parts = []
    for k in sizes:
        at = F.explode_outer(F.when(F.size("w") >= k, F.sequence(F.lit(0), F.size("w") - k)))
        hits = words.select("id", "th", "w", at.alias("p")).where(F.col("p").isNotNull())
        hits = hits.select("id", "th", F.size("w").alias("n"), "p", shingle_at("w", F.col("p"), k).alias("h"))
        hits = hits.join(hint(places.where(F.col("size") == k)), F.col("h") == F.col("g"))
        start = F.greatest(F.lit(0), F.least(F.col("p") - F.col("q"), F.col("n") - F.col("len")))
        # overlap >= t / (1 + t) * (shingles of the window + shingles of the item), and every shared shingle is a hit
        both = F.least("n", "len") - (k - 1) + F.col("len") - (k - 1)
        need = F.ceil(both * (similarity / (1 + similarity)) - 1e-6).cast("int")
        parts.append(hits.select("id", "th", F.lit(k).alias("size"), "p", F.struct("len", start.alias("start"), need.alias("need")).alias("x")))
    if not parts:
        return items.join(rows, F.lit(False)).select("id", "th", "item", "len", F.lit(0).alias("start"), F.lit(0.0).alias("similarity"))
    wanted = parts[0]
    for p in parts[1:]:
        wanted = wanted.unionByName(p)
    wanted = wanted.groupBy(F.col("id").alias("wid"), F.col("th").alias("wth"), "size").agg(F.collect_set("x").alias("win"), F.size(F.collect_set("p")).alias("hits"))
    wanted = wanted.select("wid", "wth", "size", F.expr("filter(win, x -> x.need <= hits)").alias("win")).where(F.size("win") > 0)
    wanted = scratch.save(wanted, "wanted")  # one document's windows in a row

    again = rows.join(wanted, F.col("id").eqNullSafe(F.col("wid")) & (F.col("th") == F.col("wth")))
    again = again.select("id", "th", "size", "win", plain_words("text").alias("w"))
    sh = F.coalesce(*[F.when(F.col("size") == k, shingles("w", k)) for k in sizes])
    again = again.select("id", "th", "size", sh.alias("sh"), F.explode("win").alias("x"))
    window = F.slice("sh", F.col("x.start") + 1, F.greatest(F.col("x.len") - F.col("size") + 1, F.lit(1)))
    windows = again.select("id", "th", F.col("x.len").alias("len"), F.col("x.start").alias("start"), window.alias("wsh"))
    windows = scratch.save(windows.withColumn("wfp", simhash("wsh")), "windows")

    filed = windows.select("id", "th", "len", "start", "wsh", "wfp", F.explode(own_keys("wfp", "len")).alias("k"))
    pairs = filed.join(hint(keys), F.col("k.key") == F.col("ikey"))
    differ = F.col("wfp").bitwiseXOR(F.col("ifp"))
    near = pairs.where((F.bit_count(differ) <= RADIUS) & (first_block("wfp", "ifp") == F.col("k.b"))).withColumn("both", overlap("wsh", "ish"))
    near = near.withColumn("similarity", F.col("both") / (F.size("wsh") + F.size("ish") - F.col("both")))
    return near.where(F.col("similarity") >= similarity)


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text", similarity: float = 0.8, by_text: bool = False) -> DataFrame:
    """The rows of docs that match no benchmark item, all columns unchanged. All rows of a matching id go, and all
    rows of null id if one of them matches; with by_text only rows whose own text matches, whatever ids repeat or are
    null."""
    scratch = Scratch(docs.sparkSession)
    k, k_th = fresh(docs, "id", "th")
    if by_text:
        found = _matches(docs, bench, id_col, text_col, item_col, item_text, similarity, scratch)
        found = scratch.save(found.select(F.col("id").alias(k), F.col("th").alias(k_th)).distinct(), "found")
        return docs.join(found, F.col(id_col).eqNullSafe(F.col(k)) & (F.xxhash64(text_of(text_col)) == F.col(k_th)), "left_anti")
    found = contaminated(docs, bench, id_col, text_col, item_col, item_text, similarity, scratch)
    found = scratch.save(found.select(F.col(id_col).alias(k)).distinct(), "found")
    return docs.join(found, F.col(id_col).eqNullSafe(F.col(k)), "left_anti")

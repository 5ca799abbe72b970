"""Repeated passages by runs of sentences, against plain versions."""

from conftest import SF

from plexar.llm import unit_dedup
from plexar.llm.queries import QUERIES


def words(n, stem):
    return " ".join(f"{stem}{k}" for k in range(n))


def test_runs(spark):
    """A passage of 50 words inside a line is found but for its ends; a short one, and one-word cries, are not."""
    passage = ". ".join(words(9, f"p{k}x") for k in range(6))
    rows = [
        (1, f"{words(7, 'a')} {passage} {words(7, 'b')}."),
        (2, f"{words(5, 'c')}. {words(6, 'd')} {passage} {words(4, 'e')}."),
        (3, f"{words(20, 'f')}. {words(9, 'p1x')}. {words(20, 'g')}."),
        (4, " ".join(f"w{k}!!" for k in range(40))),
        (5, " ".join(f"w{k}!!" for k in range(40, 0, -1))),
        (6, rows_text := f"Own words here only. {words(30, 'h')}.\nShort.\nOne more line of words that ends here."),
        (7, rows_text.replace("Own words here only.", "Other words are said.")),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = unit_dedup.duplicate_units(df).collect()
    assert {x["id"] for x in got} == {2, 7} and {x["first_id"] for x in got if x["id"] == 2} == {1}
    text = dict(rows)[2]
    cut = [text[x["start"] : x["start"] + x["n_chars"]] for x in sorted(got, key=lambda x: x["start"]) if x["id"] == 2]
    assert "".join(cut) == " " + ". ".join(words(9, f"p{k}x") for k in range(1, 5)) + "."
    out = {x["doc_id"]: x["text"] for x in unit_dedup.remove_units(df).collect()}
    assert all(out[k] == dict(rows)[k] for k in (1, 3, 4, 5, 6)) and out[7] == "Other words are said.\nShort."
    assert out[2] == text.replace("".join(cut), "")


def test_cut():
    assert unit_dedup.cut("a b\n\nc d\n\ne", [(5, 3)]) == "a b\n\ne"
    assert unit_dedup.cut("a b\nc d", [(4, 3)]) == "a b" and unit_dedup.cut("a b", [(0, 3)]) == ""
    assert unit_dedup.cut("x. y. z", [(2, 3)]) == "x. z" and unit_dedup.cut("a\0b. c", [(0, 4)]) == " c"


def test_passages_found(spark):
    """Documents that hold 50 words in a row of an earlier document, and documents that share no 20 words with any."""
    folder = SF.replace("0.001", "0.01")
    rows = sorted((r[0], (r[1] or "").lower().encode().split()) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())

    def shared(n):
        first, out = {}, set()
        own = {}
        for i, w in rows:
            for p in range(len(w) - n + 1):
                h = hash(tuple(w[p : p + n]))
                if first.setdefault(h, i) != i:
                    out.add(i)
                    own.setdefault(h, i)
        return out, {first[h] for h in own}

    later, _ = shared(50)
    again, before = shared(20)
    cries = {i for i, w in rows if len(set(w)) * 10 < len(w)}
    later, clean = later - cries, {i for i, _ in rows} - again - before - cries
    found = {r[0] for r in QUERIES["op8_unit_dedup"](spark, folder).select("doc_id").distinct().collect()}
    assert len(later) > 80 and len(found & later) >= 0.95 * len(later)
    assert len(found & clean) <= 0.02 * len(clean)

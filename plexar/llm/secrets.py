"""Secret scans: candidates by pattern, false positives removed by a random forest, in DataFrame functions.

The forest is trained on the driver on a bounded, seeded set of labelled findings (``labelled_findings``, TRAIN_ROWS
rows), whose features come from the same column expressions as the corpus's, and becomes one SQL expression that Spark
compiles: no Python runs over the corpus.
"""

from __future__ import annotations

import random
import string
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, text_of, words_of

#: What a candidate is, the dictionary, and the telling neighbours.
CANDIDATE = r"[A-Za-z0-9+/_\-]{16,}={0,2}"
RUN = f"(?<![A-Za-z0-9+/_\\-])({CANDIDATE})(?![A-Za-z0-9+/_\\-=])"
LEAST_TOKEN = 16
DICTIONARY = (
    "example sample test demo dummy change fake your secret token password passwd key api access auth admin user name "
    "value mail http https www com org net file path index html version release build commit branch hash sha md5 uuid "
    "data table page image static content the and for with this that from have not you license apache"
).split()
SECRET_WORDS = "key token secret password passwd pwd auth credential credentials bearer apikey api_key access_key private"
OTHER_WORDS = "sha sha1 sha256 md5 checksum digest commit uuid guid etag id order example sample test placeholder revision hash build"
TRAIN_ROWS = 1600
TREES, DEPTH = 15, 5
FEATURES = ("length", "digits", "uppers", "hexes", "transitions", "distinct", "dictionary", "pathlike", "keyed", "secret_near", "other_near", "known_prefix", "path_test")


def candidates(docs: DataFrame, id_col: str, text_col: str, path_col: str | None) -> DataFrame:
    """(id, word, token, value, rest, before, after, path): every run of CANDIDATE with a digit, in words of LEAST_TOKEN
    characters or more; word is the place among the words, value the run, rest the word from the end of the run before
    it, before the words ahead."""
    rows = docs.select(F.col(id_col).alias("id"), words_of(text_col).alias("w"), (F.col(path_col).cast("string") if path_col else F.lit("")).alias("path"))
    at = F.filter(F.transform("w", lambda x, i: F.when((F.length(x) >= LEAST_TOKEN) & x.rlike("[0-9]"), i).otherwise(-1)), lambda i: i >= 0)
    word = lambda i: F.coalesce(F.get("w", i), F.lit(""))
    rows = rows.select("id", "path", "w", F.explode(at).alias("i")).select(
        "id", "path", F.col("i").alias("word"), word(F.col("i")).alias("token"),
        F.concat_ws(" ", word(F.col("i") - 3), word(F.col("i") - 2), word(F.col("i") - 1)).alias("before"), word(F.col("i") + 1).alias("after"))
    rows = rows.withColumn("runs", F.filter(F.regexp_extract_all("token", F.lit(RUN), F.lit(1)), lambda x: x.rlike("[0-9]")))
    rows = rows.select("*", F.posexplode("runs").alias("at", "value"))
    return rows.withColumn("rest", F.expr("aggregate(slice(runs, 1, at), token, (a, r) -> substring(a, instr(a, r) + length(r)))")).drop("runs", "at", "w", "i")


def with_features(c: DataFrame) -> DataFrame:
    """Adds FEATURES (doubles) to candidates."""
    v, low = F.col("value"), F.lower("value")
    n = F.greatest(F.length(v), F.lit(1)).cast("double")  # the optimizer may judge rows before the filter on value
    share = lambda keep: F.length(F.regexp_replace(v, f"[^{keep}]", "")) / n
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0")
    near = lambda words, where: where.rlike(r"(?i)(^|[^a-z0-9])(" + "|".join(words.split()) + r")([^a-z0-9]|$)")
    head = F.concat_ws(" ", "before", F.regexp_extract("rest", r"^(.*?)[=:]", 1))
    return c.withColumns({
        "length": n,
        "digits": share("0-9"), "uppers": share("A-Z"), "hexes": share("0-9a-f"),
        "transitions": (F.length(kinds) - 1) / n,
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / n,
        "dictionary": (n - F.length(F.regexp_replace(low, "|".join(sorted(DICTIONARY, key=len, reverse=True)), ""))) / n,
        "pathlike": (F.length(F.regexp_replace("token", r"[^/@.]", "")) / F.greatest(F.length("token"), F.lit(1))).cast("double"),
        "keyed": F.col("token").rlike("[=:]").cast("double"),
        "secret_near": near(SECRET_WORDS, head).cast("double"),
        "other_near": near(OTHER_WORDS, F.concat_ws(" ", head, "after")).cast("double"),
        "known_prefix": v.rlike("^(AKIA|ASIA|ghp_|gho_|sk_|sk-|xox|AIza|eyJ)").cast("double"),
        "path_test": F.coalesce(F.col("path"), F.lit("")).rlike("(?i)test|example|sample|doc|mock").cast("double"),
    })


def labelled_findings(n: int = TRAIN_ROWS, seed: int = 5) -> list[tuple[str, str, str, str, int]]:
    """(token, before, after, path, label): synthetic findings of the common kinds, half of them secrets.

    Secrets: access keys, hexadecimal and base-64 tokens under a telling name, prefixed tokens. Others: checksums,
    commit and object ids, e-mail addresses, paths and links, identifiers of words, placeholders, plain numbers.
    """
    rng = random.Random(seed)
    pick = lambda alphabet, k: "".join(rng.choices(alphabet, k=k))
    hexa, b64, upper = "0123456789abcdef", string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits
    prose = lambda: pick(string.ascii_lowercase, rng.randint(2, 9))
    name = lambda: rng.choice(SECRET_WORDS.split())
    other = lambda: rng.choice(OTHER_WORDS.split())
    word = lambda: rng.choice(DICTIONARY)
    quote = lambda x: rng.choice([f'"{x}"', f"'{x}'", x, x + ","])
    out = []
    for k in range(n):
        before, after = f"{prose()} {prose()} {prose()}", prose()
        path = rng.choice(["src", "web", "config", "app"]) + str(rng.randint(0, 30))
        if k % 2:
            kind = rng.randrange(5)
            if kind == 0:
                token = "AKIA" + pick(upper, 16)
            elif kind == 1:
                token = f"{name()}{rng.choice('=:')}{pick(hexa, rng.choice([16, 18, 20, 24, 32, 40, 64]))}"
            elif kind == 2:
                token, before = quote(pick(hexa, rng.choice([24, 32, 40, 64]))), f"{prose()} {name()} {rng.choice(['=', ':', 'is'])}"
            elif kind == 3:
                token, before = quote(pick(b64, rng.randint(20, 64))), f"{prose()} {name()} {rng.choice(['=', ':', 'is'])}"
            else:
                token = rng.choice(["ghp_", "sk_live_", "xoxb-", "AIza"]) + pick(string.ascii_letters + string.digits, rng.randint(24, 40))
        else:
            kind = rng.randrange(9)
            if kind == 0:
                token, before = quote(pick(hexa, rng.choice([32, 40, 64]))), f"{prose()} {other()} {rng.choice(['=', ':', 'is', prose()])}"
            elif kind == 1:
                token = "-".join(pick(hexa, m) for m in (8, 4, 4, 4, 12))
            elif kind == 2:
                token = f"{prose()}.{rng.randint(10, 99)}@mail{rng.randint(0, 9)}.example.com"
            elif kind == 3:
                token = rng.choice(["https://www.", "/", "src/"]) + "/".join(prose() + rng.choice(["", str(rng.randint(0, 99))]) for _ in range(4)) + rng.choice(["", ".html"])
            elif kind == 4:
                token = "_".join(word() for _ in range(rng.randint(3, 5))) + f"_{rng.randint(1, 99)}"
            elif kind == 5:
                token, before = rng.choice(["your_api_key_here_123", "EXAMPLE_KEY_1234567890", "changeme1234567890", "xxxxxxxxxxxxxxxx1234", "0000000000000000"]), f"{prose()} {name()} ="
            elif kind == 6:
                token = pick(string.digits, rng.choice([16, 18, 20]))
            elif kind == 7:
                token, path = f"{name()}={word()}{word()}{word()}{rng.randint(100, 9999)}abcdef", "test/example"
            else:
                token = "".join(prose() for _ in range(3)) + str(rng.randint(0, 99))
        out.append((token, before, after, path, k % 2))
    return out


def _grow(x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator):
    """A tree: a share of secrets, or (feature, threshold, below, above)."""
    share = float(y.mean())
    if depth == 0 or len(y) < 8 or share in (0.0, 1.0):
        return share
    best = (1.0, None, None)
    for f in rng.choice(x.shape[1], size=5, replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, cum = x[order, f], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        n1 = cut + 1.0
        n2, p1, p2 = len(y) - n1, cum[cut] / n1, (cum[-1] - cum[cut]) / (len(y) - n1)
        gini = (n1 * 2 * p1 * (1 - p1) + n2 * 2 * p2 * (1 - p2)) / len(y)
        k = int(gini.argmin())
        if gini[k] < best[0]:
            best = (float(gini[k]), int(f), float((v[cut[k]] + v[cut[k] + 1]) / 2))
    _, f, t = best
    if f is None:
        return share
    low = x[:, f] <= t
    return f, t, _grow(x[low], y[low], depth - 1, rng), _grow(x[~low], y[~low], depth - 1, rng)


def _sql(tree) -> str:
    if isinstance(tree, float):
        return f"{tree:.6f}D"
    f, t, low, high = tree
    return f"if(`{FEATURES[f]}` <= {t!r}D, {_sql(low)}, {_sql(high)})"


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 5) -> list:
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        out.append(_grow(x[rows], y[rows], depth, rng))
    return out


@lru_cache(maxsize=4)
def _forest_sql(rows: tuple) -> str:
    spark = SparkSession.getActiveSession()
    table = spark.createDataFrame([(i, t, b, a, p, y) for i, (t, b, a, p, y) in enumerate(rows)], "i int, token string, before string, after string, path string, y int")
    value = F.regexp_extract("token", f"(?:^|[^A-Za-z0-9+/_\\-])({CANDIDATE})(?:[^A-Za-z0-9+/_\\-=]|$)", 1)
    table = with_features(table.withColumn("value", value).withColumn("rest", F.col("token")).where(F.col("value") != ""))
    got = np.array(table.orderBy("i").select("y", *FEATURES).collect(), float)
    trees = fit_forest(got[:, 1:], got[:, 0])
    return "(" + " + ".join(map(_sql, trees)) + f") / {len(trees)}D"


def forest_score(findings: list[tuple[str, str, str, str, int]] | None = None) -> Column:
    """The forest as a column over FEATURES: the mean share of secrets in the leaves that a candidate reaches."""
    return F.expr(_forest_sql(tuple(findings or labelled_findings())))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", threshold: float = 0.5,
         findings: list | None = None) -> DataFrame:
    """(id, word, value, score, is_secret): every candidate of the whole texts, with the forest's score.

    Candidates are all runs of 16 or more letters, digits, +, /, _ and -, with a digit, within one word, not followed by
    = and a value; word is the place among the text's words. Features: length, shares of digits, capitals and hexadecimal digits, character-class
    transitions, distinct characters, dictionary coverage, neighbouring words, and the path (path_col). Null, empty and
    short texts have no candidates; very long texts are searched whole, in place; equal values are findings each where
    they stand; a null path is an empty one. Repeated rows give their findings each. An empty
    table gives an empty result.
    """
    scored = with_features(candidates(docs, id_col, text_col, path_col)).withColumn("score", F.round(forest_score(findings), 6))
    return scored.select(F.col("id").alias(id_col), "word", "value", "score", (F.col("score") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", mark: str = "[secret]") -> DataFrame:
    """docs with the values of findings replaced by mark, and n_secrets (distinct values; an input column of this name
    is replaced). All rows of an id are cleared of all values found under that id; rows of null id likewise."""
    k_id, k_found = fresh(docs, "id", "found")
    found = scan(docs, id_col, text_col, path_col).where("is_secret")
    found = found.groupBy(F.col(id_col).alias(k_id)).agg(F.sort_array(F.collect_set("value"), asc=False).alias(k_found))
    joined = docs.join(found, F.col(id_col).eqNullSafe(F.col(k_id)), "left")
    values = F.coalesce(F.col(k_found), F.array().cast("array<string>"))
    clean = F.aggregate(values, F.col(text_col), lambda t, v: F.replace(t, v, F.lit(mark)))
    return joined.select(*[(clean.alias(c) if c == text_col else F.col(f"`{c}`")) for c in docs.columns if c.lower() != "n_secrets"], F.size(values).alias("n_secrets"))

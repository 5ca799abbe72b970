"""Every run of a word is a candidate."""

from test_corpus import DOC

from plexar.llm import secrets


def test_all_runs(spark):
    gh, a, b = "ghp_" + "a1B2c3D4e5" * 3, "0641917ea4e9feb9cda83477b57ac2654884f485", "wJalr1XUtnFEMI7K7MDENGbPxRfiCYzK93kq2Lm0"
    jwt = ["eyJhbGciOiJIUzI1NiJ9", "eyJzdWIiOiIxMjM0NTY3ODkwIn0", "dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U"]
    texts = {1: f"GITHUB_ACCESS_TOKEN:{gh}", 2: f'{{"AWS_SECRET_ACCESS_KEY":"{b}"}}', 3: f'{{"token":"{a}","password":"{b}"}}', 4: f"secret={a}&api_key={b}", 5: "x " + ".".join(jwt)}
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in texts.items()], DOC)
    rows = secrets.scan(df).collect()
    want = {(1, gh), (2, b), (3, a), (3, b), (4, a), (4, b)} | {(5, x) for x in jwt}
    assert {(x["doc_id"], x["value"]) for x in rows} == want and len(rows) == len(want)
    clean = {x["doc_id"]: x["text"] for x in secrets.redact(df).collect()}
    assert not any(v in clean[k] for k, v in want if k < 5)

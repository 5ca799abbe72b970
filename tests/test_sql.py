import pytest
from pyspark.sql import functions as F

from plexar.plans.batch import Batch, Transaction, retry
from plexar.plans.engine import classify
from plexar.plans.rewrite import rewrite, statements
from plexar.plans.where import Condition, Where
from plexar.sources.catalog import Catalog, ColumnDef, IndexDef, TableDef


def test_rewrite_leaves_text_alone():
    s = "SELECT 'a <-> b', `x<->y` -- c <-> d\n, a <=> b /* <#> */ FROM t WHERE x = 'it''s <=> ARRAY[1]'"
    assert rewrite(s) == s


@pytest.mark.parametrize("op", ["<->", "<=>", "<#>", "<|>"])
def test_rewrite_operators(spark, op):
    spark.createDataFrame([(1, [1.0, 2.0])], "id long, v array<double>").createOrReplaceTempView("rw")
    got = spark.sql(rewrite(f"SELECT id, t.v {op} ARRAY[3, 4.5] AS d FROM rw t WHERE t.v {op} ARRAY[1.0,2.0] < 99 ORDER BY t.v {op} ARRAY[3, 4.5] LIMIT 1")).first()
    assert isinstance(got["d"], float)
    assert spark.sql(rewrite("SELECT v <=> v2 AS d FROM (SELECT v, v AS v2 FROM rw) q", ["v"])).first()["d"] == pytest.approx(0)
    assert spark.sql(rewrite("SELECT id <=> NULL AS e FROM rw")).first()["e"] is False


def test_statements():
    assert statements("SELECT ';' ; -- x;\n SELECT 2;; ") == ["SELECT ';'", "-- x;\n SELECT 2"]
    assert statements(" -- nothing\n") == []


def test_where_tree(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "x long, y string")
    ids = lambda w: sorted(r[0] for r in df.where(w.to_column()).collect())
    assert ids(Where()) == [1, 2, 3] and Where().to_sql() == "1=1"
    assert ids(Where().where("x", "=", 1).or_where("x", "=", 2).and_where("y", "=", "b")) == [2]
    assert ids(Where().where_not_in("y", ["a"])) == [2]  # null is neither in nor out
    assert ids(Where().where_null("y")) == [3]
    assert ids(Where().where("x", "<", 3).invert()) == [3]
    assert ids(Where().group(lambda g: g.where("x", "=", 1).or_where("x", "=", 3)).invert()) == [2]
    p = {}
    sql = Where().where("x", "=", 1).where("x", "!=", 2).or_group(lambda g: g.where_between("x", 3, 4)).to_sql(p)
    assert sql == "(x = :x_0 AND x <> :x_1) OR (x BETWEEN :x_2 AND :x_3)" and p == {"x_0": 1, "x_1": 2, "x_2": 3, "x_3": 4}
    for bad in (lambda: Condition("x", "IN"), lambda: Condition("x", "BETWEEN", (1,)), lambda: Condition("x; drop", "=", (1,)), lambda: Condition("x", "~", (1,)), lambda: Where().group(lambda g: g)):
        with pytest.raises(ValueError):
            bad()


def test_boats(engine):
    engine.sql("""CREATE TABLE boats (no BIGINT PRIMARY KEY, port TEXT NOT NULL, crew INT, worth DECIMAL(12,2), afloat BOOLEAN, seen TIMESTAMP, place VECTOR(2));
      INSERT INTO boats (no, port, crew, worth, afloat, place) VALUES (70, 'Oban', 4, 1200.25, true, ARRAY[3, 4]), (71, 'Moss', 9, 640, true, ARRAY[0, 2]), (72, 'Kiel', 11, 88.5, false, ARRAY[5, 0])""")
    q = lambda s: [tuple(r) for r in engine.sql(s).df.collect()]
    assert q("SELECT port FROM boats WHERE crew >= 5 AND afloat ORDER BY worth") == [("Moss",)]
    assert q("SELECT no FROM boats ORDER BY place <-> ARRAY[0, 1], no LIMIT 2") == [(71,), (70,)]
    assert q("SELECT no, round(place <=> ARRAY[0, 7], 3) AS d FROM boats ORDER BY place <=> ARRAY[0, 7] LIMIT 2") == [(71, 0.0), (70, 0.2)]
    assert engine.sql("UPDATE boats SET crew = crew - 3 WHERE port LIKE '%s%'").affected == 1
    assert q("SELECT crew, seen FROM boats ORDER BY no") == [(4, None), (6, None), (11, None)]
    for bad, why in (("(no, port) VALUES (71, 'x')", "duplicate primary key"), ("(no) VALUES (5)", "null in column")):
        with pytest.raises(ValueError, match=why):
            engine.sql(f"INSERT INTO boats {bad}")
    assert engine.sql("INSERT INTO boats (no, port, crew) VALUES (72, 'Gdynia', 1), (73, 'Brest', 2) ON CONFLICT (no) DO UPDATE SET port = EXCLUDED.port").affected == 2
    assert q("SELECT no, port, crew FROM boats ORDER BY no")[2:] == [(72, "Gdynia", 11), (73, "Brest", 2)]
    assert engine.sql("DELETE FROM boats WHERE crew < 4 LIMIT 1").affected == 1
    assert q("SELECT count(*), max(length(port)) FROM boats") == [(3, 6)]
    engine.sql("ALTER TABLE boats ADD COLUMN flag TEXT DEFAULT 'none'; ALTER TABLE boats DROP COLUMN worth; ALTER TABLE boats RENAME TO fleet")
    assert q("SELECT DISTINCT flag FROM fleet") == [("none",)]
    with pytest.raises(ValueError):
        engine.sql("ALTER TABLE fleet DROP COLUMN no")
    with pytest.raises(ValueError, match="no such table"):
        engine.sql("DROP TABLE boats")
    engine.sql("DROP TABLE IF EXISTS boats; DROP TABLE fleet")
    assert engine.store.catalog.list_tables() == []


def test_vector_index_and_explain(engine):
    engine.sql("CREATE TABLE d (id BIGINT, v VECTOR(2)); INSERT INTO d VALUES " + ", ".join(f"({i}, ARRAY[{i}.0, 1.0])" for i in range(60)))
    assert "Exact search" in engine.sql("EXPLAIN SELECT id FROM d ORDER BY v <-> ARRAY[3,1] LIMIT 2").df.first()[0]
    engine.sql("SET hnsw.ef_search = 512; CREATE INDEX iv ON d USING hnsw (v) WITH (m=4, ef_construction=16, metric=l2)")
    assert engine.ef_search == 512
    assert "KNN search" in engine.explain("SELECT id FROM d ORDER BY v <-> ARRAY[3,1] LIMIT 2")
    assert [r["id"] for r in engine.knn("d", "v", [7.2, 1.0], 3, mode="index").collect()] == [7, 8, 6]
    assert [r["id"] for r in engine.knn("d", "v", [7.2, 1.0], 2, where="id > 30").collect()] == [31, 32]
    engine.sql("INSERT INTO d VALUES (1000, ARRAY[7.2, 1.0])")
    assert engine.knn("d", "v", [7.2, 1.0], 1, mode="index").first()["id"] == 1000
    with pytest.raises(ValueError):
        engine.sql("CREATE INDEX i2 ON d USING hnsw (v) WITH (m=100)")
    meta = engine.metadata("SELECT id FROM d WHERE id < 5")
    assert meta["rows_returned"] == 5 and meta["rows_examined"] == 61
    engine.sql("DROP INDEX iv")
    engine.regenerate("d", "v", "array(0.0, 0.0)")
    assert engine.sql("SELECT DISTINCT v FROM d").df.count() == 1


def test_sql_text_uses_and_keeps_the_index(engine):
    ids = lambda s: [r["id"] for r in engine.sql(s).df.collect()]
    near = "SELECT id FROM near ORDER BY v <-> ARRAY[7.2, 1] LIMIT 3"
    engine.sql("CREATE TABLE near (id BIGINT, note TEXT, v VECTOR(2)); INSERT INTO near (id, v) VALUES " + ", ".join(f"({i}, ARRAY[{i}.0, 1.0])" for i in range(60)))
    engine.sql("CREATE INDEX nv ON near USING hnsw (v) WITH (m=4, ef_construction=16, metric=l2)")
    assert "KNN search" in engine.explain(near) and ids(near) == [7, 8, 6] and not engine.metadata(near)["table_scan"]
    assert ids("SELECT id FROM near ORDER BY v <-> ARRAY[7.2, 1] ASC, id LIMIT 2 OFFSET 1") == [8, 6]
    # what an index cannot answer is searched exactly: conditions, other metrics, calls, more rows than there are
    for other in ("SELECT id FROM near WHERE id > 30 ORDER BY v <-> ARRAY[7.2, 1] LIMIT 3", "SELECT id FROM near ORDER BY v <|> ARRAY[7.2, 1] LIMIT 3",
                  "SELECT upper(note) FROM near ORDER BY v <-> ARRAY[7.2, 1] LIMIT 3", "SELECT id FROM near ORDER BY v <-> ARRAY[7.2, 1] LIMIT 900"):
        assert engine._planned(other)[1] is False
    assert len(ids("SELECT id FROM near ORDER BY v <-> ARRAY[7.2, 1] LIMIT 900")) == 60
    engine.sql("INSERT INTO near (id, v) VALUES (1000, ARRAY[7.2, 1.0])")
    assert ids(near) == [1000, 7, 8]
    engine.sql("DELETE FROM near WHERE id = 7")
    assert ids(near) == [1000, 8, 6] and "KNN search" in engine.explain(near)
    engine.sql("DELETE FROM near WHERE id = 1000; INSERT INTO near (id, v) VALUES (2000, ARRAY[7.3, 1.0])")  # its row id was removed before
    assert ids(near) == [2000, 8, 6]
    engine.sql("UPDATE near SET note = 'x'; UPDATE near SET v = ARRAY[7.2, 1.0] WHERE id = 50")
    assert ids(near) == [50, 2000, 8] and engine._planned(near)[1]


def test_delete_without_condition_is_confirmed(engine):
    engine.sql("CREATE TABLE gone (id BIGINT); INSERT INTO gone VALUES (1), (2)")
    with pytest.raises(ValueError, match="confirmed"):
        engine.sql("DELETE FROM gone")
    assert engine.sql("SET confirm_delete_all = true; DELETE FROM gone").affected == 2
    with pytest.raises(ValueError, match="confirmed"):
        engine.sql("SET confirm_delete_all = false; DELETE FROM gone LIMIT 1")


def test_builders(engine):
    engine.sql("CREATE TABLE u (id INT PRIMARY KEY, name TEXT, age INT, v VECTOR(2)); CREATE TABLE o (oid INT, uid INT, amount INT)")
    rows = [{"id": i, "name": n, "age": a, "v": [float(i), 0.0]} for i, n, a in ((1, "Alice", 28), (2, "Bob", 35), (3, "Charlie", 42))]
    assert engine.insert().into("u").values(rows).execute() == 3
    assert engine.insert().into("o").values([{"oid": 1, "uid": 1, "amount": 5}, {"oid": 2, "uid": 1, "amount": 7}, {"oid": 3, "uid": 9, "amount": 1}]).execute() == 3
    s = engine.select().from_("u").columns("name", "name").upper("name", "up").where("age", ">", 30).order_by("age", descending=True)
    assert [tuple(r) for r in s.execute().collect()] == [("Charlie", "CHARLIE"), ("Bob", "BOB")]
    p = {}
    assert s.limit(5).to_sql(p) == "SELECT name, upper(name) AS up FROM u WHERE age > :age_0 ORDER BY age DESC LIMIT 5" and p == {"age_0": 30}
    knn = engine.select().from_("u").columns("id").knn("v", [2.9, 0.0], 2).with_scores().execute().collect()
    assert [r["id"] for r in knn] == [3, 2] and knn[0]["distance"] == pytest.approx(0.1)
    assert engine.select().from_("u").columns("id").l2("v", [0.0, 0.0]).within(1.5).execute().count() == 1
    j = engine.select().from_("u").column("name").expr("sum(amount)", "s").join("o", "id", "uid").group_by("name").having("s > 3").execute()
    assert [tuple(r) for r in j.execute().collect()] if hasattr(j, "execute") else [tuple(r) for r in j.collect()] == [("Alice", 12)]
    assert [r[0] for r in engine.select().from_("u").columns("id").order_by("id").page(2, 2).execute().collect()] == [3]
    c = engine.select().from_("u").case([("age > 40", "old")], "young", "c").order_by("id").execute()
    assert [r[0] for r in c.collect()] == ["young", "young", "old"]
    for bad in (lambda: engine.select().columns("x"), lambda: engine.select().from_("u").build(), lambda: engine.update("u").to_sql(), lambda: engine.delete("u").execute(), lambda: engine.insert().to_sql()):
        with pytest.raises(ValueError):
            bad()
    assert engine.update("u").set("age", 1).where("id", "=", 2).execute() == 1
    assert engine.update("u").set_expr("age", "age * 2").execute() == 3
    assert [r[0] for r in engine.sql("SELECT age FROM u ORDER BY id").df.collect()] == [56, 2, 84]
    up = engine.insert().into("u").value(id=2, name="Bo", age=0, v=[1.0, 1.0]).on_conflict(["id"], "update", ["name"])
    assert "ON CONFLICT (id) DO UPDATE SET name = EXCLUDED.name" in up.to_sql()
    up.execute()
    engine.insert().into("u").value(id=3, name="No", age=0, v=[1.0, 1.0]).on_conflict(["id"], "ignore").execute()
    assert [tuple(r) for r in engine.sql("SELECT name, age FROM u ORDER BY id").df.collect()] == [("Alice", 56), ("Bo", 2), ("Charlie", 84)]
    got = engine.insert().into("o").value(oid=9, uid=1, amount=2).returning().collect()
    assert [r["oid"] for r in got] == [9] and got[0]["_id"] == 3
    assert engine.delete("o").where("uid", "=", 9).execute() == 1
    assert engine.delete("o").confirm_delete_all().limit(1).execute() == 1
    with pytest.raises(TypeError):
        engine.insert().into("u").value(id="x").frame()


def test_permissions(engine):
    engine.bits = {"tables": 1}
    with pytest.raises(PermissionError):
        engine.sql("DROP TABLE x")
    engine.bits = {}


def test_batches():
    done = []
    b = Batch()
    for name, kind, tables, after, pr in (("a", "insert", ["t"], [], 0), ("b", "select", ["t"], [], 9), ("c", "select", ["s"], [], 5), ("d", "custom", [], ["c"], 99)):
        b.add(name, kind, lambda n=name: done.append(n), tables, after, pr)
    assert b.order() == ["c", "d", "a", "b"]  # d's priority counts once c is done; b waits for the write
    b.execute()
    assert done == b.order()
    ring = Batch().add("x", "custom", lambda: 1, after=["y"]).add("y", "custom", lambda: 1, after=["x"])
    with pytest.raises(ValueError, match="wait for each other"):
        ring.order()
    with pytest.raises(ValueError):
        Batch(limit=0).add("x", "custom", lambda: 1)
    bad = Batch().add("x", "custom", lambda: 1 / 0).add("y", "custom", lambda: 1, after=["x"]).add("z", "custom", lambda: 3)
    out = bad.execute(stop_on_error=False)
    assert isinstance(out["x"], ZeroDivisionError) and isinstance(out["y"], RuntimeError) and out["z"] == 3
    n = []
    assert retry(lambda: n.append(1) or (1 / 0 if len(n) < 3 else "ok"), wait=0) == "ok"
    assert retry(lambda: 1 / 0, wait=0, fallback=lambda: 7) == 7


def test_transactions(engine):
    engine.sql("CREATE TABLE t (x INT); INSERT INTO t VALUES (1)")
    rows = lambda: sorted(r[0] for r in engine.store.scan("t").collect())
    t = Transaction(engine.store)
    for k in (2, 3, 4, 5):
        t.run("insert", "t", lambda k=k: engine.sql(f"INSERT INTO t VALUES ({k})"))
    assert rows() == [1, 2, 3, 4, 5]
    t.rollback()
    assert rows() == [1]
    with Transaction(engine.store) as t:
        t.run("insert", "t", lambda: engine.sql("INSERT INTO t VALUES (7)"))
        t.savepoint("s")
        t.run("delete", "t", lambda: engine.sql("DELETE FROM t WHERE x = 1"))
        t.rollback_to("s")
    assert rows() == [1, 7]
    with pytest.raises(ValueError):
        t.commit()


def test_catalog_rules():
    c = Catalog()
    c.create_table(TableDef("t", [ColumnDef("id", "BIGINT", False, True), ColumnDef("v", "VECTOR(3)"), ColumnDef("w", "TEXT")]))
    for bad in (TableDef("", [ColumnDef("x", "INT")]), TableDef("e", []), TableDef("d", [ColumnDef("x", "INT"), ColumnDef("X", "INT")]), TableDef("p", [ColumnDef("x", "INT", True, True)]),
                TableDef("u", [ColumnDef("x", "GEOMETRY")]), TableDef("t", [ColumnDef("x", "INT")])):
        with pytest.raises(ValueError):
            c.create_table(bad)
    c.create_index(IndexDef("i", "t", ["id"]))
    for bad in (IndexDef("j", "t", ["v", "w"], "vector"), IndexDef("j", "t", ["v"], "vector", unique=True), IndexDef("j", "t", ["id", "id"]), IndexDef("j", "t", ["z"]), IndexDef("i", "t", ["id"])):
        with pytest.raises(ValueError):
            c.create_index(bad)
    c.rename_table("t", "s")
    assert c.list_indexes("s")[0].name == "i" and Catalog.from_json(c.to_json()).table("s").schema()[1].metadata == {"dims": 3}
    c.drop_table("s")
    assert c.list_indexes() == []


def test_store_backup_dump_migrate(spark, store, tmp_path):
    store.create(TableDef("t", [ColumnDef("k", "BIGINT", False, True), ColumnDef("s", "TEXT")]))
    store.insert("t", spark.createDataFrame([(1, "1"), (2, "x"), (3, None)], "k long, s string"))
    store.backup(str(tmp_path / "b"))
    store.dump(str(tmp_path / "d"))
    with pytest.raises(ValueError, match="do not fit"):
        store.migrate("t", TableDef("t", [ColumnDef("k", "BIGINT", False, True), ColumnDef("s", "INT")]))
    store.apply("t", lambda df: df.where("k <> 2"))
    assert store.migrate("t", TableDef("t", [ColumnDef("k", "BIGINT", False, True), ColumnDef("s", "INT"), ColumnDef("z", "DOUBLE", default=0.5)]))["add"] == ["z"]
    assert [tuple(r) for r in store.scan("t").orderBy("k").collect()] == [(1, 1, 0.5), (3, None, 0.5)]
    store.restore(str(tmp_path / "b"))
    assert store.scan("t").count() == 3 and store.get("t", 1).first()["s"] == "x" and store.get("t", 77).count() == 0
    store.apply("t", lambda df: df.limit(0))
    store.load(str(tmp_path / "d"))
    assert [r["k"] for r in store.sample("t", 2).collect()] == [1, 2]
    from plexar.sources.tables import Store

    again = Store(spark, store.root)
    assert again.scan("t").count() == 3 and Store(spark, store.root, org=2).catalog.list_tables() == []


def test_classify():
    assert classify("SELECT * FROM t ORDER BY v <-> ARRAY[1]") == "vector_search" and classify("SELECT * FROM a JOIN b ON x = y") == "join"
    assert classify("SELECT 1") == "table_scan"


def test_collections(spark, store):
    from plexar.sources import collections as col

    store.create(TableDef("docs", [ColumnDef("id", "BIGINT", False), ColumnDef("title", "TEXT"), ColumnDef("score", "DOUBLE"), ColumnDef("embedding", "VECTOR(4)")]))
    col.put(store.catalog, col.Projection("c", "docs", {"id": "doc_id", "title": "document_title", "score": "relevance_score", "embedding": "vector_data"}))
    good = '{"doc_id":42,"document_title":"Test Document","relevance_score":0.95,"vector_data":[0.1,0.2,0.3,0.4]}'
    whole = '{"doc_id":43,"document_title":"x","relevance_score":2,"vector_data":[1,2,3,4]}'
    assert col.ingest(store, "c", spark.createDataFrame([(good,), (whole,)], "doc string")) == 2
    row = store.scan("docs").where("id = 42").first()
    assert row["score"] == 0.95 and row["embedding"][1] == pytest.approx(0.2)
    for bad, key in ((good.replace("42", '"42"'), "doc_id"), (good.replace('"document_title":"Test Document",', ""), "document_title"), (good.replace("[0.1,0.2,0.3,0.4]", "7"), "vector_data"), (good.replace("0.95", '"x"'), "relevance_score")):
        with pytest.raises(ValueError, match=key):
            col.ingest(store, "c", spark.createDataFrame([(bad,)], "doc string"))
    assert col.ingest(store, "c", spark.createDataFrame([("not json",), (good,)], "doc string"), strict=False) == 1
    with pytest.raises(ValueError, match="collection not found"):
        col.get(store.catalog, "zzz")
    assert col.names(store.catalog) == ["c"]


def test_relational_helpers(spark):
    from plexar.operators import relational as rel

    df = spark.createDataFrame([(i,) for i in range(10)], "x long")
    assert rel.summary(df.limit(0), "x", "bigint").first()[:] == (0, 0, 0, 0)
    assert rel.first_rows(df, "x", 0).count() == 0
    assert [r["value"] for r in rel.percentiles(df, "x", [0, 50, 95, 100]).orderBy("point").collect()] == [0, 5, 9, 9]
    ids = rel.dense_ids(spark.range(100, numPartitions=7), "n", 5)
    assert sorted(r["n"] for r in ids.collect()) == list(range(5, 105))
    lists = spark.createDataFrame([([5, 1, 7],)], "v array<int>")
    assert [r[0] for r in rel.selected(lists, "v", ">", 4).collect()] == [0, 2]
    j = rel.join(df, df.where("x < 3"), ("a", "b"), ("x", "x"), "left")
    assert j.columns == ["a.x", "b.x"] and j.where(F.col("`b.x`").isNull()).count() == 7

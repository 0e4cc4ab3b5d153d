"""Statements, constraints, storage, transactions, prepared statements and clients."""

from __future__ import annotations

import io
import threading
from dataclasses import replace

import pytest

from vexalith.cli import Shell
from vexalith.client import Client
from vexalith.database import Database
from vexalith.errors import ConflictError, ConnectionClosedError, ConstraintError, DimensionMismatchError, ParseError, QueryError, TableNotFoundError, TransactionError
from vexalith.prepared import BatchInserter, PreparedStatement, StatementCache
from vexalith.sources import catalog
from vexalith.streaming.ingest import ingest
from vexalith.tools import Tools
from vexalith.transactions import ConcurrentDatabase, Connection, DatabasePool
from vexalith.vectorstore import VectorStore

DOCS = "CREATE TABLE docs (id INTEGER PRIMARY KEY, embedding VECTOR(3), title TEXT UNIQUE, score FLOAT DEFAULT 1.5, ok BOOLEAN)"
ROWS = "INSERT INTO docs (embedding, title, score) VALUES ([1,0,0], 'X axis', 1), ([0,1,0], 'Y axis', 2.5), ([0,0,1], 'Z', NULL), ([.5,.5,0], 'XY plane', 4)"


@pytest.fixture(params=["memory", "files"])
def db(spark, tmp_path, request):
    d = Database(spark, str(tmp_path / "db") if request.param == "files" else None)
    d.execute(DOCS)
    assert d.execute(ROWS).ids == [1, 2, 3, 4]
    return d


def rows(db, sql, *values):
    return [tuple(r) for r in db.execute(sql, values).rows()]


def test_search_filters_first_and_orders_by_distance(db):
    got = rows(db, "SELECT title FROM docs WHERE embedding SIMILARITY [0.9, 0.1, 0] LIMIT 2")
    assert [t for t, _ in got] == ["X axis", "XY plane"] and got[0][1] == pytest.approx(0.02)
    assert [t for t, _ in rows(db, "SELECT title FROM docs WHERE score > 1 AND embedding SIMILARITY [0.9,0.1,0] LIMIT 1")] == ["XY plane"]
    assert len(rows(db, "SELECT * FROM docs WHERE embedding SIMILARITY [1,1,1]")) == 4
    with pytest.raises(DimensionMismatchError):
        db.execute("SELECT * FROM docs WHERE embedding SIMILARITY [1,1]")


def test_update_delete_insert(db):
    assert db.execute("UPDATE docs SET score = 9, ok = true WHERE id IN (1, 3)").affected == 2
    assert rows(db, "SELECT id, score, ok FROM docs ORDER BY id") == [(1, 9.0, True), (2, 2.5, None), (3, 9.0, True), (4, 4.0, None)]
    assert db.execute("UPDATE docs SET embedding = [0,0,5] WHERE id = 2").affected == 1
    assert rows(db, "SELECT id FROM docs WHERE embedding SIMILARITY [0,0,5] LIMIT 1")[0] == (2, 0.0)
    assert db.execute("DELETE FROM docs WHERE title NOT LIKE '%axis'").affected == 2
    assert db.execute("INSERT INTO docs (title, embedding) VALUES ('Z', [0,0,1])").ids == [5]
    assert rows(db, "SELECT id, title, score FROM docs ORDER BY id") == [(1, "X axis", 9.0), (2, "Y axis", 2.5), (5, "Z", 1.5)]
    assert rows(db, "SELECT title FROM docs WHERE embedding SIMILARITY [0,0,1] LIMIT 1")[0][0] == "Z"
    assert db.execute("DELETE FROM docs").affected == 3
    assert rows(db, "SELECT COUNT(*), SUM(score), AVG(score), MIN(title) FROM docs") == [(0, 0.0, None, None)]
    assert rows(db, "SELECT * FROM docs WHERE embedding SIMILARITY [1,0,0]") == []


def test_constraints_and_errors_change_nothing(db):
    for sql, error in (
        ("INSERT INTO docs (title, embedding) VALUES ('new', [1,2,3]), ('X axis', [1,2,3])", ConstraintError),
        ("INSERT INTO docs (title) VALUES ('twice'), ('twice')", ConstraintError),
        ("UPDATE docs SET title = 'same'", ConstraintError),
        ("INSERT INTO docs (embedding) VALUES ([1,2])", DimensionMismatchError),
        ("UPDATE docs SET embedding = [1]", DimensionMismatchError),
        ("INSERT INTO docs (nope) VALUES (1)", QueryError),
        ("INSERT INTO docs (title, score) VALUES (1)", QueryError),
        ("INSERT INTO docs (title) VALUES (5)", QueryError),
        ("UPDATE docs SET nope = 1", QueryError),
        ("SELECT nope FROM docs", QueryError),
        ("SELECT title FROM docs WHERE nope = 1", QueryError),
        ("SELECT MAX(nope) FROM docs", QueryError),
        ("SELECT title, COUNT(*) FROM docs", QueryError),
        ("SELECT * FROM nix", TableNotFoundError),
        ("DROP TABLE nix", TableNotFoundError),
        (DOCS, QueryError),
        ("SELECT * FROM docs LIMIT 1 UNION", ParseError),
    ):
        with pytest.raises(error):
            db.execute(sql)
    assert rows(db, "SELECT COUNT(*) AS n FROM docs") == [(4,)]
    assert db.execute("INSERT INTO docs (title) VALUES (NULL), (NULL)").affected == 2


def test_not_null_and_positional_insert(spark):
    d = Database(spark)
    d.execute("CREATE TABLE t (k TEXT PRIMARY KEY, n INT NOT NULL, x BLOB)")
    assert d.execute("INSERT INTO t VALUES ('a', 1, NULL)").ids == [1]
    for bad in ("INSERT INTO t VALUES (NULL, 1, NULL)", "INSERT INTO t (k) VALUES ('b')", "INSERT INTO t VALUES ('a', 2, NULL)"):
        with pytest.raises(ConstraintError):
            d.execute(bad)


def test_reopening_finds_everything(spark, tmp_path):
    d = Database(spark, str(tmp_path / "db"))
    d.execute(DOCS)
    d.execute(ROWS)
    d.execute("DELETE FROM docs WHERE id = 2")
    again = Database.open(spark, str(tmp_path / "db"))
    assert rows(again, "SELECT title FROM docs WHERE embedding SIMILARITY [0,0,1] LIMIT 1")[0][0] == "Z"
    assert again.execute("INSERT INTO docs (title) VALUES ('late')").ids == [5]
    with pytest.raises(ConstraintError):
        again.execute("INSERT INTO docs (title) VALUES ('Z')")
    again.save(str(tmp_path / "copy"))
    assert again.catalog.vacuum() > 0
    assert rows(again, "SELECT COUNT(*) AS n FROM docs") == rows(Database(spark, str(tmp_path / "copy")), "SELECT COUNT(*) AS n FROM docs") == [(4,)]
    assert [tuple(r) for r in again.show().collect()] == [("docs", 4, 3)]


def test_joins_with_nulls_and_kinds(spark):
    d = Database(spark)
    d.execute("CREATE TABLE a (x INT, s TEXT)")
    d.execute("CREATE TABLE b (x FLOAT, id INT)")
    d.execute("INSERT INTO a VALUES (1, 'one'), (NULL, 'none'), (3, 'three')")
    d.execute("INSERT INTO b (x) VALUES (1.0), (NULL), (7.5)")
    assert sorted(rows(d, "SELECT a.s, b.id FROM a JOIN b ON b.x = a.x"), key=repr) == [("none", 2), ("one", 1)]
    assert sorted(rows(d, "SELECT a.s, b.id FROM a LEFT JOIN b ON a.x = b.x"), key=repr) == [("none", 2), ("one", 1), ("three", None)]
    assert sorted(rows(d, "SELECT a.s, b.id FROM a RIGHT JOIN b ON a.x = b.x"), key=repr) == [("none", 2), ("one", 1), (None, 3)]
    assert rows(d, "SELECT s FROM a JOIN b ON a.s = b.id") == []
    with pytest.raises(QueryError):
        d.execute("SELECT x FROM a JOIN b ON a.x = b.x")


def test_dataframes_are_appended_with_running_ids(db, spark):
    df = spark.range(0, 57, 1, 5).selectExpr("array(1f, 2f, cast(id as float)) AS embedding", "concat('t', id) AS title")
    assert db.append("docs", df).affected == 57
    assert rows(db, "SELECT COUNT(*), MIN(id), MAX(id) FROM docs") == [(61, 1, 61)]
    with pytest.raises(QueryError):
        db.append("docs", spark.range(1).selectExpr("id AS nope"))


def test_transactions(db):
    c = Connection(db)
    c.begin()
    c.execute("UPDATE docs SET score = 999")
    assert c.in_transaction and rows(c, "SELECT MAX(score) AS m FROM docs") == [(4.0,)]
    with pytest.raises(TransactionError):
        c.begin()
    c.rollback()
    c.rollback()
    assert rows(c, "SELECT MAX(score) AS m FROM docs") == [(4.0,)]
    with pytest.raises(ConstraintError), c.transaction():
        c.execute("DELETE FROM docs WHERE id = 1")
        c.execute("INSERT INTO docs (title) VALUES ('Y axis')")
    assert rows(c, "SELECT COUNT(*) AS n FROM docs") == [(4,)]
    with c.transaction():
        c.execute("DELETE FROM docs WHERE id = ?", [1])
        c.execute("INSERT INTO docs (title) VALUES ('X axis')")
    assert rows(c, "SELECT COUNT(*) AS n FROM docs") == [(4,)]
    with pytest.raises(TransactionError):
        c.commit()


def test_threads_insert_all_their_rows(spark):
    shared = ConcurrentDatabase(spark)
    pool = DatabasePool(shared)
    pool.get().execute("CREATE TABLE t (v VECTOR(3), n INT)")

    def work(k):
        c = pool.get()
        for i in range(3):
            c.execute("INSERT INTO t VALUES ([1,2,3], ?)", [k * 10 + i])
        pool.put(c)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert [tuple(r) for r in pool.get().execute("SELECT COUNT(*), MIN(n), MAX(n) FROM t").rows()] == [(12, 0, 32)]
    assert shared.with_read(lambda d: d.tables()) == ["t"]


def test_prepared_statements(db):
    s = PreparedStatement("SELECT id FROM docs WHERE title = ? OR score BETWEEN ? AND ? LIMIT ?")
    assert sorted(r[0] for r in s.execute(db, "Z", 2, 3, 5).rows()) == [2, 3]
    assert [r[0] for r in PreparedStatement("SELECT id FROM docs WHERE embedding SIMILARITY ? LIMIT 1").execute(db, [0, 1, 0]).rows()] == [2]
    assert rows(db, "SELECT COUNT(*) AS n FROM docs WHERE title = ?", "' OR id = 1") == [(0,)]
    with pytest.raises(QueryError):
        s.bind(1)
    cache = StatementCache(2)
    assert cache.get("SHOW TABLES") is cache.get("SHOW TABLES")
    for n in range(5):
        cache.get(f"SELECT * FROM docs LIMIT {n}")
    assert len(cache) == 2
    with BatchInserter(db, "docs", ["title", "score"], 2) as b:
        for i in range(3):
            b.add(f"b{i}", i)
    assert b.ids == [5, 6, 7]


def test_client(spark):
    with Client(spark) as c:
        c.create_table("v", 4, {"title": str, "score": "FLOAT"})
        c.create_table("v", 4)
        assert c.insert([1, 0, 0, 0], {"title": "it's"}) == 1
        assert c.insert_batch([[0, 1, 0, 0], [0, 0, 1, 0]], [{"title": "b", "score": 2.0}, {}]) == [2, 3]
        with pytest.raises(ValueError):
            c.insert_batch([[0, 0, 0, 0]], [{}, {}])
        best = c.search([0.9, 0.1, 0, 0], 2)
        assert [r.id for r in best] == [1, 2] and best[0].metadata["title"] == "it's"
        assert [r.id for r in c.search([0.9, 0.1, 0, 0], 5, filter_="title IS NULL")] == [3]
        assert c.update(2, {"title": "z"}) == 1 and c.get(2)["title"] == "z" and c.get(99) is None
        assert c.delete(2) == 1 and c.delete_all() == 2 and c.list_tables() == ["v"]
        assert c.schema().columns == {"embedding": "VECTOR", "title": "TEXT", "score": "FLOAT"}
        assert c.raw_sql("SELECT COUNT(*) AS n FROM v").rows()[0]["n"] == 0
        with pytest.raises(TableNotFoundError):
            c.use("nix")
        c.drop_table("v")
    with pytest.raises(ConnectionClosedError):
        c.list_tables()


def test_vector_store_persists(spark, tmp_path):
    path = str(tmp_path / "store")
    s = VectorStore(spark, 2, "cosine", path)
    assert s.is_empty() and s.centroid() is None and s.query([1, 0]).count() == 0
    assert s.insert_batch([[0, 1], [1, 1], [2, 0]]) == [1, 2, 3]
    with pytest.raises(DimensionMismatchError):
        s.insert_batch([[1, 1], [1, 2, 3]])
    with pytest.raises(DimensionMismatchError):
        s.query([1])
    again = VectorStore.open(spark, path, "cosine")
    assert len(again) == 3 and [r["id"] for r in again.query([1, 0], 2).collect()] == [3, 2]
    assert again.centroid().tolist() == pytest.approx([1, 2 / 3])
    assert again.update(1, [5, 0]) and again.get(1) == [5.0, 0.0] and again.delete(3) and not again.delete(3)
    assert [r["id"] for r in again.query_with_probes([1, 0], 1, 8).collect()] == [1]


def test_tools_and_shell(spark):
    t = Tools(spark).all()
    assert len(t) == 10 and t["status"]()["open"] is False and "error" in t["list_tables"]()
    t["create_database"]()
    t["create_table"]("a", 2, {"n": "int"})
    assert t["batch_insert"]([[1, 2], [3, 4]], [{"n": 1}, {"n": 2}]) == {"ids": [1, 2], "count": 2}
    assert t["search_similar"]([3, 4], 1, filter="n < 2")["results"][0]["id"] == 1
    assert t["execute_sql"]("SELECT COUNT(*) AS n FROM a")["rows"] == [{"n": 2}] and "error" in t["use_table"]("b")
    out = io.StringIO()
    shell = Shell(spark, stdout=out)
    for line in ("CREATE TABLE x (a INT)", "INSERT INTO x VALUES (4)", "SELECT * FROM x", "nonsense", ".tables", ".what", "help", ".open"):
        shell.onecmd(line)
    text = out.getvalue()
    assert "insert x: 1 row(s)" in text and "| 4|" in text.replace("  ", " ") and "Error: Unknown command" in text and shell.onecmd("quit")


def test_a_stream_is_ingested_once(spark, tmp_path):
    d = Database(spark)
    d.execute("CREATE TABLE s (n INT)")
    source = tmp_path / "in"
    spark.range(5).selectExpr("id AS n").write.parquet(str(source))
    stream = spark.readStream.schema("n long").parquet(str(source))
    for _ in range(2):
        q = ingest(d, "s", stream, str(tmp_path / "progress"), availableNow=True)
        q.awaitTermination(60)
    assert rows(d, "SELECT COUNT(*), MAX(n) FROM s") == [(5, 4)]


def test_a_change_rewrites_only_the_parts_it_meets(spark, tmp_path):
    d = Database(spark, str(tmp_path / "db"))
    d.execute("CREATE TABLE t (k INTEGER UNIQUE, name TEXT)")
    for n in range(4):
        d.execute(f"INSERT INTO t VALUES ({2 * n}, 'a'), ({2 * n + 1}, 'b')")
    before = d.catalog.version("t").parts
    assert d.execute("UPDATE t SET name = 'c' WHERE k = 5").affected == 1
    after = d.catalog.version("t").parts
    assert len(set(after) - set(before)) == 1 and set(before) - set(after) == {before[2]}
    assert d.execute("DELETE FROM t WHERE k IN (0, 1)").affected == 2
    assert set(after) - set(d.catalog.version("t").parts) == {before[0]}
    assert rows(d, "SELECT k, name FROM t WHERE name != 'a' ORDER BY k") == [(3, "b"), (5, "c"), (7, "b")]
    with pytest.raises(ConstraintError):  # against a row of another part
        d.execute("UPDATE t SET k = 2 WHERE k = 7")
    assert d.execute("UPDATE t SET name = 'x' WHERE k = 99").affected == 0 and d.execute("DELETE FROM t WHERE k = 99").affected == 0


def test_two_writers_on_one_path_keep_all_commits(spark, tmp_path):
    a, b = Database(spark, str(tmp_path / "db")), Database(spark, str(tmp_path / "db"))
    a.execute("CREATE TABLE t (id INTEGER, n INTEGER)")
    b.execute("CREATE TABLE u (n INTEGER)")
    assert a.execute("INSERT INTO t (n) VALUES (1)").ids == [1]
    assert b.execute("INSERT INTO t (n) VALUES (2)").ids == [2]
    state, base = b.catalog.state(), b.catalog.state()
    a.execute("INSERT INTO t (n) VALUES (3)")
    state["t"] = replace(state["t"], next_id=50)
    with pytest.raises(ConflictError):
        b.catalog.publish(state, base)
    other = dict(base) | {"w": base["u"]}  # another table: laid over what a has published
    b.catalog.publish(other, base)
    assert a.tables() == ["t", "u", "w"] and rows(a, "SELECT id, n FROM t ORDER BY id") == rows(b, "SELECT id, n FROM t ORDER BY id") == [(1, 1), (2, 2), (3, 3)]


def test_writers_in_threads_on_one_path(spark, tmp_path):
    path = str(tmp_path / "db")
    Database(spark, path).execute("CREATE TABLE t (id INTEGER, n INTEGER)")

    def work(n):
        d = Database(spark, path)
        for _ in range(3):
            d.execute("INSERT INTO t (n) VALUES (?)", [n])

    threads = [threading.Thread(target=work, args=(n,)) for n in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert [r[0] for r in rows(Database(spark, path), "SELECT id FROM t ORDER BY id")] == list(range(1, 10))


def test_manifests_far_ahead_are_found(spark, tmp_path, monkeypatch):
    a, b = Database(spark, str(tmp_path / "db")), Database(spark, str(tmp_path / "db"))
    monkeypatch.setattr(catalog, "KEPT", 20)
    for n in range(30):
        a.execute(f"CREATE TABLE t{n} (k INTEGER)")
    assert len(b.tables()) == 30 and len(list((tmp_path / "db").glob("_catalog.*.json"))) <= 21

"""Queries of what changes a database, each with its SQL twin: storage, constraints, direct inserts,
transactions, clients, tools, indexes. Steps are rows, so that errors and refusals can be compared too.
"""

from __future__ import annotations

import io
import threading
import uuid
from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cli import Shell
from .client import Client
from .database import Database
from .errors import EngineError
from .functions import distance
from .operators import accuracy, similarity
from .operators.index import IndexConfig, IVFIndex, LSHIndex
from .plans.ast import Insert
from .prepared import BatchInserter, StatementCache
from .sources.catalog import checkpoint_folder
from .streaming.ingest import ingest
from .tools import Tools
from .transactions import ConcurrentDatabase, Connection, DatabasePool
from .types import Column
from .vectorstore import VectorStore

STEPS = "step string, value string"
_CUSTOMER = (Column("c_custkey", "INTEGER", unique=True), Column("c_name", "TEXT"), Column("c_nationkey", "INTEGER"), Column("c_acctbal", "FLOAT"), Column("c_mktsegment", "TEXT"))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{checkpoint_folder(spark)}/queries-{uuid.uuid4().hex}"


def outcome(f: Callable[[], Any]) -> str:
    """ok, or the class of the error that was raised."""
    try:
        f()
        return "ok"
    except EngineError as e:
        return type(e).__name__


def steps(spark: SparkSession, rows: list[tuple[str, Any]]) -> DataFrame:
    return spark.createDataFrame([(a, str(b)) for a, b in rows], STEPS)


def _steps_sql(*rows: tuple[str, str]) -> str:
    """rows: (step, SQL expression of its value)."""
    return " UNION ALL ".join(f"SELECT '{a}' AS step, CAST({b} AS VARCHAR) AS value" for a, b in rows)


def _customers(spark: SparkSession, sf_dir: str, path: str | None = None) -> Database:
    db = Database(spark, path)
    db.create_table("customer", _CUSTOMER)
    db.append("customer", load(spark, sf_dir, "customer"))
    return db


# -- storage --
def save_and_reopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A database in memory saved below a path, opened anew, and read; constraints hold on."""
    path = place(spark)
    _customers(spark, sf_dir).save(path)
    return Database.open(spark, path).sql("SELECT c_mktsegment, COUNT(*) AS n, MAX(c_custkey) AS last FROM customer GROUP BY c_mktsegment")


def open_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path without a database opens as an empty one; what is published there is found again."""
    path = place(spark)
    db = Database.open(spark, path)
    rows = [("tables at first", len(db.tables()))]
    db.create_table("nation", [Column("n_nationkey", "INTEGER", primary_key=True), Column("n_name", "TEXT", not_null=True)])
    db.append("nation", load(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    again = Database.open(spark, path)
    rows += [("rows after reopening", again.table("nation").count()), ("primary key after reopening", outcome(lambda: again.execute("INSERT INTO nation VALUES (3, 'AGAIN')")))]
    again.execute("INSERT INTO nation VALUES (99, 'NEW')")
    rows.append(("rows seen by the first", db.table("nation").count()))
    return steps(spark, rows)


def two_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two databases on one path, both opened before either writes: all rows of both stay."""
    path = place(spark)
    a, b = Database(spark, path), Database(spark, path)
    a.create_table("t", [Column("id", "INTEGER"), Column("name", "TEXT")])
    a.append("t", load(spark, sf_dir, "region").select(F.col("r_name").alias("name")))
    b.append("t", load(spark, sf_dir, "nation").select(F.col("n_name").alias("name")))
    a.execute("UPDATE t SET name = 'europe' WHERE name = 'EUROPE'")
    return a.sql("SELECT COUNT(*) AS n, MIN(id) AS lo, MAX(id) AS hi, MAX(name) AS last FROM t")


def create_table_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that a CREATE TABLE statement declares."""
    db = Database(spark)
    db.execute("CREATE TABLE IF NOT EXISTS t (id INTEGER PRIMARY KEY, v VECTOR(3), 2nd VARCHAR NOT NULL UNIQUE, score REAL DEFAULT 1.5, ok BOOL, raw BLOB)")
    db.execute("create table if not exists t (other INT)")
    return spark.createDataFrame([(c.name, c.kind, c.dim, c.primary_key, c.not_null, c.unique, str(c.default)) for c in db.catalog.version("t").columns], "name string, kind string, dim int, pk boolean, required boolean, uniq boolean, preset string")


def drop_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _customers(spark, sf_dir)
    rows = [("before", db.table("customer").count()), ("drop", outcome(lambda: db.execute("DROP TABLE customer")))]
    rows += [("again", outcome(lambda: db.execute("DROP TABLE customer"))), ("if exists", outcome(lambda: db.execute("DROP TABLE IF EXISTS customer")))]
    return steps(spark, [*rows, ("read", outcome(lambda: db.sql("SELECT * FROM customer"))), ("tables", len(db.tables()))])


# -- constraints and errors --
def constraints_refuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole tables appended under constraints that their data break: refused, and nothing is left."""
    users, sales = load(spark, sf_dir, "users"), load(spark, sf_dir, "sales")
    rows = []
    for step, column, data in (
        ("not null", Column("full_name", "TEXT", not_null=True), users.select("full_name")),
        ("unique", Column("email", "TEXT", unique=True), users.select("email")),
        ("primary key null", Column("user_id", "INTEGER", primary_key=True), sales.select("user_id")),
        ("primary key", Column("k", "INTEGER", primary_key=True), users.select(F.col("id").alias("k"))),
        ("dimension", Column("embedding", "VECTOR", 3), users.select("embedding")),
        ("right dimension", Column("embedding", "VECTOR", 4), users.select("embedding")),
    ):
        db = Database(spark)
        db.create_table("t", [column])
        rows += [(step, outcome(lambda: db.append("t", data))), (f"{step}: rows", db.table("t").count())]
    return steps(spark, rows)


def inserts_refuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that do not fit the table change nothing; omitted columns get NULL or their default."""
    db = Database(spark)
    db.execute("CREATE TABLE t (v VECTOR(2), name TEXT, score FLOAT DEFAULT 2)")
    rows = [(step, outcome(lambda: db.execute(sql))) for step, sql in (
        ("unknown column", "INSERT INTO t (nope) VALUES (1)"),
        ("too few values", "INSERT INTO t VALUES ([1,2], 'a')"),
        ("too many values", "INSERT INTO t (name) VALUES ('a', 2)"),
        ("wrong type", "INSERT INTO t (name) VALUES (5)"),
        ("wrong dimension", "INSERT INTO t (v) VALUES ([1,2,3])"),
        ("unknown table", "INSERT INTO nope VALUES (1)"),
        ("positional", "INSERT INTO t VALUES ([1,2], 'a', 1)"),
        ("named", "INSERT INTO t (name) VALUES ('b'), ('c')"),
    )]
    got = db.sql("SELECT COUNT(*) AS n, COUNT(v) AS v, SUM(score) AS s FROM t").first()
    return steps(spark, [*rows, ("rows", got["n"]), ("vectors", got["v"]), ("scores", got["s"])])


def unknown_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark)
    for name in ("nation", "region"):
        db.register(name, load(spark, sf_dir, name))
    queries = {
        "where": "SELECT n_name FROM nation WHERE nope = 1",
        "select": "SELECT nope FROM nation",
        "aggregate": "SELECT SUM(nope) FROM nation",
        "group": "SELECT COUNT(*) FROM nation GROUP BY nope",
        "having": "SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY n_regionkey HAVING nope > 1",
        "order": "SELECT n_name FROM nation ORDER BY nope",
        "join": "SELECT nation.n_name FROM nation JOIN region ON nation.nope = region.r_regionkey",
        "table": "SELECT * FROM nope",
        "after the end": "SELECT n_name FROM nation LIMIT 3 nonsense here",
        "right": "SELECT n_name FROM nation WHERE n_name = 'x'",
    }
    return steps(spark, [(k, outcome(lambda: db.sql(q).collect())) for k, q in queries.items()])


def digit_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark)
    db.register("5regions", load(spark, sf_dir, "region").select(F.col("r_regionkey").alias("1st"), F.col("r_name").alias("2nd")))
    return db.sql("SELECT 2nd, 5regions.1st AS k FROM 5regions WHERE 1st >= 1 AND 5regions.1st < 4")


# -- the direct interfaces --
def _product_vectors(spark: SparkSession, sf_dir: str) -> list:
    """The products (600 rows, fixed) that have a vector."""
    return load(spark, sf_dir, "products").where("embedding IS NOT NULL").orderBy("sku").collect()


def insert_batch_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One atomic insert of vectors with metadata, then one row more; ids run on."""
    rows = _product_vectors(spark, sf_dir)
    db = Database(spark)
    db.create_table("p", [Column("id", "INTEGER"), Column("vec", "VECTOR", 4), Column("sku", "TEXT"), Column("price", "FLOAT", default=-1.0)])
    db.insert_batch_direct("p", [r["embedding"] for r in rows], [{"sku": r["sku"], "price": r["price"]} for r in rows])
    db.insert_direct("p", [1.0, 2.0, 3.0, 4.0], {"sku": "one more"})
    return db.sql("SELECT id, sku, price FROM p")


def insert_batch_atomic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch with one vector of a wrong dimension is refused whole."""
    rows = _product_vectors(spark, sf_dir)
    db = Database(spark)
    db.create_table("p", [Column("vec", "VECTOR", 4)])
    vectors = [r["embedding"] for r in rows]
    out = [("bad", outcome(lambda: db.insert_batch_direct("p", [*vectors, [1.0]]))), ("rows after it", db.table("p").count()), ("good", outcome(lambda: db.insert_batch_direct("p", vectors)))]
    return steps(spark, [*out, ("rows", db.table("p").count())])


def batch_inserter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows collected and inserted by sevens."""
    db = Database(spark)
    db.execute("CREATE TABLE n (id INTEGER, k INTEGER, name TEXT)")
    with BatchInserter(db, "n", ("k", "name"), 7) as b:
        for r in load(spark, sf_dir, "nation").orderBy("n_nationkey").collect():
            b.add(r["n_nationkey"], r["n_name"])
    return db.sql("SELECT id, k, name FROM n")


def statement_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three statements through a cache of two: the one used last stays."""
    db, cache = Database(spark), StatementCache(2)
    db.register("nation", load(spark, sf_dir, "nation"))
    sql = [f"SELECT COUNT(*) AS n FROM nation WHERE n_regionkey {op} ?" for op in ("=", "<", ">")]
    found = [cache.execute(db, s, 2).rows()[0]["n"] for s in (*sql, sql[1])]
    kept = cache.get(sql[1])
    return steps(spark, [*((f"call {n}", v) for n, v in enumerate(found, 1)), ("kept", len(cache)), ("same", str(cache.get(sql[1]) is kept).lower())])


def metric_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric of one's own, on columns and against a query: the sum of absolute differences."""
    distance.register(
        "manhattan",
        lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x),
        lambda x, q: np.abs(x[:, None] - q[None]).sum(2),
    )
    base = load(spark, sf_dir, "products")
    near = similarity.nearest(base, "embedding", [0.5, -1.0, 0.25, 2.0], 20, "manhattan", tie="sku")
    again = distance.between("manhattan", F.col("embedding"), F.array(*[F.lit(x) for x in (0.5, -1.0, 0.25, 2.0)]))
    return near.select("sku", F.round("distance", 5).alias("distance"), F.round(again, 5).alias("between"))


def client_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every method of the client."""
    c = Client(spark)
    c.create_table("n", 2, {"name": str, "key": int})
    data = load(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    ids = c.insert_batch([[float(r["n_nationkey"]), 1.0] for r in data], [{"name": r["n_name"], "key": r["n_regionkey"]} for r in data])
    rows = [("ids", sum(ids)), ("one more", c.insert([-5.0, 0.0], {"name": "NOWHERE"})), ("schema", ",".join(f"{k}:{v}" for k, v in c.schema().columns.items())), ("dimension", c.schema().vector_dim)]
    hit = c.search([6.9, 1.0], 1)[0]
    rows += [("nearest", hit.metadata["name"]), ("distance", round(hit.distance, 4)), ("filtered", c.search([6.9, 1.0], 1, filter_="key = 0")[0].metadata["key"])]
    rows += [("update", c.update(3, {"name": "THIRD"})), ("get", c.get(3)["name"]), ("delete", c.delete(4)), ("gone", c.get(4)), ("tables", ",".join(c.list_tables()))]
    rows += [("sql", c.raw_sql("SELECT COUNT(*) AS n FROM n WHERE key = ?", 2).rows()[0]["n"]), ("delete all", c.delete_all())]
    c.drop_table("n")
    rows.append(("dropped", len(c.list_tables())))
    c.close()
    return steps(spark, [*rows, ("closed", outcome(lambda: c.list_tables()))])


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ten tools."""
    path, t = place(spark), Tools(spark).all()
    key = load(spark, sf_dir, "nation").agg(F.max("n_nationkey")).first()[0]
    rows = [("status", t["status"]()["open"]), ("too early", "error" in t["list_tables"]()), ("create_database", len(t["create_database"](path)["tables"]))]
    rows += [("create_table", t["create_table"]("a", 2, {"name": "TEXT"})["vector_dim"]), ("insert_vector", t["insert_vector"]([0.0, float(key)], {"name": "x"})["id"])]
    rows += [("batch_insert", t["batch_insert"]([[1.0, 0.0], [2.0, 0.0]])["count"]), ("search_similar", t["search_similar"]([0.0, float(key)], 1)["results"][0]["metadata"]["name"])]
    rows += [("execute_sql", t["execute_sql"]("SELECT COUNT(*) AS n FROM a")["rows"][0]["n"]), ("wrong dimension", "error" in t["insert_vector"]([1.0]))]
    t["create_table"]("b", 3)
    rows += [("use_table", t["use_table"]("a")["table"]), ("status after", t["status"]()["current_table"]), ("open_database", len(t["open_database"](path)["tables"])), ("list_tables", ",".join(t["list_tables"]()["tables"]))]
    return steps(spark, [(a, str(b).lower()) for a, b in rows])


def shell_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session of the shell: the lines it prints for changes and errors."""
    path, out = place(spark), io.StringIO()
    s = Shell(spark, stdout=out)
    for line in (f".create {path}", "CREATE TABLE t (v VECTOR(2), name TEXT)", "INSERT INTO t VALUES ([1,2],'a'), ([3,4],'b')", "UPDATE t SET name = 'c' WHERE name = 'b'", ".tables", "SELECT nope FROM t", f".open {path}", "DELETE FROM t", "DROP TABLE t", ".tables", ".nope"):
        s.onecmd(line)
    said = [x.replace(path, "PATH") for x in out.getvalue().splitlines()]
    return steps(spark, [(f"line {n:02d}", x) for n, x in enumerate(said, 1)])


def store_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored vector store: inserts, reads, changes, its index and its centroid."""
    path = place(spark)
    s = VectorStore(spark, 4, "euclidean", path)
    vectors = [r["embedding"] for r in _product_vectors(spark, sf_dir)]
    rows = [("empty", str(s.is_empty()).lower()), ("ids", sum(s.insert_batch(vectors))), ("bad", outcome(lambda: s.insert([1.0]))), ("far", s.insert([900.0, 0.0, 0.0, 0.0]) - len(vectors))]
    s = VectorStore.open(spark, path)
    rows += [("reopened", len(s)), ("nearest", s.query([901.0, 0, 0, 0], 1).first()["id"] - len(vectors)), ("probed", s.query_with_probes([901.0, 0, 0, 0], 1).first()["id"] - len(vectors))]
    rows += [("deleted", str(s.delete(len(vectors) + 1)).lower()), ("again", str(s.delete(len(vectors) + 1)).lower()), ("updated", str(s.update(1, [5.0] * 4)).lower()), ("read", s.get(1)[0])]
    s.update(1, list(vectors[0]))
    return steps(spark, [*rows, ("centroid", f"{s.centroid()[0]:.4f}")])


# -- transactions --
def transaction_fails_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit whose last change is refused leaves the table as it was."""
    db = _customers(spark, sf_dir)
    c = Connection(db)
    c.begin()
    c.execute("DELETE FROM customer WHERE c_acctbal < 0")
    c.execute("UPDATE customer SET c_custkey = 5")
    failed = outcome(c.commit)
    again = [outcome(c.commit), outcome(lambda: (c.begin(), c.begin()))]
    c.rollback()
    return steps(spark, [("commit", failed), ("rows", db.table("customer").count()), ("commit without begin", again[0]), ("begin twice", again[1])])


def pool_of_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six threads insert through pooled connections: no id is left out or given twice."""
    shared = ConcurrentDatabase(spark)
    shared.with_write(lambda db: db.execute("CREATE TABLE t (id INTEGER, thread INTEGER)"))
    pool, errors = DatabasePool(shared), []

    def work(n: int) -> None:
        c = pool.get()
        try:
            for _ in range(3):
                c.execute("INSERT INTO t (thread) VALUES (?), (?)", [n, n])
        except EngineError as e:
            errors.append(e)
        finally:
            pool.put(c)

    threads = [threading.Thread(target=work, args=(n,)) for n in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return shared.with_read(lambda db: db.sql("SELECT thread, COUNT(*) AS n FROM t GROUP BY thread")).withColumn("ids", F.lit(shared.with_read(lambda db: db.table("t").select("id").distinct().count())))


def stream_ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of the events appended to a stored table, exactly once."""
    path = place(spark)
    db = Database(spark, path)
    db.create_table("events", [Column("event_id", "INTEGER"), Column("event_type", "TEXT"), Column("value", "FLOAT")])
    source = spark.readStream.schema(load(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event*.parquet")
    for n in range(2):  # the second run finds nothing new
        ingest(db, "events", source.select("event_id", "event_type", "value"), f"{path}-progress", availableNow=True).awaitTermination()
    return db.sql("SELECT event_type, COUNT(*) AS n, MAX(value) AS top FROM events GROUP BY event_type")


# -- approximate search --
_INDEXES: dict[tuple, IVFIndex | LSHIndex] = {}


def stored_index(spark: SparkSession, sf_dir: str, kind: str) -> IVFIndex | LSHIndex:
    """The index of the embeddings, built and stored at its first use in a session."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _INDEXES:
        base, path = load(spark, sf_dir, "embeddings"), place(spark)
        _INDEXES[key] = IVFIndex.build(base, "embedding", path, IndexConfig()) if kind == "ivf" else LSHIndex.build(base, "embedding", path, IndexConfig(n_bits=6, n_tables=12))
    return _INDEXES[key]


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return [float(x) for x in load(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]]


def ann_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = stored_index(spark, sf_dir, "ivf")
    return type(ix).open(spark, ix.path).search(_query_vector(spark, sf_dir), 10, tie=["vec_id"]).select("vec_id", "label", "distance")


def ann_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = stored_index(spark, sf_dir, "lsh")
    return type(ix).open(spark, ix.path).search(_query_vector(spark, sf_dir), 10, tie=["vec_id"]).select("vec_id", "label", "distance")


def ann_ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 10 of the inverted lists, for every vec_id divisible by 20 against the exact search over all rows."""
    base = load(spark, sf_dir, "embeddings")
    queries = base.where("vec_id % 20 = 0")
    exact = similarity.nearest_for_each(queries, base, "vec_id", "vec_id", "embedding", "embedding", 10, exclude_self=True)
    found = stored_index(spark, sf_dir, "ivf").search_each(queries, "vec_id", "embedding", "vec_id", 10, exclude_self=True)
    m = accuracy.measures(found, exact, 10)
    return m.select((F.col("recall") >= 0.9).alias("recall_of_0_9"), (F.col("mrr") >= 0.9).alias("mrr_of_0_9"), (F.col("precision") >= 0.9).alias("precision_of_0_9"))


def ann_ivf_all_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With all lists probed the index gives what the exact search gives."""
    base = load(spark, sf_dir, "embeddings")
    ix = stored_index(spark, sf_dir, "ivf")
    found = ix.search_each(base.where("vec_id % 20 = 0"), "vec_id", "embedding", "vec_id", 3, len(ix.centroids), "cosine", exclude_self=True)
    return found.select("query_id", "neighbour_id", F.round("distance", 6).alias("distance"), "rank")


_DECLARED = (("id", "INTEGER", 0, True, False, False, "None"), ("v", "VECTOR", 3, False, False, False, "None"), ("2nd", "TEXT", 0, False, True, True, "None"), ("score", "FLOAT", 0, False, False, False, "1.5"), ("ok", "BOOLEAN", 0, False, False, False, "None"), ("raw", "BLOB", 0, False, False, False, "None"))
_VECTORS = "(SELECT count(*) FROM products WHERE embedding IS NOT NULL)"
_USERS = "(SELECT count(*) FROM users)"
_COUNT = "(SELECT count(*) FROM customer)"
_refused = lambda bad, error: f"CASE WHEN {bad} THEN '{error}' ELSE 'ok' END"
_left = lambda bad, table: f"CASE WHEN {bad} THEN 0 ELSE (SELECT count(*) FROM {table}) END"
_NULL_NAME = "EXISTS (SELECT 1 FROM users WHERE full_name IS NULL)"
_SAME_MAIL = "EXISTS (SELECT 1 FROM users WHERE email IS NOT NULL GROUP BY email HAVING count(*) > 1)"
_NULL_USER = "EXISTS (SELECT 1 FROM sales WHERE user_id IS NULL)"
_WRONG = "EXISTS (SELECT 1 FROM users WHERE len(embedding) <> 3)"


def _stats(a: str, b: str) -> str:
    return f"SELECT query_id, neighbour_id, round(d, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, neighbour_id)::int AS rank FROM ({a})) WHERE rank <= {b}"


_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: p[1]::double * p[2]::double))"
_COSINE = f"1 - {_DOT.format('q.embedding', 'b.embedding')} / (sqrt({_DOT.format('q.embedding', 'q.embedding')}) * sqrt({_DOT.format('b.embedding', 'b.embedding')}))"
_MANHATTAN = "list_sum(list_transform(list_zip(embedding, [0.5, -1.0, 0.25, 2.0]), lambda p: abs(p[1]::double - p[2]::double)))"

#: name: (query, SQL twin or None)
CHANGES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "save_and_reopen": (save_and_reopen, "SELECT c_mktsegment, count(*) AS n, max(c_custkey)::bigint AS last FROM customer GROUP BY 1"),
    "open_or_create": (
        open_or_create,
        _steps_sql(("tables at first", "0"), ("rows after reopening", "(SELECT count(*) FROM nation)"), ("primary key after reopening", "'ConstraintError'"), ("rows seen by the first", "(SELECT count(*) + 1 FROM nation)")),
    ),
    "two_writers": (two_writers, "SELECT r + n AS n, 1::bigint AS lo, r + n AS hi, 'europe' AS last FROM (SELECT count(*) AS r FROM region), (SELECT count(*) AS n FROM nation)"),
    "create_table_text": (create_table_text, " UNION ALL ".join(f"SELECT '{a}' AS name, '{b}' AS kind, {c} AS dim, {d} AS pk, {e} AS required, {f} AS uniq, '{g}' AS preset" for a, b, c, d, e, f, g in _DECLARED)),
    "drop_table": (drop_table, _steps_sql(("before", _COUNT), ("drop", "'ok'"), ("again", "'TableNotFoundError'"), ("if exists", "'ok'"), ("read", "'TableNotFoundError'"), ("tables", "0"))),
    "constraints_refuse": (
        constraints_refuse,
        _steps_sql(
            ("not null", _refused(_NULL_NAME, "ConstraintError")), ("not null: rows", _left(_NULL_NAME, "users")),
            ("unique", _refused(_SAME_MAIL, "ConstraintError")), ("unique: rows", _left(_SAME_MAIL, "users")),
            ("primary key null", _refused(_NULL_USER, "ConstraintError")), ("primary key null: rows", _left(_NULL_USER, "sales")),
            ("primary key", "'ok'"), ("primary key: rows", _USERS),
            ("dimension", _refused(_WRONG, "DimensionMismatchError")), ("dimension: rows", _left(_WRONG, "users")),
            ("right dimension", "'ok'"), ("right dimension: rows", _USERS),
        ),
    ),
    "inserts_refuse": (
        inserts_refuse,
        _steps_sql(
            *((x, "'QueryError'") for x in ("unknown column", "too few values", "too many values", "wrong type")), ("wrong dimension", "'DimensionMismatchError'"), ("unknown table", "'TableNotFoundError'"),
            ("positional", "'ok'"), ("named", "'ok'"), ("rows", "3"), ("vectors", "1"), ("scores", "5.0"),
        ),
    ),
    "unknown_columns": (unknown_columns, _steps_sql(*((x, "'QueryError'") for x in ("where", "select", "aggregate", "group", "having", "order", "join")), ("table", "'TableNotFoundError'"), ("after the end", "'ParseError'"), ("right", "'ok'"))),
    "digit_identifiers": (digit_identifiers, 'SELECT r_name AS "2nd", r_regionkey AS k FROM region WHERE r_regionkey BETWEEN 1 AND 3'),
    "insert_batch_direct": (insert_batch_direct, f"SELECT row_number() OVER (ORDER BY sku) AS id, sku, price FROM products WHERE embedding IS NOT NULL UNION ALL SELECT {_VECTORS} + 1, 'one more', -1.0"),
    "insert_batch_atomic": (insert_batch_atomic, _steps_sql(("bad", "'DimensionMismatchError'"), ("rows after it", "0"), ("good", "'ok'"), ("rows", _VECTORS))),
    "batch_inserter": (batch_inserter, "SELECT row_number() OVER (ORDER BY n_nationkey) AS id, n_nationkey::bigint AS k, n_name AS name FROM nation"),
    "statement_cache": (
        statement_cache,
        _steps_sql(*((f"call {n}", f"(SELECT count(*) FROM nation WHERE n_regionkey {op} 2)") for n, op in enumerate(("=", "<", ">", "<"), 1)), ("kept", "2"), ("same", "'true'")),
    ),
    "metric_registry": (metric_registry, f"SELECT sku, round({_MANHATTAN}, 5) AS distance, round({_MANHATTAN}, 5) AS between FROM products WHERE embedding IS NOT NULL ORDER BY {_MANHATTAN}, sku LIMIT 20"),
    "client_calls": (
        client_calls,
        _steps_sql(
            ("ids", "(SELECT count(*) * (count(*) + 1) // 2 FROM nation)"), ("one more", "(SELECT count(*) + 1 FROM nation)"), ("schema", "'embedding:VECTOR,name:TEXT,key:INTEGER'"), ("dimension", "2"),
            ("nearest", "(SELECT n_name FROM nation WHERE n_nationkey = 7)"), ("distance", "0.01"), ("filtered", "0"), ("update", "1"), ("get", "'THIRD'"), ("delete", "1"), ("gone", "'None'"), ("tables", "'n'"),
            ("sql", "(SELECT count(*) FROM nation WHERE n_regionkey = 2 AND n_nationkey <> 3)"), ("delete all", "(SELECT count(*) FROM nation)"), ("dropped", "0"), ("closed", "'ConnectionClosedError'"),
        ),
    ),
    "tool_calls": (
        tool_calls,
        _steps_sql(
            ("status", "'false'"), ("too early", "'true'"), ("create_database", "0"), ("create_table", "2"), ("insert_vector", "1"), ("batch_insert", "2"), ("search_similar", "'x'"), ("execute_sql", "3"),
            ("wrong dimension", "'true'"), ("use_table", "'a'"), ("status after", "'a'"), ("open_database", "2"), ("list_tables", "'a,b'"),
        ),
    ),
    "shell_session": (
        shell_session,
        _steps_sql(*((f"line {n:02d}", f"'{x}'") for n, x in enumerate(("Opened PATH", "create t", "insert t: 2 row(s)", "update t: 1 row(s)", "t", "Error: Column ''nope'' not found", "Opened PATH", "delete t: 2 row(s)", "drop t", "No tables", "Unknown command .nope"), 1))),
    ),
    "store_calls": (
        store_calls,
        _steps_sql(
            ("empty", "'true'"), ("ids", f"{_VECTORS} * ({_VECTORS} + 1) // 2"), ("bad", "'DimensionMismatchError'"), ("far", "1"), ("reopened", f"{_VECTORS} + 1"), ("nearest", "1"), ("probed", "1"),
            ("deleted", "'true'"), ("again", "'false'"), ("updated", "'true'"), ("read", "5.0"), ("centroid", "(SELECT printf('%.4f', avg(embedding[1]::double)) FROM products WHERE embedding IS NOT NULL)"),
        ),
    ),
    "transaction_fails_whole": (transaction_fails_whole, _steps_sql(("commit", "'ConstraintError'"), ("rows", _COUNT), ("commit without begin", "'TransactionError'"), ("begin twice", "'TransactionError'"))),
    "pool_of_threads": (pool_of_threads, "SELECT range AS thread, 6::bigint AS n, 36 AS ids FROM range(6)"),
    "stream_ingested": (stream_ingested, "SELECT event_type, count(*) AS n, max(value) AS top FROM events GROUP BY 1"),
    "ann_ivf": (ann_ivf, None),
    "ann_lsh": (ann_lsh, None),
    "ann_ivf_recall": (ann_ivf_recall, "SELECT true AS recall_of_0_9, true AS mrr_of_0_9, true AS precision_of_0_9"),
    "ann_ivf_all_lists": (ann_ivf_all_lists, _stats(f"SELECT q.vec_id AS query_id, b.vec_id AS neighbour_id, {_COSINE} AS d FROM embeddings q JOIN embeddings b ON q.vec_id % 20 = 0 AND q.vec_id <> b.vec_id", "3")),
}

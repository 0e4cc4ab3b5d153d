"""One query per operator, over whole tables, with its SQL twin for DuckDB (changes: queries_changes.py).

``DIALECT`` holds statements of the dialect (run by the parser and planner); ``QUERIES`` all queries
as (spark, sf_dir) -> DataFrame; ``ORACLE`` the twins. The twins state what the dialect means: NULL
equals NULL, LIKE in any case, AND and OR from left to right, SUM of nothing 0.0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .client import Client
from .database import Database
from .functions import distance
from .operators import accuracy, similarity
from .plans.ast import Delete, Insert
from .prepared import PreparedStatement
from .queries_changes import CHANGES
from .sources.constraints import violations
from .transactions import Connection
from .types import ROW_ID, Column
from .vectorstore import VectorStore

Query = Callable[[SparkSession, str], DataFrame]
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "docs", "users", "products", "accounts", "sales", "benchmark")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Lazy(Database):
    """A database whose tables are the Parquet files of a folder, read when a statement names them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(spark)
        self.sf_dir = sf_dir

    def frame(self, name: str, state=None) -> DataFrame:
        if name not in self.views and name in TABLES:
            self.register(name, load(self.spark, self.sf_dir, name))
        return super().frame(name, state)


#: name -> (statement of the dialect, twin; None: the statement itself)
DIALECT: dict[str, tuple[str, str | None]] = {
    "scan_project": ("SELECT c_name, c_acctbal FROM customer", None),
    "select_star": ("SELECT * FROM customer", None),
    "filter_eq": ("SELECT id, category FROM docs WHERE category = 'tutorial'", None),
    "filter_eq_null": ("SELECT id, category FROM docs WHERE category = NULL", "SELECT id, category FROM docs WHERE category IS NULL"),
    "filter_ne": ("SELECT o_orderkey FROM orders WHERE o_orderstatus != 'F'", None),
    "ne_with_null": ("SELECT id, category FROM docs WHERE category <> 'tutorial'", "SELECT id, category FROM docs WHERE category IS DISTINCT FROM 'tutorial'"),
    "filter_lt": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 10", None),
    "filter_le": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity <= 10", None),
    "filter_gt": ("SELECT sale_id, amount FROM sales WHERE amount > 100.5", None),
    "filter_ge": ("SELECT sale_id, user_id FROM sales WHERE user_id >= 50", None),
    "filter_type_mismatch": ("SELECT c_custkey FROM customer WHERE c_custkey != 'abc' AND c_name != 5", "SELECT c_custkey FROM customer"),
    "filter_and_or_left_fold": (
        "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority = '1-URGENT' AND o_totalprice > 100000",
        "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_orderpriority = '1-URGENT') AND o_totalprice > 100000",
    ),
    "like_prefix": ("SELECT id, category FROM docs WHERE category LIKE 'TUTO%'", "SELECT id, category FROM docs WHERE category ILIKE 'TUTO%'"),
    "like_suffix": ("SELECT id, category FROM docs WHERE category LIKE '%Al'", "SELECT id, category FROM docs WHERE category ILIKE '%Al'"),
    "like_contains": ("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%e%r%'", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%e%r%'"),
    "like_wildcard": ("SELECT id, category FROM docs WHERE category LIKE '_log'", "SELECT id, category FROM docs WHERE category ILIKE '_log'"),
    "like_all": ("SELECT id FROM docs WHERE category LIKE '%'", "SELECT id FROM docs WHERE category IS NOT NULL"),
    "not_like": ("SELECT id, category FROM docs WHERE category NOT LIKE '%o%'", "SELECT id, category FROM docs WHERE NOT coalesce(category ILIKE '%o%', false)"),
    "in_list": ("SELECT sale_id, category FROM sales WHERE user_id IN (1, 7, 9)", None),
    "in_with_null": ("SELECT id, category FROM docs WHERE category IN ('faq', NULL)", "SELECT id, category FROM docs WHERE category = 'faq' OR category IS NULL"),
    "not_in_null": ("SELECT id, category FROM docs WHERE category NOT IN ('faq', 'blog')", "SELECT id, category FROM docs WHERE category IS NULL OR category NOT IN ('faq', 'blog')"),
    "between": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 5 AND 8", None),
    "not_between": ("SELECT sale_id, amount FROM sales WHERE amount NOT BETWEEN 10 AND 500", "SELECT sale_id, amount FROM sales WHERE NOT coalesce(amount BETWEEN 10 AND 500, false)"),
    "is_null": ("SELECT sale_id, amount FROM sales WHERE amount IS NULL", None),
    "is_not_null": ("SELECT account_id, holder FROM accounts WHERE holder IS NOT NULL", None),
    "order_asc": ("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal ASC, c_custkey", None),
    "order_desc_nulls": ("SELECT id, category FROM docs ORDER BY category DESC, id", "SELECT id, category FROM docs ORDER BY category DESC NULLS LAST, id"),
    "topk": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", None),
    "limit_offset": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20 OFFSET 30", None),
    "distinct": ("SELECT DISTINCT category FROM docs", None),
    "distinct_order_limit": ("SELECT DISTINCT category, origin FROM docs ORDER BY category, origin LIMIT 15", "SELECT DISTINCT category, origin FROM docs ORDER BY category NULLS FIRST, origin NULLS FIRST LIMIT 15"),
    "agg_count": ("SELECT COUNT(*) AS n, COUNT(amount) AS amounts FROM sales", None),
    "agg_sum": ("SELECT SUM(l_quantity) AS s FROM lineitem", "SELECT coalesce(sum(l_quantity::double), 0.0) AS s FROM lineitem"),
    "agg_sum_integer": ("SELECT SUM(balance) AS s FROM accounts", "SELECT coalesce(sum(balance::double), 0.0) AS s FROM accounts"),
    "agg_avg": ("SELECT AVG(l_discount) AS a FROM lineitem", "SELECT round(avg(l_discount), 9) AS a FROM lineitem"),
    "agg_min_max": ("SELECT MIN(score) AS lo, MAX(score) AS hi, MIN(category) AS first, MAX(category) AS last FROM docs", None),
    "agg_empty_input": (
        "SELECT COUNT(*) AS n, SUM(amount) AS s, AVG(amount) AS a, MIN(sku) AS m FROM sales WHERE sale_id < 0",
        "SELECT count(*) AS n, coalesce(sum(amount), 0.0) AS s, avg(amount) AS a, min(sku) AS m FROM sales WHERE sale_id < 0",
    ),
    "group_by_one": ("SELECT event_type, COUNT(*) AS n, MIN(value) AS lo, MAX(value) AS hi FROM events GROUP BY event_type", None),
    "group_by_multi": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    "group_null_key": ("SELECT category, COUNT(*) AS n, COUNT(score) AS scored FROM docs GROUP BY category", None),
    "group_default_names": ("SELECT user_id, COUNT(*), MAX(amount) FROM sales GROUP BY user_id", "SELECT user_id, count(*) AS count, max(amount) AS max_amount FROM sales GROUP BY user_id"),
    "having_alias": ("SELECT category, COUNT(*) AS n FROM docs GROUP BY category HAVING n > 20", "SELECT category, count(*) AS n FROM docs GROUP BY category HAVING count(*) > 20"),
    "having_expression": (
        "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING SUM(o_totalprice) > 500000 AND n >= 3",
        "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 500000 AND count(*) >= 3",
    ),
    "group_order_limit": ("SELECT user_id, COUNT(*) AS n FROM sales GROUP BY user_id ORDER BY n DESC, user_id LIMIT 12 OFFSET 2", "SELECT user_id, count(*) AS n FROM sales GROUP BY user_id ORDER BY n DESC, user_id NULLS FIRST LIMIT 12 OFFSET 2"),
    "join_group": (
        "SELECT customer.c_mktsegment AS segment, COUNT(*) AS n, MAX(orders.o_totalprice) AS top FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey GROUP BY customer.c_mktsegment",
        "SELECT c_mktsegment AS segment, count(*) AS n, max(o_totalprice) AS top FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    ),
    "join_inner": (
        "SELECT orders.o_orderkey AS k, customer.c_name AS name FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey",
        "SELECT o_orderkey AS k, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey",
    ),
    "join_left": (
        "SELECT sales.sale_id AS s, users.full_name AS name FROM sales LEFT JOIN users ON sales.user_id = users.id",
        "SELECT sale_id AS s, full_name AS name FROM sales LEFT JOIN users ON user_id = users.id",
    ),
    "join_right": (
        "SELECT accounts.account_id AS a, users.id AS u FROM accounts RIGHT JOIN users ON users.id = accounts.user_id",
        "SELECT account_id AS a, users.id AS u FROM accounts RIGHT JOIN users ON user_id = users.id",
    ),
    "join_null_keys": (
        "SELECT accounts.account_id AS a, sales.sale_id AS s, sales.user_id AS u FROM accounts JOIN sales ON accounts.user_id = sales.user_id",
        "SELECT account_id AS a, sale_id AS s, sales.user_id AS u FROM accounts JOIN sales ON accounts.user_id IS NOT DISTINCT FROM sales.user_id",
    ),
    "join_number_kinds": (
        "SELECT part.p_partkey AS p, lineitem.l_orderkey AS o FROM part JOIN lineitem ON part.p_size = lineitem.l_quantity WHERE part.p_partkey <= 20",
        "SELECT p_partkey AS p, l_orderkey AS o FROM part JOIN lineitem ON p_size = l_quantity WHERE p_partkey <= 20",
    ),
    "join_where_order_limit": (
        "SELECT orders.o_orderkey AS k, customer.c_name AS name, orders.o_totalprice AS price FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey WHERE customer.c_mktsegment = 'BUILDING' AND orders.o_totalprice > 1000 ORDER BY orders.o_totalprice DESC, k LIMIT 30 OFFSET 5",
        "SELECT o_orderkey AS k, c_name AS name, o_totalprice AS price FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 1000 ORDER BY o_totalprice DESC, k LIMIT 30 OFFSET 5",
    ),
    "join_star": (
        "SELECT * FROM nation JOIN region ON nation.n_regionkey = region.r_regionkey",
        'SELECT n_nationkey AS "nation.n_nationkey", n_name AS "nation.n_name", n_regionkey AS "nation.n_regionkey", r_regionkey AS "region.r_regionkey", r_name AS "region.r_name" FROM nation JOIN region ON n_regionkey = r_regionkey',
    ),
}

_PAIRS = "list_transform(list_zip({a}, {b}), lambda p: {e})"


def _sum(a: str, b: str, e: str) -> str:
    return f"list_sum({_PAIRS.format(a=a, b=b, e=e)})"


def _l2(a: str, b: str) -> str:
    return _sum(a, b, "(p[1]::double - p[2]::double) * (p[1]::double - p[2]::double)")


def _product(a: str, b: str) -> str:
    return _sum(a, b, "p[1]::double * p[2]::double")


def _cos(a: str, b: str) -> str:
    n = f"(sqrt({_product(a, a)}) * sqrt({_product(b, b)}))"
    return f"CASE WHEN {n} = 0 THEN 0.0 ELSE 1 - {_product(a, b)} / {n} END"


_Q = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    row = load(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row[0]] if row else []


def _knn(metric: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = load(spark, sf_dir, "embeddings")
        found = similarity.nearest(base, "embedding", query_vector(spark, sf_dir), 10, metric, tie="vec_id")
        return found.select("vec_id", "label", F.round("distance", 6).alias("distance"))

    return run


def _knn_sql(expression: str, where: str = "") -> str:
    return f"SELECT vec_id, label, round({expression}, 6) AS distance FROM embeddings {where} ORDER BY {expression}, vec_id LIMIT 10"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SIMILARITY in the dialect: the ten embeddings nearest to that of vec_id 0."""
    q = PreparedStatement("SELECT vec_id, label FROM embeddings WHERE embedding SIMILARITY ? LIMIT 10").bind(query_vector(spark, sf_dir))
    found = Lazy(spark, sf_dir).run(q).frame
    return found.select("vec_id", "label", F.round("distance", 6).alias("distance"))


def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = PreparedStatement("SELECT vec_id, label FROM embeddings WHERE label IN (1, 3, 5) AND embedding SIMILARITY ? LIMIT 10").bind(query_vector(spark, sf_dir))
    return Lazy(spark, sf_dir).run(q).frame.select("vec_id", "label", F.round("distance", 6).alias("distance"))


def knn_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similarity.nearest_per_group(load(spark, sf_dir, "embeddings"), "embedding", query_vector(spark, sf_dir), "label", 3, tie=["vec_id"])
    return found.select("label", "rank", "vec_id", F.round("distance", 6).alias("distance"))


def _twenty(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base = load(spark, sf_dir, "embeddings")
    return base.where("vec_id % 20 = 0"), base


def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest others for every embedding whose id is divisible by 20, against all."""
    queries, base = _twenty(spark, sf_dir)
    found = similarity.nearest_for_each(queries, base, "vec_id", "vec_id", "embedding", "embedding", 5, "cosine", exclude_self=True)
    return found.select("query_id", "neighbour_id", F.round("distance", 6).alias("distance"), "rank")


_BATCH = f"""SELECT q.vec_id AS query_id, b.vec_id AS neighbour_id, {_cos('q.embedding', 'b.embedding')} AS d
    FROM embeddings q JOIN embeddings b ON q.vec_id % 20 = 0 AND q.vec_id <> b.vec_id"""


def distance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users against products, squared Euclidean; vectors that are null have no distance."""
    users = load(spark, sf_dir, "users").where("id % 20 = 0").select("id", "embedding")
    d = similarity.distance_matrix(users, load(spark, sf_dir, "products"), "id", "sku", "embedding", "embedding")
    return d.select(F.col("left_id").alias("id"), F.col("right_id").alias("sku"), F.round("distance", 5).alias("distance"))


def distance_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three metrics between two vector columns: accounts and the vectors of their users, cut to two entries."""
    a, u = load(spark, sf_dir, "accounts"), load(spark, sf_dir, "users")
    both = a.join(u.select(F.col("id").alias("user_id"), F.slice("embedding", 1, 2).alias("v")), "user_id")
    return both.where("embedding is not null and v is not null").select(
        "account_id", *[F.round(distance.between(m, F.col("embedding"), F.col("v")), 6).alias(m) for m in ("euclidean", "cosine", "dot")]
    )


def centroid_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = similarity.centroid(load(spark, sf_dir, "embeddings"), "embedding", "label")
    return c.select("label", F.posexplode("centroid").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("mean"))


def _approximate(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A stand-in for an approximate result that SQL can state: the exact one without every third rank."""
    queries, base = _twenty(spark, sf_dir)
    exact = similarity.nearest_for_each(queries, base, "vec_id", "vec_id", "embedding", "embedding", 9, "cosine", exclude_self=True)
    return exact.where("rank % 3 <> 1"), exact


def accuracy_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, exact = _approximate(spark, sf_dir)
    m = accuracy.measures(found, exact, 9)
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


def distance_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours by the dot product against those by the cosine: unit vectors make them the same."""
    queries, base = _twenty(spark, sf_dir)
    a, b = (similarity.nearest_for_each(queries, base, "vec_id", "vec_id", "embedding", "embedding", 5, m, exclude_self=True) for m in ("dot", "cosine"))
    return accuracy.distance_error(a, b, 5).select(F.round("distance_error", 6).alias("distance_error"))


_CUSTOMER = (Column("c_custkey", "INTEGER", unique=True), Column("c_name", "TEXT"), Column("c_nationkey", "INTEGER"), Column("c_acctbal", "FLOAT"), Column("c_mktsegment", "TEXT"))


def _customers(spark: SparkSession, sf_dir: str) -> Database:
    db = Database(spark)
    db.create_table("customer", _CUSTOMER)
    db.append("customer", load(spark, sf_dir, "customer"))
    return db


def update_then_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _customers(spark, sf_dir)
    db.execute("UPDATE customer SET c_acctbal = 0.0, c_mktsegment = 'CLOSED' WHERE c_acctbal < 0 OR c_mktsegment = 'MACHINERY'")
    return db.sql("SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")


def delete_then_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _customers(spark, sf_dir)
    db.execute("DELETE FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal BETWEEN 0 AND 5000")
    return db.sql("SELECT c_mktsegment, COUNT(*) AS n, SUM(c_acctbal) AS s FROM customer GROUP BY c_mktsegment").withColumn("s", F.round("s", 2))


def insert_auto_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows appended to a table with a column id: ids run from 1 without gaps, whatever was given."""
    db = Database(spark)
    db.create_table("nations", [Column("id", "INTEGER"), Column("n_name", "TEXT")])
    db.append("nations", load(spark, sf_dir, "nation").select("n_name"))
    db.execute("INSERT INTO nations (id, n_name) VALUES (77, 'NOWHERE'), (78, 'ELSEWHERE')")
    return db.sql("SELECT COUNT(*) AS n, MIN(id) AS lo, MAX(id) AS hi, MAX(n_name) AS last FROM nations")


def insert_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark)
    db.create_table("t", [Column("r_regionkey", "INTEGER"), Column("r_name", "TEXT"), Column("state", "TEXT", default="new")])
    db.append("t", load(spark, sf_dir, "region"))
    return db.sql("SELECT r_regionkey, r_name, state FROM t")


def unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emails that a UNIQUE column would refuse."""
    return violations(load(spark, sf_dir, "users"), "email").withColumnRenamed("k", "email")


def unique_violations_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sale ids of late rows that a UNIQUE column with the earlier ones would refuse."""
    sales = load(spark, sf_dir, "sales")
    late = F.col("loaded_at") > F.col("sold_at") + F.expr("INTERVAL 2 DAYS")
    return violations(sales.where(late), "sale_id", sales.where(~late | late.isNull())).withColumnRenamed("k", "sale_id")


def show_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark)
    for name in ("region", "nation", "customer", "orders", "lineitem"):
        db.register(name, load(spark, sf_dir, name))
    return db.sql("SHOW TABLES")


def transaction_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queued changes: the read within sees none of them, the read after commit all."""
    db = _customers(spark, sf_dir)
    c = Connection(db)
    with c.transaction():
        c.execute("DELETE FROM customer WHERE c_acctbal < ?", [0])
        c.execute("UPDATE customer SET c_name = 'x' WHERE c_custkey <= ?", [10])
        within = c.execute("SELECT COUNT(*) AS n FROM customer").frame.withColumn("at", F.lit("within"))
    after = c.execute("SELECT COUNT(*) AS n FROM customer WHERE c_name != 'x'").frame.withColumn("at", F.lit("after"))
    return within.unionByName(after)


def transaction_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _customers(spark, sf_dir)
    c = Connection(db)
    c.begin()
    c.execute("DELETE FROM customer")
    c.rollback()
    return c.execute("SELECT COUNT(*) AS n, SUM(c_acctbal) AS s FROM customer").frame.withColumn("s", F.round("s", 2))


def prepared_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = PreparedStatement("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = ? AND o_totalprice BETWEEN ? AND ? AND o_orderpriority IN (?, ?)")
    return Lazy(spark, sf_dir).run(s.bind("O", 1000, 90000.5, "1-URGENT", "5-LOW")).frame


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row by its hidden row id, as Client.get reads it; rows are numbered in the order they are appended in."""
    db = Database(spark)
    db.create_table("customer", _CUSTOMER)
    db.append("customer", load(spark, sf_dir, "customer").orderBy("c_custkey"))
    return db.frame("customer").where(F.col(ROW_ID) == 7).drop(ROW_ID)


def client_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The client's filtered search over a table filled from a DataFrame."""
    with Client(spark) as c:
        c.create_table("vectors", 64, {"vec_id": int, "label": int})
        c.database.append("vectors", load(spark, sf_dir, "embeddings"))
        found = c.database.search("vectors", query_vector(spark, sf_dir, 1), 10, "cosine", "label != 2 AND vec_id > 1")
        return found.select("vec_id", "label", F.round("distance", 6).alias("distance"))


def vector_store_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of all vectors by dot product, after one was deleted and one updated."""
    store = VectorStore(spark, 64, "dot")
    store.append(load(spark, sf_dir, "embeddings").orderBy("vec_id").coalesce(1), "embedding")
    store.delete(1)
    store.update(2, [0.0] * 64)
    return store.query(query_vector(spark, sf_dir), 10).select("id", F.round("distance", 6).alias("distance"))


def delete_and_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row inserted after a delete is found by search, under a new id."""
    db = Database(spark)
    db.create_table("v", [Column("vec", "VECTOR", 4), Column("name", "TEXT")])
    db.append("v", load(spark, sf_dir, "products").where("embedding is not null").select(F.col("embedding").alias("vec"), F.col("item_name").alias("name")))
    db.run(Delete("v"))
    db.run(Insert("v", ("vec", "name"), (([1.0, 0.0, 0.0, 0.0], "new"), ([0.0, 1.0, 0.0, 0.0], "other"))))
    return db.search("v", [0.9, 0.1, 0.0, 0.0], 1).select("name", F.round("distance", 6).alias("distance"))


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance functions in Spark SQL, with a query vector that is not of unit length."""
    distance.create_sql_functions(spark)
    load(spark, sf_dir, "products").createOrReplaceTempView("vexalith_products")
    return spark.sql(
        "SELECT sku, round(l2sq(embedding, q), 5) AS l2, round(cosine_distance(embedding, q), 6) AS cos, round(negative_dot(embedding, q), 5) AS dot "
        "FROM (SELECT sku, embedding, array(1.5F, -2F, 0.5F, 3F) AS q FROM vexalith_products WHERE embedding IS NOT NULL)"
    )


def _dialect(sql: str) -> Query:
    return lambda spark, sf_dir: Lazy(spark, sf_dir).sql(sql)


def _agg_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Lazy(spark, sf_dir).sql(DIALECT["agg_avg"][0]).select(F.round("a", 9).alias("a"))


def _rounded(name: str, column: str, digits: int) -> Query:
    return lambda spark, sf_dir: Lazy(spark, sf_dir).sql(DIALECT[name][0]).withColumn(column, F.round(column, digits))


_UPDATED = "c_acctbal < 0 OR c_mktsegment = 'MACHINERY'"
_FOUR = "[1.5, -2.0, 0.5, 3.0]"

QUERIES: dict[str, Query] = {name: _dialect(sql) for name, (sql, _) in DIALECT.items()} | {
    "agg_avg": _agg_avg,
    "agg_sum": _rounded("agg_sum", "s", 2),
    "flagship_similarity": flagship,
    "knn_l2": _knn("euclidean"),
    "knn_cosine": _knn("cosine"),
    "knn_dot": _knn("dot"),
    "knn_filtered": knn_filtered,
    "knn_per_label": knn_per_label,
    "knn_batch": knn_batch,
    "distance_matrix": distance_matrix,
    "distance_columns": distance_columns,
    "sql_functions": sql_functions,
    "centroid_by_label": centroid_by_label,
    "accuracy_measures": accuracy_measures,
    "distance_error": distance_error,
    "update_then_select": update_then_select,
    "delete_then_select": delete_then_select,
    "insert_auto_id": insert_auto_id,
    "insert_default": insert_default,
    "unique_violations": unique_violations,
    "unique_violations_existing": unique_violations_existing,
    "show_tables": show_tables,
    "transaction_commit": transaction_commit,
    "transaction_rollback": transaction_rollback,
    "prepared_bind": prepared_bind,
    "point_lookup": point_lookup,
    "client_search": client_search,
    "vector_store_query": vector_store_query,
    "delete_and_insert": delete_and_insert,
} | {name: query for name, (query, _) in CHANGES.items()}

ORACLE: dict[str, str] = {name: twin or sql for name, (sql, twin) in DIALECT.items()} | {
    "agg_sum": "SELECT round(coalesce(sum(l_quantity::double), 0.0), 2) AS s FROM lineitem",
    "flagship_similarity": _knn_sql(_l2("embedding", _Q)),
    "knn_l2": _knn_sql(_l2("embedding", _Q)),
    "knn_cosine": _knn_sql(_cos("embedding", _Q)),
    "knn_dot": _knn_sql("-" + _product("embedding", _Q)),
    "knn_filtered": _knn_sql(_l2("embedding", _Q), "WHERE label IN (1, 3, 5)"),
    "knn_per_label": f"""SELECT label, rank, vec_id, round(d, 6) AS distance FROM (
        SELECT label, vec_id, d, row_number() OVER (PARTITION BY label ORDER BY d, vec_id)::int AS rank
        FROM (SELECT label, vec_id, {_l2('embedding', _Q)} AS d FROM embeddings)) WHERE rank <= 3""",
    "knn_batch": f"""SELECT query_id, neighbour_id, round(d, 6) AS distance, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, neighbour_id)::int AS rank FROM ({_BATCH})) WHERE rank <= 5""",
    "distance_matrix": f"""SELECT u.id AS id, p.sku AS sku, round({_l2('u.embedding', 'p.embedding')}, 5) AS distance FROM users u JOIN products p ON u.id % 20 = 0
        WHERE u.embedding IS NOT NULL AND p.embedding IS NOT NULL""",
    "distance_columns": f"""SELECT account_id, round({_l2('embedding', 'v')}, 6) AS euclidean, round({_cos('embedding', 'v')}, 6) AS cosine, round(-{_product('embedding', 'v')}, 6) AS dot
        FROM (SELECT account_id, a.embedding, u.embedding[1:2] AS v FROM accounts a JOIN users u ON a.user_id = u.id) WHERE embedding IS NOT NULL AND v IS NOT NULL""",
    "sql_functions": f"""SELECT sku, round({_l2('embedding', _FOUR)}, 5) AS l2, round({_cos('embedding', _FOUR)}, 6) AS cos, round(-{_product('embedding', _FOUR)}, 5) AS dot
        FROM products WHERE embedding IS NOT NULL""",
    "centroid_by_label": "SELECT label, pos::int AS pos, round(avg(x), 6) AS mean FROM (SELECT label, unnest(range(len(embedding))) AS pos, unnest(embedding)::double AS x FROM embeddings) GROUP BY ALL",
    "accuracy_measures": """SELECT round(avg(hits / 9.0), 6) AS recall, round(avg(CASE WHEN given > 0 THEN hits * 1.0 / given END), 6) AS precision, round(avg(rr), 6) AS mrr, round(avg(rs), 6) AS reciprocal_sum
        FROM (SELECT vec_id, 6 AS hits, 6 AS given, 0.5::double AS rr, (1/2.0 + 1/3.0 + 1/5.0 + 1/6.0 + 1/8.0 + 1/9.0) / 9 AS rs FROM embeddings WHERE vec_id % 20 = 0)""",
    "distance_error": "SELECT -1.0::double AS distance_error",
    "update_then_select": f"""SELECT c_custkey, CASE WHEN {_UPDATED} THEN 0.0 ELSE c_acctbal END AS c_acctbal, CASE WHEN {_UPDATED} THEN 'CLOSED' ELSE c_mktsegment END AS c_mktsegment FROM customer""",
    "delete_then_select": "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS s FROM customer WHERE NOT (c_mktsegment = 'BUILDING' AND c_acctbal BETWEEN 0 AND 5000) GROUP BY 1",
    "insert_auto_id": "SELECT count(*) + 2 AS n, 1::bigint AS lo, count(*) + 2 AS hi, greatest(max(n_name), 'NOWHERE') AS last FROM nation",
    "insert_default": "SELECT r_regionkey::bigint AS r_regionkey, r_name, 'new' AS state FROM region",
    "unique_violations": "SELECT email FROM users WHERE email IS NOT NULL GROUP BY email HAVING count(*) > 1",
    "unique_violations_existing": """WITH late AS (SELECT sale_id FROM sales WHERE loaded_at > sold_at + INTERVAL 2 DAYS AND sale_id IS NOT NULL), old AS (SELECT sale_id FROM sales WHERE NOT coalesce(loaded_at > sold_at + INTERVAL 2 DAYS, false))
        SELECT sale_id FROM late GROUP BY sale_id HAVING count(*) > 1 UNION SELECT sale_id FROM late WHERE sale_id IN (SELECT sale_id FROM old WHERE sale_id IS NOT NULL)""",
    "show_tables": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS row_count, 0::bigint AS vector_dim FROM {t}" for t in ("region", "nation", "customer", "orders", "lineitem")),
    "transaction_commit": "SELECT count(*) AS n, 'within' AS at FROM customer UNION ALL SELECT count(*), 'after' FROM customer WHERE c_acctbal >= 0 AND c_custkey > 10",
    "transaction_rollback": "SELECT count(*) AS n, round(sum(c_acctbal), 2) AS s FROM customer",
    "prepared_bind": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice BETWEEN 1000 AND 90000.5 AND o_orderpriority IN ('1-URGENT', '5-LOW')",
    "point_lookup": "SELECT c_custkey::bigint AS c_custkey, c_name, c_nationkey::bigint AS c_nationkey, c_acctbal, c_mktsegment FROM customer ORDER BY c_custkey LIMIT 1 OFFSET 6",
    "client_search": f"SELECT vec_id, label, round(d, 6) AS distance FROM (SELECT vec_id, label, {_cos('embedding', '(SELECT embedding FROM embeddings WHERE vec_id = 1)')} AS d FROM embeddings WHERE label <> 2 AND vec_id > 1) ORDER BY d, vec_id LIMIT 10",
    "vector_store_query": f"""SELECT id, round(d, 6) AS distance FROM (SELECT id, CASE WHEN id = 2 THEN 0.0 ELSE -{_product('embedding', _Q)} END AS d
        FROM (SELECT row_number() OVER (ORDER BY vec_id) AS id, embedding FROM embeddings) WHERE id <> 1) ORDER BY d, id LIMIT 10""",
    "delete_and_insert": "SELECT 'new' AS name, 0.02::double AS distance",
} | {name: twin for name, (_, twin) in CHANGES.items() if twin}

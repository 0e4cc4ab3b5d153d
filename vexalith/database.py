"""The database: statements in, results out."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any, TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import ConflictError, QueryError
from .functions import predicates
from .operators.similarity import nearest
from .plans import planner
from .plans.ast import CreateTable, Delete, DropTable, Insert, Parameter, Parsed, Select, ShowTables, Statement, Update
from .plans.parser import parse
from .sources.catalog import Catalog, State, Version, appended, materialised, with_ids
from .sources.constraints import check
from .types import ROW_ID, Column, fitted

X = TypeVar("X")
#: Parts of a table from which on an in-memory change cuts its lineage.
LONG_LINEAGE = 24
#: Times a change is tried while other writers change the same table.
RETRIES = 20


@dataclass
class Result:
    """What a statement gave. kind: select, create, drop, insert, update, delete, show."""

    kind: str
    table: str | None = None
    frame: DataFrame | None = None
    affected: int = 0
    ids: list[int] = field(default_factory=list)

    def rows(self) -> list:
        return self.frame.collect() if self.frame is not None else []

    def text(self) -> str:
        """A line or a table for people."""
        if self.frame is not None:
            return self.frame._show_string(1000, 60)
        return f"{self.kind} {self.table}: {self.affected} row(s)" if self.kind in ("insert", "update", "delete") else f"{self.kind} {self.table}"


class Database:
    """Tables of vectors and ordinary columns.

    Without a path the tables last as long as the object; with one they are in Parquet below it, and
    every change is published at once. External DataFrames can be given names with ``register``;
    they can be read, joined and searched like tables but not changed.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.catalog = Catalog(spark, path)
        self.views: dict[str, DataFrame] = {}

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Database:
        return cls(spark, path)

    # -- reading --
    def register(self, name: str, frame: DataFrame) -> None:
        self.views[name] = frame

    def frame(self, name: str, state: State | None = None) -> DataFrame:
        """A table with its hidden row id, or a registered DataFrame."""
        if name in self.views:
            return self.views[name]
        return self.catalog.read(name, state)

    def table(self, name: str) -> DataFrame:
        return self.frame(name).drop(ROW_ID)

    def tables(self) -> list[str]:
        return sorted({*self.catalog.names(), *self.views})

    def get(self, table: str, row_id: int) -> dict[str, Any] | None:
        got = self.catalog.read(table).where(F.col(ROW_ID) == row_id).limit(1).collect()
        return {k: v for k, v in got[0].asDict().items() if k != ROW_ID} if got else None

    # -- statements --
    def execute(self, sql: str, parameters: Sequence[Any] = ()) -> Result:
        return self.run(bound(parse(sql), parameters))

    def sql(self, sql: str, parameters: Sequence[Any] = ()) -> DataFrame:
        """The DataFrame of a SELECT or SHOW TABLES."""
        r = self.execute(sql, parameters)
        if r.frame is None:
            raise QueryError("The statement has no rows; use execute")
        return r.frame

    def run(self, s: Statement) -> Result:
        if isinstance(s, Select):
            state = self.catalog.state()
            return Result("select", s.table, planner.select(s, lambda n: self.frame(n, state)))
        if isinstance(s, ShowTables):
            return Result("show", frame=self.show())
        return self.changed(lambda state: self.change(s, state))

    def changed(self, change: Callable[[State], X]) -> X:
        """Applies ``change`` to a snapshot and publishes it; again on a newer one if another writer was first."""
        with self.catalog.lock:
            for attempt in range(RETRIES):
                base = self.catalog.state()
                state = dict(base)
                result = change(state)
                try:
                    self.catalog.publish(state, base)
                    return result
                except ConflictError:
                    if attempt == RETRIES - 1:
                        raise
        raise AssertionError

    def show(self) -> DataFrame:
        rows = []
        for name, v in sorted(self.catalog.state().items()):
            vector = v.vector()
            rows.append((name, self.catalog.frame(v).count(), vector.dim if vector else 0))
        for name, df in sorted(self.views.items()):
            rows.append((name, df.count(), max((f.metadata.get("dim", 0) for f in df.schema.fields), default=0)))
        return self.spark.createDataFrame(rows, "name string, row_count long, vector_dim long")

    # -- changes: each takes a state and puts the table's next version into it --
    def change(self, s: Statement, state: State) -> Result:
        if isinstance(s, CreateTable):
            return self.create(s, state)
        if isinstance(s, DropTable):
            if s.table not in state and not s.if_exists:
                self.catalog.version(s.table, state)
            state.pop(s.table, None)
            return Result("drop", s.table)
        if isinstance(s, Insert):
            return self.insert(s, state)
        if isinstance(s, Update):
            return self.update(s, state)
        if isinstance(s, Delete):
            return self.delete(s, state)
        raise QueryError(f"{type(s).__name__} changes nothing")

    def create(self, s: CreateTable, state: State) -> Result:
        if s.table in self.views:
            raise QueryError(f"'{s.table}' names a registered DataFrame")
        if s.table in state:
            if s.if_not_exists:
                return Result("create", s.table)
            raise QueryError(f"Table '{s.table}' already exists")
        names = [c.name for c in s.columns]
        if len(set(names)) < len(names) or ROW_ID in names:
            raise QueryError("Column names must differ from each other and from " + ROW_ID)
        state[s.table] = Version(tuple(replace(c, default=fitted(c, c.default)) for c in s.columns))
        return Result("create", s.table)

    def insert(self, s: Insert, state: State) -> Result:
        v = self.catalog.version(s.table, state)
        names = list(s.columns) if s.columns is not None else [c.name for c in v.columns]
        for n in names:
            v.column(n)
        if len(set(names)) < len(names):
            raise QueryError("A column is named twice")
        rows, ids = [], []
        for values in s.rows:
            if len(values) != len(names):
                raise QueryError(f"{len(names)} columns, {len(values)} values")
            given = dict(zip(names, values))
            ids.append(v.next_id + len(rows))
            row = {c.name: fitted(c, given[c.name]) if c.name in given else c.default for c in v.columns}
            if "id" in row:
                row["id"] = ids[-1]
            rows.append((ids[-1], *[row[c.name] for c in v.columns]))
        schema = T.StructType([replace_type(f) for f in v.schema().fields])
        new = self.spark.createDataFrame(rows, schema)
        self._append(s.table, v, new, len(rows), state)
        return Result("insert", s.table, affected=len(rows), ids=ids)

    def _append(self, name: str, v: Version, rows: DataFrame, count: int, state: State) -> None:
        check(rows, v.columns, self.catalog.frame(v) if v.parts else None)
        if count:
            new = appended(v, self.catalog.part(name, rows), count)
            state[name] = self._shortened(new)

    def _shortened(self, v: Version) -> Version:
        if self.catalog.path or len(v.parts) <= LONG_LINEAGE:
            return v
        return replace(v, parts=(materialised(self.catalog.frame(v)),))

    def append(self, table: str, rows: DataFrame) -> Result:
        """Rows of a DataFrame, columns by name, as one atomic insert. Missing columns get defaults.

        The rows are written first and numbered from what was written.
        """
        staged: list[DataFrame] = []

        def add(state: State) -> Result:
            v = self.catalog.version(table, state)
            if not staged:
                staged.append(self._staged(table, v, rows))
            return self.append_to(state, table, staged[0])

        return self.changed(add)

    def _staged(self, table: str, v: Version, rows: DataFrame) -> DataFrame:
        """The rows with the table's columns, stable to recomputation."""
        for c in rows.columns:
            if c != ROW_ID:
                v.column(c)
        chosen = []
        for c in v.columns:
            kind = c.field().dataType
            value = F.col(f"`{c.name}`").cast(kind) if c.name in rows.columns else F.lit(c.default).cast(kind)
            chosen.append(value.alias(c.name))
        staged = rows.select(*chosen)
        if not self.catalog.path:
            return materialised(staged)
        return self.spark.read.parquet(f"{self.catalog.path}/{self.catalog.part(f'_staged/{table}', staged)}")

    def append_to(self, state: State, table: str, staged: DataFrame) -> Result:
        """Puts the table's next version, with the staged rows, into the state."""
        v = self.catalog.version(table, state)
        numbered, count = with_ids(staged, v.next_id)
        if any(c.name == "id" for c in v.columns):
            numbered = numbered.withColumn("id", F.col(ROW_ID))
        self._append(table, v, numbered.select(ROW_ID, *[c.name for c in v.columns]), count, state)
        return Result("insert", table, affected=count, ids=[v.next_id, v.next_id + count - 1] if count else [])

    def _resolve(self, v: Version, df: DataFrame) -> Callable:
        return planner.Scope(df).resolve

    def _chosen(self, where, v: Version, df: DataFrame):
        if where is None:
            return F.lit(True)
        if any(c.operator == "SIMILARITY" for c in where.conditions()):
            raise QueryError("SIMILARITY does not go with UPDATE or DELETE")
        return predicates.chain(where, self._resolve(v, df))

    def update(self, s: Update, state: State) -> Result:
        v = self.catalog.version(s.table, state)
        old = self.catalog.frame(v)
        hit = self._chosen(s.where, v, old)
        values = {c: fitted(v.column(c), x) for c, x in s.values}
        if len(values) < len(s.values):
            raise QueryError("A column is set twice")
        met = self.catalog.parts_with(v, hit)
        if met:
            kinds = {f.name: f.dataType for f in v.schema().fields}
            literal = lambda c: F.array(*[F.lit(float(x)) for x in values[c]]).cast(kinds[c]) if isinstance(values[c], list) else F.lit(values[c]).cast(kinds[c])
            change = lambda df: df.select(*[F.when(hit, literal(c)).otherwise(F.col(f"`{c}`")).alias(c) if c in values else F.col(f"`{c}`") for c in df.columns])
            check(change(old), [c for c in v.columns if c.name in values], None)
            state[s.table] = self._rewritten(s.table, v, met, change)
        return Result("update", s.table, affected=sum(met.values()))

    def _rewritten(self, table: str, v: Version, met: dict[int, int], change: Callable[[DataFrame], DataFrame]) -> Version:
        """The version with the parts met changed, as one new part; the others stay as they are."""
        old = replace(v, parts=tuple(v.parts[n] for n in sorted(met)))
        rows = change(self.catalog.frame(old))
        part = self.catalog.part(table, rows) if self.catalog.path else materialised(rows)
        return replace(v, parts=(*(p for n, p in enumerate(v.parts) if n not in met), part))

    def delete(self, s: Delete, state: State) -> Result:
        v = self.catalog.version(s.table, state)
        old = self.catalog.frame(v)
        if s.where is None:
            count = old.count()
            if count:
                state[s.table] = replace(v, parts=())
            return Result("delete", s.table, affected=count)
        hit = self._chosen(s.where, v, old)
        met = self.catalog.parts_with(v, hit)
        if met:
            state[s.table] = self._rewritten(s.table, v, met, lambda df: df.where(~hit))
        return Result("delete", s.table, affected=sum(met.values()))

    # -- the direct interface --
    def create_table(self, name: str, columns: Iterable[Column], if_not_exists: bool = False) -> Result:
        return self.run(CreateTable(name, tuple(columns), if_not_exists))

    def insert_direct(self, table: str, vector: Sequence[float], metadata: dict[str, Any] | None = None) -> int:
        """One row: its vector, and other columns by name. Returns the row id."""
        return self.insert_batch_direct(table, [vector], [metadata or {}])[0]

    def insert_batch_direct(self, table: str, vectors: Sequence[Sequence[float]], metadata: Sequence[dict[str, Any]] | None = None) -> list[int]:
        """Rows in one atomic insert: all are there or none."""
        metadata = [{}] * len(vectors) if metadata is None else metadata
        if len(metadata) != len(vectors):
            raise ValueError(f"{len(vectors)} vectors, {len(metadata)} metadata")
        if not vectors:
            return []
        v = self.catalog.version(table)
        column = v.vector()
        if column is None:
            raise QueryError(f"Table '{table}' has no vector column")
        names = [c.name for c in v.columns if c.name == column.name or any(c.name in m for m in metadata)]
        for m in metadata:
            for n in m:
                v.column(n)
        default = {c.name: c.default for c in v.columns}
        rows = tuple(tuple(list(x) if n == column.name else m.get(n, default[n]) for n in names) for x, m in zip(vectors, metadata))
        return self.run(Insert(table, tuple(names), rows)).ids

    def search(self, table: str, query: Sequence[float], k: int = 10, metric: str = "euclidean", where: str | None = None) -> DataFrame:
        """The k nearest rows with _row_id and distance; where: conditions of the dialect, applied first."""
        df = self.frame(table)
        column = self.catalog.version(table).vector() if table not in self.views else None
        name = column.name if column else next((f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)), None)
        if name is None:
            raise QueryError(f"Table '{table}' has no vector column")
        if where:
            parsed = parse(f"SELECT * FROM {table} WHERE {where}").statement
            assert isinstance(parsed, Select) and parsed.where is not None
            df = df.where(predicates.chain(parsed.where, planner.Scope(df).resolve))
        return nearest(df, name, query, k, metric, tie=[ROW_ID] if ROW_ID in df.columns else [])

    def save(self, path: str | None = None) -> None:
        """Copies all tables below a new path; with no path, or the own one, nothing is left to do."""
        if path is None or path.rstrip("/") == self.catalog.path:
            return
        target = Catalog(self.spark, path)
        base = target.state()
        copies = {name: replace(v, parts=(target.part(name, self.catalog.frame(v)),) if v.parts else ()) for name, v in self.catalog.state().items()}
        target.publish(base | copies, base)


def replace_type(f: T.StructField) -> T.StructField:
    return T.StructField(f.name, f.dataType, f.nullable)


def bound(p: Parsed, values: Sequence[Any]) -> Statement:
    """The statement with its parameters replaced by values, which stay values and are never parsed."""
    if len(values) != p.parameters:
        raise QueryError(f"The statement takes {p.parameters} parameters, {len(values)} given")
    return _bind(p.statement, list(values)) if p.parameters else p.statement


def _bind(x: Any, values: list) -> Any:
    if isinstance(x, Parameter):
        v = values[x.number]
        return [float(y) for y in v] if not isinstance(v, (str, bytes, bytearray)) and isinstance(v, Iterable) else v
    if isinstance(x, tuple):
        return tuple(_bind(y, values) for y in x)
    if hasattr(x, "__dataclass_fields__") and not isinstance(x, Column):
        return type(x)(**{n: _bind(getattr(x, n), values) for n in x.__dataclass_fields__})
    return x

"""An extension: a stream of rows appended to a table, one atomic insert a micro-batch.

A batch that is delivered again after a failure is recognised by its number, which is kept beside
the table, and not inserted twice.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..database import Database
from ..errors import QueryError
from ..plans.ast import Insert
from ..sources.catalog import State
from ..types import Column

PROGRESS = "_ingested"


def ingest(database: Database, table: str, stream: DataFrame, checkpoint: str, name: str | None = None, **trigger) -> StreamingQuery:
    """Starts appending the stream's rows to the table; trigger as in DataStreamWriter.trigger."""
    if not stream.isStreaming:
        raise QueryError("ingest takes a stream; use Database.append for a DataFrame")
    stream_name = name or table
    database.create_table(PROGRESS, [Column("stream", "TEXT"), Column("batch", "INTEGER")], if_not_exists=True)

    def write(rows: DataFrame, batch: int) -> None:
        staged: list[DataFrame] = []

        def add(state: State) -> None:
            """Rows and progress in one change. Progress keeps the last batch of each stream, in one part."""
            v = database.catalog.version(PROGRESS, state)
            last = {r["stream"]: r["batch"] for r in database.catalog.frame(v).groupBy("stream").agg(F.max("batch").alias("batch")).collect()}
            if last.get(stream_name, -1) >= batch:
                return
            if not staged:
                staged.append(database._staged(table, database.catalog.version(table, state), rows))
            database.append_to(state, table, staged[0])
            last[stream_name] = batch
            state[PROGRESS] = replace(v, parts=())
            database.insert(Insert(PROGRESS, ("stream", "batch"), tuple(sorted(last.items()))), state)

        database.changed(add)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).queryName(stream_name)
    return (writer.trigger(**trigger) if trigger else writer).start()

"""The five aggregates: COUNT of values, SUM always FLOAT and 0.0 of nothing, AVG, MIN, MAX."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError

RESULT_KIND = {"COUNT": "INTEGER", "SUM": "FLOAT", "AVG": "FLOAT"}


def aggregate(function: str, c: Column | None, kind: str | None) -> Column:
    """c None: COUNT of rows. SUM and AVG skip values that are no numbers."""
    number = c.cast("double") if c is not None and kind in ("INTEGER", "FLOAT") else F.lit(None).cast("double")
    if function == "COUNT":
        return F.count(F.lit(1) if c is None else c)
    if c is None:
        raise QueryError(f"{function} needs a column")
    if function == "SUM":
        return F.coalesce(F.sum(number), F.lit(0.0))
    if function == "AVG":
        return F.avg(number)
    if function == "MIN":
        return F.min(c)
    if function == "MAX":
        return F.max(c)
    raise QueryError(f"Unknown aggregate {function}")

"""Strict parsing: a field that does not parse fails the job, whatever the session's ANSI setting.

The parsed column is never null and declared so (the last default is not
reached). Spark then adds no null filters below joins, and self-joins can share
one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict(field: Column, dtype: str, what: str) -> Column:
    parsed = field.try_cast(dtype)
    message = F.concat(F.lit(f"bad {what}: "), F.coalesce(field.cast("string"), F.lit("NULL")))
    return F.coalesce(parsed, F.raise_error(message).cast(dtype), F.lit(0).cast(dtype))

"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(line: Column) -> Column:
    """Words of a line: split at single spaces, keep leading and inner empty words, drop trailing ones.

    An empty line holds one empty word, a line of spaces only holds none.
    """
    trimmed = F.rtrim(line)
    blank = (trimmed == "") & (line != "")
    return F.when(blank, F.array().cast("array<string>")).otherwise(F.split(trimmed, " "))

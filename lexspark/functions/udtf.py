"""Table functions for SQL: ``SELECT … FROM t, LATERAL char_windows(t.text, 1800, 180)``."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="window_no int, begins_at int, piece string")
class CharWindows:
    """Windows of a size, each beginning an overlap before the last one's end."""

    def eval(self, text: str, size: int, overlap: int):
        if text is None or size <= overlap:
            return
        at = n = 0
        while True:
            yield n, at, text[at : at + size]
            if at + size >= len(text):
                return
            at, n = at + size - overlap, n + 1


def register(spark: SparkSession) -> None:
    """Makes the table functions known to SQL under their names."""
    spark.udtf.register("char_windows", CharWindows)

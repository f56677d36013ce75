"""Named queries, each a Spark plan and, where SQL can say it, the same question as SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import compiled
from ..sources.binding import view_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Sums of doubles differ in the last bits with the order of addition.  Compared columns are rounded on both sides,
# nudged off exact ties first so that both engines round the same way.
NUDGE, DIGITS = 1e-9, 4


def _rounded(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n) + F.lit(NUDGE), DIGITS) + F.lit(0.0) for n in names})


def with_views(views: str, text: str) -> str:
    """``text`` with the named views in front of it."""
    if not views:
        return text.strip()
    listed = ",\n".join(f"{v} AS ({view_sql(v)})" for v in views.split())
    text = text.strip()
    if text.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {listed},\n{text[15:]}"
    return f"WITH {listed},\n{text[5:]}" if text.startswith("WITH ") else f"WITH {listed}\n{text}"


def query(name: str, sql: str | None = None, views: str = "", doubles: str = "", dates: str = ""):
    """Register the decorated function.

    ``doubles`` are columns rounded on both sides, ``dates`` columns written as text on both sides.
    """
    numbers, days = doubles.split(), dates.split()

    def keep(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            compiled(spark)
            df = build(spark, folder)
            df = _rounded(df, numbers) if numbers else df
            return df.withColumns({d: F.col(d).cast("string") for d in days}) if days else df

        QUERIES[name] = run
        if sql is not None:
            text = with_views(views, sql)
            swaps = [f'round("{n}" + 1e-9, {DIGITS}) + 0.0 AS "{n}"' for n in numbers]
            swaps += [f'CAST("{d}" AS VARCHAR) AS "{d}"' for d in days]
            if swaps:
                text = f"SELECT * REPLACE ({', '.join(swaps)}) FROM (\n{text}\n)"
            SQL[name] = text
        return build

    return keep

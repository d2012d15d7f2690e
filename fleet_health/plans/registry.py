"""Registry of named queries and their DuckDB oracle SQL.

``@query(name, sql=...)`` registers a function ``(spark, sf_dir) ->
DataFrame``.  Results are passed through :func:`normalize` so floating
point columns compare stably across engines: doubles are rounded to 6
places (and -0.0 folded to 0.0) on both sides.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import configure

ROUND = 6


@dataclass
class Entry:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ids: str = ""


REGISTRY: dict[str, Entry] = {}


def normalize(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append((F.round(F.col(f.name).cast("double"), ROUND) + F.lit(0.0)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None, ids: str = ""):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return normalize(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, run, sql, ids)
        return fn
    return deco


def rounded(inner: str, doubles: Sequence[str], alias: str = "q") -> str:
    """Wrap oracle SQL so the listed DOUBLE columns are rounded like
    :func:`normalize` does on the Spark side."""
    if not doubles:
        return inner
    rep = ", ".join(f'round("{c}", {ROUND}) + 0.0 AS "{c}"' for c in doubles)
    return f"SELECT * REPLACE ({rep}) FROM ({inner}) {alias}"

"""Sort, limit and top-k reports (T1-T7). A sort with a limit keeps k rows a task, never a full sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top(df: DataFrame, order: Sequence[Column], n: int, where: Column | None = None) -> DataFrame:
    """The first n rows by any order, mixed directions included (T4)."""
    return (df if where is None else df.where(where)).orderBy(*order).limit(n)


def ranked_at_latest(df: DataFrame, ts: str, order: Sequence[Column]) -> DataFrame:
    """T5: the rows of the newest time, in order. The newest time is one row, joined back."""
    newest = df.agg(F.max(ts).alias("_newest"))
    return df.join(F.broadcast(newest), F.col(ts) == F.col("_newest")).drop("_newest").orderBy(*order)


def best_group(df: DataFrame, keys: Sequence[str | Column], measure: Column, name: str, largest: bool = True) -> DataFrame:
    """The group whose measure is largest (or least)."""
    out = df.groupBy(*keys).agg(measure.alias(name))
    by = F.desc(name) if largest else F.asc(name)
    return out.orderBy(by, *[out[c] for c in out.columns if c != name]).limit(1)

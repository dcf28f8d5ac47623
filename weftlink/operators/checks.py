"""Assertions that stop a run instead of letting wrong figures through."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHOWN = 5


def config_of(*leaves: str) -> str:
    """The config that folders ``.../config=<name>/...`` belong to; stop when they are not all under one ``config=`` folder."""
    parents = {leaf.rstrip("/").rpartition("/")[0] for leaf in leaves}
    names = {p.rpartition("/")[2] for p in parents}
    if len(parents) != 1 or not next(iter(names)).startswith("config="):
        raise ValueError(f"not in one config folder: {', '.join(leaves)}")
    return names.pop().removeprefix("config=")


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing column(s): {', '.join(missing)}")
    return df


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """Stop when a key occurs twice, naming the first few."""
    repeated = df.groupBy(key).count().filter("count > 1").orderBy(key).limit(SHOWN).collect()
    if repeated:
        raise ValueError(f"non-unique {key}: {', '.join(str(r[0]) for r in repeated)}")
    return df


def stale_rows_dropped(rows: DataFrame, current: DataFrame, key: str = "id") -> DataFrame:
    """Only rows whose key is in the current set."""
    return rows.join(current.select(key).distinct(), key, "left_semi")


def missing_rows(required: DataFrame, present: DataFrame, key: str = "id") -> DataFrame:
    """Keys that should be there and are not."""
    return required.select(key).distinct().join(present.select(key), key, "left_anti")


def require_complete(required: DataFrame, present: DataFrame, key: str = "id") -> DataFrame:
    """Stop when a definition has no row in ``present``: a zero would be made up for it."""
    lost = missing_rows(required, present, key)
    shown = [str(r[0]) for r in lost.orderBy(key).limit(SHOWN).collect()]
    if shown:
        raise ValueError(f"{lost.count()} {key}(s) without a row, among them {', '.join(shown)}")
    return present


def require_same_count(expected: int, df: DataFrame, what: str) -> int:
    actual = df.count()
    if actual != expected:
        raise ValueError(f"{what}: {actual} rows, expected {expected}")
    return actual


def level_counts(df: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """Frequency of each level in the order given, levels that never occur included."""
    spark = df.sparkSession
    order = spark.createDataFrame([(i, v) for i, v in enumerate(levels)], f"level_order int, {column} string")
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return order.join(counts, column, "left").select("level_order", column, F.coalesce("n", F.lit(0)).alias("n"))

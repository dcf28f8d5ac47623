"""Global order without a single sorting task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlink.session import cut_lineage


def with_position(df: DataFrame, order: list[Column | str], name: str = "position") -> DataFrame:
    """1-based position of every row in the order given, which must leave no ties.

    Rows are range-partitioned, sorted and numbered inside their range in one stage; the ranges' sizes (one row per
    partition) give the offsets. The ranges are materialised first: both uses must see the same cut.
    """
    at, range_, offset = f"_at_{name}", f"_range_{name}", f"_offset_{name}"
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # the number of the partition is in the upper bits, the place inside it in the lower 33
    ranged = cut_lineage(ranged.withColumn(at, F.monotonically_increasing_id()))
    ranged = ranged.withColumns({range_: F.shiftright(at, 33), at: F.col(at).bitwiseAND(F.lit((1 << 33) - 1))})
    before = Window.orderBy(range_).rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition
    offsets = (
        ranged.groupBy(range_)
        .agg(F.count("*").alias("rows"))
        .select(range_, F.coalesce(F.sum("rows").over(before), F.lit(0)).alias(offset))
    )
    placed = ranged.join(F.broadcast(offsets), range_)
    return placed.withColumn(name, F.col(at) + 1 + F.col(offset)).drop(at, range_, offset)


def with_dense_position(df: DataFrame, column: str, name: str, descending: bool = False, collation: str | None = None) -> DataFrame:
    """Position of a value among the distinct values of its column."""
    key = F.collate(F.col(column), collation) if collation else F.col(column)
    order = [F.desc("_key") if descending else F.asc("_key"), F.asc(column)]
    values = df.select(column, key.alias("_key")).distinct()
    placed = with_position(values, order, name)
    return df.join(placed.select(column, name), column)


def with_previous(df: DataFrame, position: str, columns: list[str]) -> DataFrame:
    """``previous_<column>`` from the row before, by an equi-join on the position."""
    before = df.select(
        (F.col(position) + 1).alias(position), *[F.col(c).alias(f"previous_{c}") for c in columns]
    )
    return df.join(before, position, "left")


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key in the order given, as a map-side combinable minimum (no window sort)."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    picked = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_first"))
    return picked.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in [*order, *rest]])

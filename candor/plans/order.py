"""Rankings: sort keys with nulls last and a total tie-break, and cuts that are global, per group or per grain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class LimitError(ValueError):
    """A limit outside its bounds; limits are never clamped."""


def checked_limit(limit: int, most: int = 1000) -> int:
    if limit <= 0 or limit > most:
        raise LimitError(f"limit {limit} is not within 1 to {most}")
    return limit


def keys(rank: list[tuple[str, str]], key: list[str]) -> list[Column]:
    """Columns to sort by: (column, asc | desc | asc_abs | desc_abs) pairs, nulls last, then the key."""
    out = []
    for name, direction in rank:
        column = F.abs(name) if direction.endswith("_abs") else F.col(name)
        out.append(column.asc_nulls_last() if direction.startswith("asc") else column.desc_nulls_last())
    return out + [F.col(k).asc_nulls_last() for k in key]


def top(df: DataFrame, rank: list[tuple[str, str]], key: list[str], limit: int, group_by: list[str] | None = None, most: int = 1000) -> DataFrame:
    """The first `limit` rows, of each group if groups are named (scores are then compared within groups only)."""
    checked_limit(limit, most)
    if not group_by:
        return df.orderBy(*keys(rank, key)).limit(limit)
    place = F.row_number().over(Window.partitionBy(*group_by).orderBy(*keys(rank, key)))
    return df.withColumn("place_", place).where(F.col("place_") <= limit).drop("place_")


def best_per(df: DataFrame, grain: list[str], rank: list[tuple[str, str]], key: list[str]) -> DataFrame:
    """The first row of each combination of the grain."""
    return top(df, rank, key, 1, grain)


def with_boundary(df: DataFrame, boundary: str, rank: list[tuple[str, str]], key: list[str], limit: int) -> DataFrame:
    """The first rows, going on to the end of the boundary group that the limit would split."""
    cut = top(df, rank, key, limit)
    return df.join(F.broadcast(cut.select(F.col(boundary).alias("kept_")).distinct()), F.col(boundary).eqNullSafe(F.col("kept_")), "left_semi")

"""Checks of tables: keys, nulls, references, relations, and the digest of a result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: null rows and all rows."""
    one = df.agg(F.count("*").alias("n_rows"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return one.unpivot(["n_rows"], columns, "column", "n_null").select("column", "n_null", "n_rows")


def dangling(df: DataFrame, column: str, target: DataFrame, key: str) -> DataFrame:
    """Known references that name no row of the target."""
    return df.where(F.col(column).isNotNull()).join(target.select(F.col(key).alias("target_")), F.col(column) == F.col("target_"), "left_anti")


def leaf_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: known rows, distinct values, least and greatest as text; from one pass."""
    one = df.agg(*(F.struct(F.lit(c).alias("column"), F.count(c).alias("n_known"), F.count_distinct(c).alias("n_distinct"), F.min(c).cast("string").alias("low"), F.max(c).cast("string").alias("high")).alias(f"c{i}") for i, c in enumerate(columns)))
    return one.select(F.explode(F.array(*(f"c{i}" for i in range(len(columns))))).alias("x")).select("x.*")


def digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows and an order-independent digest of them: sums of 32-bit pieces of each row's hash."""
    h = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns)), 256)
    return df.select(F.conv(F.substr(h, F.lit(1), F.lit(8)), 16, 10).cast("long").alias("h")).agg(F.count("*").alias("n_rows"), F.sum("h").alias("digest"))

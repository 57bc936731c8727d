"""Steps applied to answers: dates past a ceiling, unknowns, negation, levels, trims, flags, validity, scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor.functions.scalar import latest_day


class ScopeError(ValueError):
    """A summary that would pool values across a scope that was not fixed."""


def ceiling(df: DataFrame, available: str, changed: str | None, redacted: list[str], day: str) -> DataFrame:
    """Rows available by a day; columns changed later are withheld. A date that is missing or none keeps its row, marked.

    `unchecked` marks a row whose availability is unknown or unreadable, or whose date of change is there but unreadable.
    """
    limit = F.lit(day).cast("date")
    at = latest_day(F.col(available).cast("string"))
    out = df.where(at.isNull() | (at <= limit))
    unchecked = at.isNull()
    if changed:
        when = latest_day(F.col(changed).cast("string"))
        unchecked = unchecked | (F.col(changed).isNotNull() & when.isNull())
        late = F.coalesce(when > limit, F.lit(False))
        out = out.withColumns({"unchecked": unchecked} | {c: F.when(~late, F.col(c)) for c in redacted})
        return out
    return out.withColumn("unchecked", unchecked)


NEGATED = ("true", "1", "yes", "y", "not")


def is_negated(column: Column) -> Column:
    return F.coalesce(F.lower(column.cast("string")).isin(*NEGATED), F.lit(False))


def without_negated(df: DataFrame, flag: str) -> DataFrame:
    return df.where(~is_negated(F.col(flag)))


def levels(df: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """One row per level key with each value's smallest known one, and the number of values in conflict."""
    conflicts = sum((F.when(F.count_distinct(v) > 1, 1).otherwise(0) for v in values), F.lit(0))
    return df.groupBy(*key).agg(*(F.min(v).alias(v) for v in values), conflicts.cast("long").alias("conflicts"))


def trim(df: DataFrame, items: str, most: int) -> DataFrame:
    """Lists longer than `most` sorted and cut; the total is told where something was cut."""
    n = F.size(items)
    return df.withColumn("items_total", F.when(n > most, n)).withColumn(items, F.when(n > most, F.slice(F.array_sort(items), 1, most)).otherwise(F.col(items)))


def flag_partition(df: DataFrame, items: str, flag: str) -> DataFrame:
    """A list in three: items whose flag is met, not met, unknown."""
    return df.withColumns(
        {
            f"{items}_met": F.filter(items, lambda x: F.coalesce(x[flag], F.lit(False))),
            f"{items}_not_met": F.filter(items, lambda x: F.coalesce(~x[flag], F.lit(False))),
            f"{items}_unknown": F.filter(items, lambda x: x[flag].isNull()),
        }
    )


def valid(df: DataFrame, measures: list[str], low: float | None = None, high: float | None = None) -> DataFrame:
    """Measures that are not finite or out of scale become unknown."""

    def fine(c: Column) -> Column:
        ok = ~F.isnan(c) & (F.abs(c) != float("inf"))
        ok = ok & (c >= low) if low is not None else ok
        return ok & (c <= high) if high is not None else ok

    return df.withColumns({m: F.when(fine(F.col(m).cast("double")), F.col(m)) for m in measures})


def require_scope(df: DataFrame, scope: list[str]) -> None:
    """An error if a scope that is to be pooled has more than one value."""
    found = df.agg(*(F.count_distinct(c).alias(c) for c in scope)).first().asDict()
    open_ones = [c for c, n in found.items() if n > 1]
    if open_ones:
        raise ScopeError(f"fix {', '.join(open_ones)} first: values are not comparable across them")

"""find, lookup, search, vocab, aggregate, nest, split, compare, members, similar, pairs and their relatives."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candor.functions.scalar import cosine
from candor.operators.statistics import quantiles
from candor.plans.order import best_per, checked_limit, top
from candor.plans.predicate import unknown_counts, where


class VerbError(ValueError):
    """A request that cannot be answered as asked; it is never answered with an empty result instead."""


@dataclass
class Result:
    """Lazy rows, and what must be said about them (computed on demand over the unfiltered table)."""

    rows: DataFrame
    counts: DataFrame
    order: list[tuple[str, str]] = field(default_factory=list)

    def header(self) -> dict:
        return self.counts.first().asDict()


def find(table: DataFrame, preds: list[dict], rank: list[tuple[str, str]], key: list[str], limit: int = 50, group_by: list[str] | None = None, distinct: list[str] | None = None, grain: list[str] | None = None) -> Result:
    """Filter, then the best row of each grain and combination, then the first rows in order (per group)."""
    rows = table.where(where(table, *preds))
    if grain:
        rows = best_per(rows, grain, rank, key)
    if distinct:
        rows = best_per(rows, distinct, rank, key)
    return Result(top(rows, rank, key, limit, group_by), unknown_counts(table, *preds), rank)


def lookup(table: DataFrame, key: dict) -> DataFrame:
    """The rows of one key; every part of the key must be given and known."""
    if not key or any(v is None for v in key.values()):
        raise VerbError("incomplete_key")
    return table.where(where(table, *({"eq": [k, v]} for k, v in key.items())))


MATCHES = ["exact", "casefold", "prefix", "word", "substring"]


def search(table: DataFrame, leaves: list[str], text: str, key: list[str], limit: int = 20) -> DataFrame:
    """Rows whose labels match the text, by the best class of match, then the order of the leaves, then the key."""
    checked_limit(limit)
    ranks = []
    for at, leaf in enumerate(leaves):
        low, folded = F.lower(leaf), text.lower()
        found = (
            F.when(F.col(leaf) == text, 0).when(low == folded, 1).when(low.startswith(folded), 2).when(where(table, {"text": [leaf, text, "word"]}), 3).when(low.contains(folded), 4)
        )
        ranks.append(F.when(found.isNotNull(), F.struct(found.alias("match_rank"), F.lit(at).alias("leaf"))))
    best = F.least(*ranks) if len(ranks) > 1 else ranks[0]
    hits = table.withColumn("best_", best).where("best_ is not null").orderBy("best_.match_rank", "best_.leaf", *key).limit(limit)
    return hits.withColumn("match_class", F.element_at(F.array(*map(F.lit, MATCHES)), F.col("best_.match_rank") + 1)).drop("best_")


def vocab(table: DataFrame, column: str, most: int = 100_000) -> DataFrame:
    """Distinct known values with their counts; more than `most` of them are an error, never a part of the answer."""
    found = table.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    if found.limit(most + 1).count() > most:
        raise VerbError(f"more than {most} values of {column}")
    return found.orderBy("value")


def combined(value: Column, how: str, cutoff: float | None = None) -> Column:
    """One value of known ones: the ways that statistics combine."""
    ways = {
        "count": lambda: F.count(value),
        "count_distinct": lambda: F.count_distinct(value),
        "sum": lambda: F.sum(value),
        "mean": lambda: F.avg(value),
        "median": lambda: F.median(value),
        "min": lambda: F.min(value),
        "max": lambda: F.max(value),
        "max_abs": lambda: F.max_by(value, F.abs(value)),
        "geometric_mean": lambda: F.exp(F.avg(F.ln(F.when(value > 0, value)))),
        "share_at_most": lambda: F.avg(F.when(value.isNotNull(), (value <= cutoff).cast("double"))),
    }
    if how not in ways:
        raise VerbError(f"no aggregation {how}")
    return ways[how]()


def aggregate(table: DataFrame, group_by: list[str], measure: str, how: str, preds: list[dict] = (), min_n: int = 1, cutoff: float | None = None) -> DataFrame:
    """Per group (a null key is a group): value, n known and n unknown; groups with fewer than min_n known are dropped."""
    rows = table.where(where(table, *preds)) if preds else table
    v = F.col(measure)
    if how == "median":  # through counts of distinct values: no task holds all values of a group
        middle = quantiles(rows, group_by, measure, [0.5]).withColumnsRenamed({g: f"{g}_of_" for g in group_by}).withColumnRenamed("q0", "value")
        counted = rows.groupBy(*group_by).agg(F.count(v).alias("n"), F.count_if(v.isNull()).alias("n_unknown")).where(F.col("n") >= min_n)
        same = [F.col(g).eqNullSafe(F.col(f"{g}_of_")) for g in group_by]
        return (counted.join(middle, same, "left") if same else counted.join(F.broadcast(middle))).select(*group_by, "value", "n", "n_unknown")
    out = rows.groupBy(*group_by).agg(combined(v, how, cutoff).alias("value"), F.count(v).alias("n"), F.count_if(v.isNull()).alias("n_unknown"))
    return out.where(F.col("n") >= min_n)


def nest(table: DataFrame, group_by: list[str], items: list[str], item_order: list[str], having: int = 1) -> DataFrame:
    """One row per group with its items in order, for groups of at least `having` items."""
    entry = F.struct(*item_order, *(c for c in items if c not in item_order))
    out = table.groupBy(*group_by).agg(F.sort_array(F.collect_list(entry)).alias("items"))
    return out.withColumn("n_items", F.size("items").cast("long")).where(F.col("n_items") >= having)


def split_by_sign(table: DataFrame, value: str, key: list[str], per_list: int) -> DataFrame:
    """The strongest positive and negative rows; zero and unknown are in neither list."""
    signed = table.where(F.col(value) != 0).withColumn("sign", F.when(F.col(value) > 0, "positive").otherwise("negative"))
    return top(signed, [(value, "desc_abs")], key, per_list, ["sign"])


def distinct_pairs(table: DataFrame, a: str, b: str) -> DataFrame:
    """The number of different unordered pairs; a missing part makes no pair."""
    return table.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.count_distinct(F.least(a, b), F.greatest(a, b)).alias("n_pairs"))


def compare_sets(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Every key of either side once (null parts are equal), with where it is found: left_only, right_only or both."""
    both = left.select(*key, F.lit(1).alias("side_")).unionByName(right.select(*key, F.lit(2).alias("side_"))).groupBy(*key).agg(F.min("side_").alias("low_"), F.max("side_").alias("high_"))
    return both.select(*key, F.when(F.col("low_") < F.col("high_"), "both").when(F.col("low_") == 1, "left_only").otherwise("right_only").alias("side"))


def similar(table: DataFrame, key: str, vector: str, anchor, limit: int) -> DataFrame:
    """The rows most similar to an anchor by cosine, ranked unrounded; the anchor itself and zero vectors are left out.

    An anchor that is not there, or has no direction, is an error, not an empty answer.
    """
    checked_limit(limit)
    one = table.where(F.col(key) == anchor).select(vector).first()
    if one is None or not one[0] or any(x is None for x in one[0]) or not any(one[0]):
        raise VerbError(f"no usable vector for anchor {anchor}")
    given = F.array(*(F.lit(float(x)) for x in one[0]))
    scored = table.where(F.col(key) != anchor).withColumn("anchor_", given).withColumn("score_", cosine(vector, "anchor_")).where("score_ is not null")
    return scored.orderBy(F.desc("score_"), key).limit(limit).select(key, F.round("score_", 12).alias("score"))


def pair_similarity(table: DataFrame, key: str, vector: str, a, b) -> DataFrame:
    left = table.where(F.col(key) == a).select(F.col(key).alias("a"), F.col(vector).alias("va"))
    right = table.where(F.col(key) == b).select(F.col(key).alias("b"), F.col(vector).alias("vb"))
    return left.join(F.broadcast(right)).select("a", "b", F.round(cosine("va", "vb"), 12).alias("score"))


def _joined(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """A full outer join on keys whose null parts are equal."""
    names = {k: f"{k}_of_right_" for k in key}
    met = left.withColumn("has_left_", F.lit(True)).join(right.withColumnsRenamed(names).withColumn("has_right_", F.lit(True)), [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()], "full_outer")
    return met.withColumns({k: F.coalesce(k, n) for k, n in names.items()}).drop(*names.values())


def paired(a: DataFrame, b: DataFrame, context: list[str], item: str, effect: str, most_padj: float | None = None, padj: str = "padj", above: float | None = None) -> DataFrame:
    """Contrasts of two conditions within a context: pairs of one item on both sides, and items on one side only.

    `most_padj` keeps rows at or below it, `above` those of a strictly greater absolute effect (0 and None: all).
    """
    key = [*context, item]

    def kept(rows: DataFrame, out: str) -> DataFrame:
        if most_padj is not None:
            rows = rows.where(F.col(padj) <= most_padj)
        if above:
            rows = rows.where(F.abs(effect) > above)
        return rows.select(*key, F.col(effect).alias(out))

    kind = F.when(F.col("has_right_").isNull(), "unique_to_a").when(F.col("has_left_").isNull(), "unique_to_b").when(F.signum("effect_a") == F.signum("effect_b"), "same_direction").otherwise("opposite_direction")
    return _joined(kept(a, "effect_a"), kept(b, "effect_b"), key).withColumn("kind", kind).drop("has_left_", "has_right_")


def selectivity(table: DataFrame, item: str, unit: str, target, effect: str) -> DataFrame:
    """Per item: the effect in the target unit, the mean absolute effect elsewhere, their ratio; exclusive if nowhere else."""
    here = table.where(F.col(unit) == target).groupBy(item).agg(F.max_by(effect, F.abs(effect)).alias("effect"))
    there = table.where(F.col(unit) != target).groupBy(item).agg(F.avg(F.abs(effect)).alias("elsewhere"), F.count_distinct(unit).alias("n_elsewhere"))
    out = here.join(there, item, "left")
    return out.select(item, "effect", "elsewhere", F.coalesce("n_elsewhere", F.lit(0)).alias("n_elsewhere"), F.try_divide(F.abs("effect"), "elsewhere").alias("ratio"), F.col("elsewhere").isNull().alias("exclusive"))


def specificity(table: DataFrame, item: str, unit: str, value: str, target) -> DataFrame:
    """The target unit's value against the median of the other units; a median of zero gives no fold."""
    others = table.where((F.col(unit) != target) & F.col(unit).isNotNull()).groupBy(item).agg(F.median(value).alias("median_other"), F.count("*").alias("n_other"))
    mine = table.where(F.col(unit) == target).select(item, F.col(value).alias("target_value"))
    return mine.join(others, item).select(item, "target_value", "median_other", "n_other", F.when(F.col("median_other") != 0, F.col("target_value") / F.col("median_other")).alias("fold"))


def level_groups(table: DataFrame, group: str, unit: str, effect: str, cutoff: float, min_units: int) -> DataFrame:
    """Mean effect, the share at or below the cutoff and the units with the lowest effects, for groups of enough units."""
    order = [F.col(effect).asc_nulls_last(), F.col(unit)]
    dealt = table.withColumn("salt_", F.pmod(F.xxhash64(unit), F.lit(64)))
    lowest = dealt.withColumn("place_", F.row_number().over(Window.partitionBy(group, "salt_").orderBy(*order))).where("place_ <= 5")
    lowest = lowest.withColumn("place_", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("place_ <= 5")
    first = lowest.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place_", unit))), lambda x: x[unit].cast("string")), ",").alias("lowest"))
    out = table.groupBy(group).agg(F.count_distinct(F.when(F.col(effect).isNotNull(), F.col(unit))).alias("n_units"), F.avg(effect).alias("mean_effect"), combined(F.col(effect), "share_at_most", cutoff).alias("share"))
    return out.where(F.col("n_units") >= min_units).join(first, group)


def water_fill(sizes: DataFrame, group: list[str], total: int | Column, out: str = "quota_") -> DataFrame:
    """Groups (with n_) to whole quotas that sum to `total` or all rows: even shares, what small groups leave going to the others.

    Within a parent (`group` but the last) groups are filled in order of size, then of name; the last units go to the first.
    """
    parent = group[:-1] or [F.lit(0)]
    by_size = Window.partitionBy(*parent).orderBy("n_", group[-1])
    rows = sizes.withColumn("total_", F.least(F.lit(total) if isinstance(total, int) else total, F.sum("n_").over(Window.partitionBy(*parent))))
    rows = rows.withColumn("before_", F.coalesce(F.sum("n_").over(by_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("left_", F.count("*").over(Window.partitionBy(*parent)) - F.row_number().over(by_size) + 1)
    full = F.col("n_") * F.col("left_") <= F.col("total_") - F.col("before_")
    rows = rows.withColumn("full_", F.min(full.cast("int")).over(by_size.rowsBetween(Window.unboundedPreceding, Window.currentRow)) == 1)
    rest = Window.partitionBy(*parent, "full_")
    rows = rows.withColumn("spare_", F.col("total_") - F.coalesce(F.sum(F.when(F.col("full_"), F.col("n_"))).over(Window.partitionBy(*parent)), F.lit(0))).withColumn("among_", F.count("*").over(rest))
    rows = rows.withColumn("place_", F.row_number().over(rest.orderBy(group[-1])))
    even = F.floor(F.col("spare_") / F.col("among_")) + (F.col("place_") <= F.col("spare_") % F.col("among_")).cast("long")
    return rows.select(*group, "n_", F.when(F.col("full_"), F.col("n_")).otherwise(even).alias(out))


def balanced_sample(table: DataFrame, outer: str, inner: str, key: str, rows: int) -> DataFrame:
    """`rows` rows (all if there are fewer), spread evenly over outer groups and then over their inner groups, by hash order of the key.

    What small groups cannot give, others do.
    """
    sizes = table.groupBy(outer, inner).agg(F.count("*").alias("n_"))
    outside = water_fill(sizes.groupBy(outer).agg(F.sum("n_").alias("n_")), [outer], rows, "of_outer_").select(F.col(outer).alias("key_"), "of_outer_")
    shares = water_fill(sizes.join(outside, F.col(outer).eqNullSafe(F.col("key_"))).drop("key_"), [outer, inner], F.col("of_outer_"))
    shares = shares.select(F.col(outer).alias("o_"), F.col(inner).alias("i_"), "quota_")
    dealt = table.join(shares, F.col(outer).eqNullSafe(F.col("o_")) & F.col(inner).eqNullSafe(F.col("i_"))).withColumns({"hash_": F.xxhash64(key), "salt_": F.pmod(F.xxhash64(F.lit(3), key), F.lit(64))})
    for by in ([outer, inner, "salt_"], [outer, inner]):  # first in 64 parts of each group, so that no task sorts a whole large one
        dealt = dealt.withColumn("place_", F.row_number().over(Window.partitionBy(*by).orderBy("hash_", key))).where("place_ <= quota_")
    return dealt.select(table.columns)


def release_diff(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Keys (null parts are equal) added, removed or changed between two releases."""
    both = _joined(old.select(*key, F.struct(*columns).alias("old_")), new.select(*key, F.struct(*columns).alias("new_")), key)
    kind = F.when(F.col("has_left_").isNull(), "added").when(F.col("has_right_").isNull(), "removed").when(~F.col("old_").eqNullSafe(F.col("new_")), "changed")
    return both.withColumn("change", kind).where("change is not null").select(*key, "change")

"""Statistics over groups: corrections, enrichment, survival, correlation, ranks and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candor.functions.scalar import hypergeometric_tail


def adjusted(df: DataFrame, p: str, family: list[str], out: str = "q", m: int | None = None) -> DataFrame:
    """Benjamini-Hochberg q-values within each family (of at least `m` tests); unknown p-values get none.

    Ranks run over the distinct p-values with their counts, so a large family of few values is no large window.
    """
    by = family or [F.lit(0)]
    counts = df.where(F.col(p).isNotNull()).groupBy(*family, p).agg(F.count("*").alias("same_"))
    up = Window.partitionBy(*by).orderBy(p)
    total = F.sum("same_").over(Window.partitionBy(*by))
    raw = F.col(p) * (F.greatest(total, F.lit(m)) if m else total) / F.sum("same_").over(up)
    step = F.min("raw_").over(Window.partitionBy(*by).orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    found = counts.withColumn("raw_", raw).select(*(F.col(c).alias(f"{c}_of_") for c in family), F.col(p).alias("p_of_"), F.least(F.lit(1.0), step).alias(out))
    same = F.col(p) == F.col("p_of_")
    for c in family:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_of_"))
    return df.join(found, same, "left").drop(*(f"{c}_of_" for c in family), "p_of_")


def enrich(sets: DataFrame, set_id: str, member: str, query: DataFrame, universe: DataFrame, min_size: int, max_size: int) -> DataFrame:
    """Over-representation of a query within a universe: every set of the family, overlap zero included, p and q."""
    inside = sets.select(set_id, member).distinct().join(universe.select(F.col(universe.columns[0]).alias("u_")).distinct(), F.col(member) == F.col("u_"), "left_semi")
    asked = query.select(F.col(query.columns[0]).alias("q_")).distinct().join(universe.select(F.col(universe.columns[0]).alias("u_")).distinct(), F.col("q_") == F.col("u_"), "left_semi")
    totals = universe.select(F.count_distinct(universe.columns[0]).alias("total")).join(F.broadcast(asked.agg(F.count("*").alias("drawn"))))
    sizes = inside.join(asked, F.col(member) == F.col("q_"), "left").groupBy(set_id).agg(F.count("*").alias("size"), F.count("q_").alias("overlap")).where(F.col("size").between(min_size, max_size))
    scored = sizes.join(F.broadcast(totals)).withColumn("expected", F.col("size") * F.col("drawn") / F.col("total")).withColumn("p", hypergeometric_tail("overlap", "drawn", "size", "total"))
    return adjusted(scored, "p", []).withColumn("fold", F.try_divide("overlap", "expected"))


def survival_curve(df: DataFrame, group: str, time: str, event: str) -> DataFrame:
    """Product-limit survival at each event time; censored rows leave after the events of their time."""
    counts = df.where(F.col(time).isNotNull() & F.col(event).isNotNull()).groupBy(group, time).agg(F.sum(F.col(event).cast("int")).alias("d"), F.count("*").alias("leave"))
    w = Window.partitionBy(group).orderBy(time)
    at_risk = F.sum("leave").over(Window.partitionBy(group)) - F.coalesce(F.sum("leave").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = counts.withColumn("at_risk", at_risk)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dead = F.max((F.col("d") == F.col("at_risk")).cast("int")).over(so_far)
    log = F.sum(F.when(F.col("d") < F.col("at_risk"), F.log1p(-F.col("d") / F.col("at_risk"))).otherwise(0.0)).over(so_far)
    return steps.withColumn("survival", F.when(dead == 1, 0.0).otherwise(F.exp(log))).where("d > 0")


def survival_median(curve: DataFrame, group: str, time: str) -> DataFrame:
    return curve.groupBy(group).agg(F.min(F.when(F.col("survival") <= 0.5 + 1e-12, F.col(time))).alias("median_time"))


def pearson(x: str, y: str) -> Column:
    """Null for fewer than three pairs or no variance, and never beyond -1 and 1."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.when(F.count_if(both) >= 3, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def tau(df: DataFrame, item: str, value: str) -> DataFrame:
    """Specificity of each item over its units: 0 is even, 1 is one unit; null for one unit or no positive value."""
    out = df.groupBy(item).agg(F.count(value).alias("n"), F.max(value).alias("m"), F.sum(value).alias("s"))
    return out.select(item, F.when((F.col("n") >= 2) & (F.col("m") > 0), (F.col("n") - F.col("s") / F.col("m")) / (F.col("n") - 1)).alias("tau"))


def bimodality(df: DataFrame, group: str, value: str) -> DataFrame:
    """Sarle's coefficient of the positive values, bias-corrected; null for fewer than four or no variance."""
    x = F.when(F.col(value) > 0, F.col(value).cast("double"))
    out = df.groupBy(group).agg(F.count(x).cast("double").alias("n"), F.skewness(x).alias("g"), F.kurtosis(x).alias("k"))
    n = F.col("n")
    g1 = F.col("g") * F.sqrt(n * (n - 1)) / (n - 2)
    g2 = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("k") + 6)
    return out.select(group, F.when((n >= 4) & F.col("g").isNotNull(), (g1 * g1 + 1) / (g2 + 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3)))).alias("bc"))


def auc(df: DataFrame, group: list[str], score: str, label: str) -> DataFrame:
    """Area under the curve from midranks of the distinct scores, with DeLong's variance; null without both labels."""
    by = group or [F.lit(0)]
    cells = df.where(F.col(score).isNotNull() & F.col(label).isin(0, 1)).groupBy(*group, score).agg(F.count_if(F.col(label) == 1).alias("p_"), F.count_if(F.col(label) == 0).alias("n_"))
    up = Window.partitionBy(*by).orderBy(score)
    every = Window.partitionBy(*by)
    cells = cells.withColumns({"below_": F.sum("n_").over(up) - F.col("n_") / 2, "over_": F.sum("p_").over(every) - F.sum("p_").over(up) + F.col("p_") / 2, "all_p_": F.sum("p_").over(every), "all_n_": F.sum("n_").over(every)})
    cells = cells.withColumns({"v10": F.try_divide("below_", "all_n_"), "v01": F.try_divide("over_", "all_p_")})
    out = cells.groupBy(*group).agg(F.sum("p_").alias("n_positive"), F.sum("n_").alias("n_negative"), F.sum(F.col("p_") * F.col("v10")).alias("s1"), F.sum(F.col("p_") * F.col("v10") ** 2).alias("q1"), F.sum(F.col("n_") * F.col("v01")).alias("s0"), F.sum(F.col("n_") * F.col("v01") ** 2).alias("q0"))
    area = F.try_divide("s1", "n_positive")
    spread = lambda q, s, n: F.try_divide(F.col(q) - F.col(s) * F.col(s) / F.col(n), F.col(n) - 1)
    both = (F.col("n_positive") > 0) & (F.col("n_negative") > 0)
    variance = F.when((F.col("n_positive") > 1) & (F.col("n_negative") > 1), spread("q1", "s1", "n_positive") / F.col("n_positive") + spread("q0", "s0", "n_negative") / F.col("n_negative"))
    return out.select(*group, "n_positive", "n_negative", F.when(both, area).alias("auc"), F.when(both, variance).alias("variance"))


def odds(df: DataFrame, group: list[str], exposed: Column, outcome: Column) -> DataFrame:
    """The 2 x 2 table and its odds ratio with a 95 % interval; null where a cell is empty."""
    cells = df.groupBy(*group).agg(F.count_if(exposed & outcome).alias("a"), F.count_if(exposed & ~outcome).alias("b"), F.count_if(~exposed & outcome).alias("c"), F.count_if(~exposed & ~outcome).alias("d"))
    full = (F.col("a") > 0) & (F.col("b") > 0) & (F.col("c") > 0) & (F.col("d") > 0)
    ratio = F.when(full, F.col("a") * F.col("d") / (F.col("b") * F.col("c")))
    error = F.when(full, F.sqrt(1 / F.col("a") + 1 / F.col("b") + 1 / F.col("c") + 1 / F.col("d")))
    return cells.select(*group, "a", "b", "c", "d", ratio.alias("odds_ratio"), F.exp(F.ln(ratio) - 1.959964 * error).alias("low"), F.exp(F.ln(ratio) + 1.959964 * error).alias("high"))


def quantiles(df: DataFrame, group: list[str], value: str, shares: list[float]) -> DataFrame:
    """Exact quantiles with linear interpolation, q0, q1, ... of each group: found among the distinct values by their running counts."""
    by = group or [F.lit(0)]
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).cast("double").alias("v_")).agg(F.count("*").alias("c_"))
    up = Window.partitionBy(*by).orderBy("v_")
    placed = counts.withColumns({"to_": F.sum("c_").over(up), "n_": F.sum("c_").over(Window.partitionBy(*by))})
    found = []
    for i, share in enumerate(shares):
        at = (F.col("n_") - 1) * F.lit(share)
        for j, place in enumerate((F.floor(at), F.ceil(at))):
            found.append(F.max(F.when((F.col("to_") > place) & (F.col("to_") - F.col("c_") <= place), F.col("v_"))).alias(f"x{i}_{j}"))
        found.append(F.max(at - F.floor(at)).alias(f"f{i}"))
    out = placed.groupBy(*group).agg(*found)
    return out.select(*group, *((F.col(f"x{i}_0") + F.col(f"f{i}") * (F.col(f"x{i}_1") - F.col(f"x{i}_0"))).alias(f"q{i}") for i in range(len(shares))))


def quartile_split(df: DataFrame, group: str, value: str) -> DataFrame:
    """Rows at or beyond the exact lower and upper quartiles of their group."""
    out = df.join(quantiles(df, [group], value, [0.25, 0.75]), group)
    return out.withColumn("part", F.when(F.col(value) <= F.col("q0"), "low").when(F.col(value) >= F.col("q1"), "high")).where("part is not null").drop("q0", "q1")


def z_scores(df: DataFrame, group: str, value: str) -> DataFrame:
    """Standardised within the group by the sample deviation; null where there is none."""
    facts = df.groupBy(F.col(group).alias("of_")).agg(F.avg(value).alias("mean_"), F.stddev_samp(value).alias("sd_"))
    out = df.join(facts, F.col(group).eqNullSafe(F.col("of_")))
    return out.withColumn("z", F.try_divide(F.col(value) - F.col("mean_"), F.nullif("sd_", F.lit(0.0)))).drop("of_", "mean_", "sd_")


def two_means(df: DataFrame, group: str, value: str) -> DataFrame:
    """The exact split of each group's values into two clusters of least squares, by prefix sums."""
    w = Window.partitionBy(group).orderBy(value)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(group)
    counted = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    x = F.col(value).cast("double")
    sums = counted.select(group, value, F.sum("c").over(run).alias("n1"), F.sum(x * F.col("c")).over(run).alias("s1"), F.sum("c").over(every).alias("n"), F.sum(x * F.col("c")).over(every).alias("s"), F.lead(value).over(w).alias("next"))
    gain = F.col("s1") * F.col("s1") / F.col("n1") + (F.col("s") - F.col("s1")) * (F.col("s") - F.col("s1")) / (F.col("n") - F.col("n1"))
    best = sums.where("next is not null").groupBy(group).agg(F.max_by(F.struct((F.col(value) + F.col("next")).alias("twice"), "n1", "n"), F.struct(F.round(gain, 6), -F.col(value))).alias("at"))
    return best.select(group, (F.col("at.twice") / 2).alias("threshold"), F.col("at.n1").alias("n_low"), (F.col("at.n") - F.col("at.n1")).alias("n_high"))


def pseudobulk(df: DataFrame, group: list[str], cell: str, value: str, min_cells: int) -> DataFrame:
    """Sum, mean log2 of counts per ten thousand and detection share over the cells of each group, for enough cells."""
    depth = df.groupBy(*group, cell).agg(F.sum(value).alias("depth_"))
    share = F.log2(1 + 1e4 * F.try_divide(F.col(value), "depth_"))
    out = df.join(depth, [*group, cell]).withColumn("log_", share).groupBy(*group).agg(F.count_distinct(cell).alias("n_cells"), F.sum(value).alias("total"), F.avg("log_").alias("mean_log2"), F.avg((F.col(value) > 0).cast("double")).alias("detected"))
    return out.where(F.col("n_cells") >= min_cells)


def midranks(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Ascending ranks within the group, those of ties averaged, over its distinct values; null for unknown values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("same_"))
    by = Window.partitionBy(*(group or [F.lit(0)])).orderBy(value)
    ranks = counts.withColumn("midrank", F.sum("same_").over(by) - (F.col("same_") - 1) / 2)
    return df.join(ranks.drop("same_"), [*group, value], "left")


def proportions(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Each value's share of its group's total; null where the total is zero."""
    totals = df.groupBy(*group).agg(F.sum(value).alias("total_"))
    return df.join(totals, group).withColumn("share", F.try_divide(F.col(value), F.nullif(F.col("total_"), F.lit(0)))).drop("total_")


def top_fraction(df: DataFrame, measures: list[str], fraction: float) -> DataFrame:
    """Rows at or above the exact upper quantile of every measure."""
    out = df
    for i, m in enumerate(measures):
        out = out.join(F.broadcast(quantiles(df, [], m, [1 - fraction]).withColumnRenamed("q0", f"cut_{i}"))).where(F.col(m) >= F.col(f"cut_{i}"))
    return out.select(*df.columns)


def quotas(df: DataFrame, group: str, total: int) -> DataFrame:
    """Each group's size and its part of `total` in proportion, whole numbers by largest remainders (ties by group)."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    every = sizes.agg(F.sum("n").alias("rows_"))
    exact = sizes.join(F.broadcast(every)).withColumn("want_", F.least(F.lit(total), F.col("rows_"))).withColumn("scaled_", F.col("n") * F.col("want_"))
    parts = exact.select(group, "n", "want_", F.floor(F.col("scaled_") / F.col("rows_")).alias("floor_"), (F.col("scaled_") % F.col("rows_")).alias("left_"))
    spare = F.col("want_") - F.sum("floor_").over(Window.partitionBy(F.lit(0)))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("left_"), group))
    return parts.select(group, "n", (F.col("floor_") + (place <= spare).cast("long")).alias("quota"))


def downsample(df: DataFrame, group: str, key: str, total: int) -> DataFrame:
    """`total` rows spread over the groups in proportion, chosen within each by a hash of the key."""
    share = quotas(df, group, total).select(group, "quota")
    dealt = df.join(share, group).withColumns({"hash_": F.xxhash64(key), "salt_": F.pmod(F.xxhash64(F.lit(3), key), F.lit(64))})
    for by in ([group, "salt_"], [group]):  # first in 64 parts of each group, so that no task sorts a whole large one
        dealt = dealt.withColumn("place_", F.row_number().over(Window.partitionBy(*by).orderBy("hash_", key))).where("place_ <= quota")
    return dealt.drop("place_", "quota", "hash_", "salt_")

"""Relational analyses: cells and pseudobulks, cohorts, trials and targets, spatial neighbours, tables compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def qc_filter(cells: DataFrame, cell: str, gene: str, count: str, least_genes: int, most_genes: int, marked: Column, most_share: float) -> DataFrame:
    """Cells that detect enough genes but not too many, and whose share of counts in marked genes is not too high."""
    facts = cells.groupBy(cell).agg(F.count_distinct(F.when(F.col(count) > 0, F.col(gene))).alias("n_genes"), F.try_divide(F.sum(F.when(marked, F.col(count)).otherwise(0)), F.sum(count)).alias("share"))
    return facts.where(F.col("n_genes").between(least_genes, most_genes) & (F.coalesce("share", F.lit(0.0)) <= most_share))


def normalise_log1p(cells: DataFrame, cell: str, count: str, scale: float = 1e4) -> DataFrame:
    """Counts as ln(1 + scale * share of the cell's total)."""
    depth = cells.groupBy(cell).agg(F.sum(count).alias("depth_"))
    return cells.join(depth, cell).withColumn("value", F.log1p(scale * F.try_divide(F.col(count), "depth_"))).drop("depth_")


def eligible_types(cells: DataFrame, kind: str, level: str, donor: str, levels: list, least_donors: int, least_cells: int) -> DataFrame:
    """Kinds of which every level has enough donors with enough cells."""
    donors = cells.where(F.col(level).isin(levels)).groupBy(kind, level, donor).agg(F.count("*").alias("n_")).where(F.col("n_") >= least_cells)
    enough = donors.groupBy(kind, level).agg(F.count("*").alias("d_")).where(F.col("d_") >= least_donors)
    return enough.groupBy(kind).agg(F.count("*").alias("k_"), F.min("d_").alias("least_donors")).where(F.col("k_") == len(set(levels))).drop("k_")


def arm_counts(rows: DataFrame, group: str, arm: Column, donor: str, dataset: str, least_donors: int, least_datasets: int = 1) -> DataFrame:
    """Groups with enough different donors in both arms, and enough datasets."""
    out = rows.groupBy(group).agg(F.count_distinct(F.when(arm, F.col(donor))).alias("n_cases"), F.count_distinct(F.when(~arm, F.col(donor))).alias("n_controls"), F.count_distinct(dataset).alias("n_datasets"))
    return out.where((F.col("n_cases") >= least_donors) & (F.col("n_controls") >= least_donors) & (F.col("n_datasets") >= least_datasets))


def without_overlap(cases: DataFrame, controls: DataFrame, donor: str) -> DataFrame:
    """Controls whose donor is no case."""
    return controls.join(cases.select(donor).distinct(), donor, "left_anti")


def prioritised(rows: DataFrame, normals: DataFrame, within: str, levels: list[str], key: str, normal_key: str) -> DataFrame:
    """For each row the normals of its `within` that agree in the first level that has any (else all of them): key, normal_key, level."""
    left = rows.select(key, within, *levels)
    right = normals.select(normal_key, within, *(F.col(c).alias(f"{c}_n_") for c in levels))
    rank = F.coalesce(*(F.when(F.col(c) == F.col(f"{c}_n_"), i) for i, c in enumerate(levels)), F.lit(len(levels)))
    sides = []  # one equi-join a level, so that a large `within` is paired in full only where nothing agrees
    done = None
    for i, c in enumerate(levels):
        rest = left if done is None else left.join(done, key, "left_anti")
        met = rest.join(right, (rest[within] == right[within]) & (rest[c] == right[f"{c}_n_"])).select(key, normal_key, F.lit(i).alias("level"))
        sides.append(met)
        own = met.select(key).distinct()
        done = own if done is None else done.unionByName(own)
    rest = left.join(done, key, "left_anti") if done is not None else left
    sides.append(rest.join(right, within).select(key, normal_key, F.when(rank >= 0, len(levels)).alias("level")))
    out = sides[0]
    for side in sides[1:]:
        out = out.unionByName(side)
    return out


def compared(ours: DataFrame, theirs: DataFrame, key: list[str], value: str, tolerance: float) -> DataFrame:
    """Their rows with ours beside them: status missing, unknown, equal (within the tolerance) or different, and the difference."""
    mine = ours.select(*key, F.col(value).cast("double").alias("ours"), F.lit(True).alias("there_"))
    both = theirs.select(*key, F.col(value).cast("double").alias("theirs")).join(mine, key, "left")
    gap = F.abs(F.col("ours") - F.col("theirs"))
    status = F.when(F.col("there_").isNull(), "missing").when(gap.isNull(), F.when(F.col("ours").isNull() & F.col("theirs").isNull(), "equal").otherwise("unknown")).when(gap <= tolerance, "equal").otherwise("different")
    return both.select(*key, "ours", "theirs", gap.alias("difference"), status.alias("status"))


def collapse_probes(values: DataFrame, probes: DataFrame, probe: str, gene: str, sample: str, value: str) -> DataFrame:
    """Mean over the probes of a gene in each sample; probes of several genes are left out."""
    single = probes.where(F.col(gene).isNotNull()).groupBy(probe).agg(F.count_distinct(gene).alias("n_"), F.min(gene).alias(gene)).where("n_ = 1").drop("n_")
    return values.join(single, probe).groupBy(gene, sample).agg(F.avg(value).alias(value))


def hop(values: DataFrame, column: str, crosswalk: DataFrame, source: str, target: str) -> DataFrame:
    """Each value's counterpart by a crosswalk: mapped, ambiguous (several) or not_found."""
    met = values.select(column).distinct().join(crosswalk.select(F.col(source).alias("from_"), F.col(target).alias("to_")).where("to_ is not null"), F.col(column) == F.col("from_"), "left")
    out = met.groupBy(column).agg(F.count_distinct("to_").alias("n_"), F.min("to_").alias("to_"))
    return out.select(column, F.when(F.col("n_") == 1, F.col("to_")).alias("target"), F.when(F.col("n_") == 1, "mapped").when(F.col("n_") > 1, "ambiguous").otherwise("not_found").alias("status"))


def one_per_level(rows: DataFrame, level: list[str], value: str) -> DataFrame:
    """One known value for each level key (the smallest), and whether there were several."""
    return rows.groupBy(*level).agg(F.min(value).alias(value), (F.count_distinct(value) > 1).alias("conflict"))


def ordinal(rows: DataFrame, group: list[str], value: str, levels: list[str], how: str) -> DataFrame:
    """Least, greatest or lower median of ordered levels; values that are no level are unknown."""
    at = F.array_position(F.array(*map(F.lit, levels)), F.col(value))
    counts = rows.withColumn("at_", F.when(at > 0, at)).where("at_ is not null").groupBy(*group, "at_").agg(F.count("*").alias("c_"))
    if how in ("min", "max"):
        best = counts.groupBy(*group).agg((F.min if how == "min" else F.max)("at_").alias("at_"))
    else:
        by = group or [F.lit(0)]
        placed = counts.withColumns({"to_": F.sum("c_").over(Window.partitionBy(*by).orderBy("at_")), "n_": F.sum("c_").over(Window.partitionBy(*by))})
        best = placed.where(F.col("to_") >= F.ceil(F.col("n_") / 2)).groupBy(*group).agg(F.min("at_").alias("at_"))
    return best.select(*group, F.element_at(F.array(*map(F.lit, levels)), F.col("at_").cast("int")).alias("value"))


def least_p(rows: DataFrame, group: list[str], mantissa: str, exponent: str) -> DataFrame:
    """The smallest p-value of each group by mantissa and exponent, below the range of doubles too."""
    known = F.col(mantissa).isNotNull() & F.col(exponent).isNotNull()
    return rows.where(known).groupBy(*group).agg(F.min(F.struct((F.log10(mantissa) + F.col(exponent)).alias("rank"), mantissa, exponent)).alias("best")).select(*group, f"best.{mantissa}", f"best.{exponent}")


def _finite(*columns: str) -> Column:
    return F.coalesce(sum((F.abs(F.col(c).cast("double")) for c in columns), F.lit(0.0)) < float("inf"), F.lit(False))


def _first_of(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    return rows.withColumn("n_", F.row_number().over(Window.partitionBy(*by).orderBy("k_"))).where(F.col("n_") <= most).drop("n_")


def _around(rows: DataFrame, reach: int) -> DataFrame:
    """Each row once for every cell within `reach` of its own."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    return rows.withColumn("i_", F.explode(steps)).withColumn("j_", F.explode(steps)).withColumns({"cx_": F.col("cx_") + F.col("i_"), "cy_": F.col("cy_") + F.col("j_")}).drop("i_", "j_")


def _near(placed: DataFrame, asked: DataFrame, most: int) -> DataFrame:
    """Points (s_, k_, x_, y_) that may be among the `most` nearest of each query (s_, q_, qx_, qy_); all places are finite."""
    wide = F.greatest(*(F.max(c).cast("double") - F.min(c).cast("double") for c in ("x_", "y_")))
    span = placed.groupBy("s_").agg(F.min("x_").alias("x0_"), F.min("y_").alias("y0_"), wide.alias("span_"), F.count("*").alias("n_"))
    levels = F.sequence(F.lit(0), F.ceil(F.log2("n_") / 2).cast("int") + 2)

    def cells(rows: DataFrame, *places: str) -> DataFrame:
        last = F.pow(F.lit(2.0), "level_") - 1
        at = [F.least(F.floor(F.coalesce(F.try_divide(F.col(c).cast("double") - F.col(low).cast("double"), "span_"), F.lit(0.0)) * (last + 1)), last.cast("long")) for c, low in zip(places, ("x0_", "y0_"), strict=True)]
        return rows.join(span, "s_").withColumn("level_", F.explode(levels)).withColumns({"cx_": at[0], "cy_": at[1]}).drop("x0_", "y0_", "span_", "n_")

    cell, query = ["s_", "level_", "cx_", "cy_"], ["s_", "q_", "qx_", "qy_"]
    spots, seekers = cells(placed, "x_", "y_"), cells(asked, "qx_", "qy_")
    held = spots.groupBy(*cell).agg(F.count("*").alias("n_"))
    enough = _around(seekers, 1).join(held.hint("merge"), cell).groupBy(*cell[:2], *query[1:]).agg(F.sum("n_").alias("n_")).where((F.col("n_") > most) | (F.col("level_") == 0))
    finest = enough.groupBy(*query).agg(F.max("level_").alias("level_"))
    return _around(seekers.join(finest.hint("merge"), [*query, "level_"]), 3).join(spots.hint("merge"), cell).select(*query, "k_", "x_", "y_")


def rings(points: DataFrame, sample: str, key: str, x: str, y: str, sizes: list[int], queries: Column) -> DataFrame:
    """For each stated query its nearest points of the sample, itself left out, in rings of so many: key, neighbour, place, ring.

    Points are counted in grids of ever smaller cells. A query takes the finest grid whose block of 3 x 3 cells around it
    holds enough points: they are less than two cells away on either axis, so the nearest ones lie within three cells,
    and only those cells are met. Of points in one place only as many as could be taken go on. Ties go by key; distances
    that are not known come last, and for them the first keys of each kind of unknown place are enough.
    """
    most = sum(sizes)
    given = points.select(F.col(sample).alias("s_"), F.col(key).alias("k_"), F.col(x).alias("x_"), F.col(y).alias("y_"), queries.alias("asked_")).where("s_ is not null")
    asked = given.where("asked_").select("s_", F.col("k_").alias("q_"), F.col("x_").alias("qx_"), F.col("y_").alias("qy_"))
    given = given.drop("asked_")
    near = _near(_first_of(given.where(_finite("x_", "y_")), ["s_", "x_", "y_"], most + 1), asked.where(_finite("qx_", "qy_")), most)
    kinds = {f"{c}kind_": F.when(~_finite(c), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in ("x_", "y_")}
    odd = _first_of(given.withColumns(kinds), ["s_", *kinds], most + 1).drop(*kinds)
    near = near.unionByName(asked.join(odd, "s_").where(~(_finite("x_", "y_") & _finite("qx_", "qy_")))).where("k_ != q_")
    near = near.withColumn("d_", (F.col("x_") - F.col("qx_")) ** 2 + (F.col("y_") - F.col("qy_")) ** 2)
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("q_").orderBy(F.col("d_").asc_nulls_last(), "k_"))).where(F.col("place") <= most)
    bounds, total = [], 0
    for size in sizes:
        total += size
        bounds.append(total)
    ring = F.coalesce(*(F.when(F.col("place") <= b, i + 1) for i, b in enumerate(bounds)))
    return near.select(F.col("q_").alias("query"), F.col("k_").alias("neighbour"), "place", ring.alias("ring"))


def ring_means(found: DataFrame, points: DataFrame, key: str, value: str) -> DataFrame:
    """Mean value of the neighbours in each ring of each query."""
    return found.join(points.select(F.col(key).alias("neighbour"), F.col(value).alias("v_")), "neighbour").groupBy("query", "ring").agg(F.avg("v_").alias("mean"))


def mixing(found: DataFrame, points: DataFrame, key: str, label: str) -> DataFrame:
    """Inverse Simpson index of the labels among each query's neighbours."""
    counts = found.join(points.select(F.col(key).alias("neighbour"), F.col(label).alias("l_")), "neighbour").groupBy("query", "l_").agg(F.count("*").alias("c_"))
    return counts.groupBy("query").agg((F.sum("c_") * F.sum("c_") / F.sum(F.col("c_") * F.col("c_"))).alias("ilisi"))


def target_levels(trials: DataFrame, target: str, trial: str, phase: str, threshold: float) -> DataFrame:
    """Per target its greatest phase, its number of trials and whether it reaches the threshold."""
    out = trials.where(F.col(target).isNotNull()).groupBy(target).agg(F.max(phase).alias("max_phase"), F.count_distinct(trial).alias("n_trials"))
    return out.withColumn("reached", F.coalesce(F.col("max_phase") >= threshold, F.lit(False)))


def flagged_pairs(rows: DataFrame, key: str, a: str, b: str, pairs: DataFrame) -> DataFrame:
    """Whether any (a, b) pair of a key is among the pairs: key, flag 0 or 1."""
    known = pairs.select(F.col(pairs.columns[0]).alias("a_"), F.col(pairs.columns[1]).alias("b_")).distinct().withColumn("hit_", F.lit(1))
    return rows.join(known, (F.col(a) == F.col("a_")) & (F.col(b) == F.col("b_")), "left").groupBy(key).agg(F.coalesce(F.max("hit_"), F.lit(0)).alias("flag"))


def progression(rows: DataFrame, key: str, kind: str, first: str, second: str, sets: str, overlap: str, day: str) -> DataFrame:
    """Keys of the first kind that a row of the second follows: an equal set, overlapping others, no earlier day (or one missing)."""
    before = rows.where(F.col(kind) == first).select(key, F.array_sort(F.array_distinct(sets)).alias("set_"), F.col(overlap).alias("o_"), F.col(day).alias("d_"))
    after = rows.where(F.col(kind) == second).select(F.array_sort(F.array_distinct(sets)).alias("set2_"), F.col(overlap).alias("o2_"), F.col(day).alias("d2_"))
    later = F.col("d_").isNull() | F.col("d2_").isNull() | (F.col("d2_") >= F.col("d_"))
    return before.join(after, (F.col("set_") == F.col("set2_")) & F.arrays_overlap("o_", "o2_") & later, "left_semi").select(key)


def detected(cells: DataFrame, kind: str, value: str, least_share: float) -> DataFrame:
    """Kinds in which the value is above 0 in a large enough share of rows."""
    out = cells.groupBy(kind).agg(F.avg((F.coalesce(F.col(value), F.lit(0)) > 0).cast("double")).alias("share"))
    return out.where(F.col("share") >= least_share)


def shared_answers(ours: DataFrame, theirs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Per field: how many keys both answer, and the share that agrees."""
    both = ours.select(key, *(F.col(f).cast("string").alias(f) for f in fields)).join(theirs.select(key, *(F.col(f).cast("string").alias(f"{f}_t_") for f in fields)), key)
    one = both.agg(*(F.struct(F.lit(f).alias("field"), F.count_if(F.col(f).isNotNull() & F.col(f"{f}_t_").isNotNull()).alias("n"), F.count_if(F.col(f) == F.col(f"{f}_t_")).alias("n_equal")).alias(f"s{i}") for i, f in enumerate(fields)))
    return one.select(F.explode(F.array(*(f"s{i}" for i in range(len(fields))))).alias("x")).select("x.*").withColumn("share", F.try_divide("n_equal", "n"))

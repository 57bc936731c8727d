"""Identifier resolution: an index of labels by rule, and the first rule that decides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RULES = ["exact", "normalized", "label_exact", "label_casefold", "synonym"]


def index(entities: DataFrame, key: str, label: str | None = None, synonyms: str | None = None) -> DataFrame:
    """(form, rule number, canonical): what may stand for each entity."""
    k = F.col(key).cast("string")
    parts = [entities.select(k.alias("form"), F.lit(0).alias("rule"), k.alias("canonical")), entities.select(F.upper(F.trim(k)).alias("form"), F.lit(1).alias("rule"), k.alias("canonical"))]
    if label:
        parts += [entities.select(F.trim(label).alias("form"), F.lit(2).alias("rule"), k.alias("canonical")), entities.select(F.lower(F.trim(label)).alias("form"), F.lit(3).alias("rule"), k.alias("canonical"))]
    if synonyms:
        parts.append(entities.select(F.explode(synonyms).alias("s"), k.alias("canonical")).select(F.lower(F.trim("s")).alias("form"), F.lit(4).alias("rule"), "canonical"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("form is not null and form != ''").distinct()


def resolve(values: DataFrame, column: str, forms: DataFrame) -> DataFrame:
    """Each value's status: resolved by the first rule with hits, ambiguous if that rule names several, not_found."""
    v = F.col(column)
    asked = values.select(column).distinct().select(column, F.explode(F.array(F.struct(F.lit(0).alias("rule"), v.alias("form")), F.struct(F.lit(1).alias("rule"), F.upper(F.trim(v)).alias("form")), F.struct(F.lit(2).alias("rule"), F.trim(v).alias("form")), F.struct(F.lit(3).alias("rule"), F.lower(F.trim(v)).alias("form")), F.struct(F.lit(4).alias("rule"), F.lower(F.trim(v)).alias("form")))).alias("a")).select(column, "a.*")
    hits = asked.join(forms, ["rule", "form"])
    first = hits.withColumn("first_", F.min("rule").over(Window.partitionBy(column))).where("rule = first_")
    decided = first.groupBy(column).agg(F.count_distinct("canonical").alias("n_"), F.min("canonical").alias("canonical"), F.min("rule").alias("rule"))
    out = values.select(column).distinct().join(decided, column, "left")
    return out.select(
        column,
        F.when(F.col("n_").isNull(), "not_found").when(F.col("n_") > 1, "ambiguous").otherwise("resolved").alias("status"),
        F.when(F.col("n_") == 1, F.col("canonical")).alias("canonical"),
        F.when(F.col("n_").isNotNull(), F.element_at(F.array(*map(F.lit, RULES)), F.coalesce("rule", F.lit(0)) + 1)).alias("rule"),
    )


def suggestions(values: DataFrame, column: str, labels: DataFrame, label: str) -> DataFrame:
    """(value, suggestion): labels within one edit of a value, both in lower case.

    Two texts one edit apart share a form when each may lose one character, so the texts meet by a join on those
    forms (one more than a text's length for each) and only what meets is compared.
    """

    def forms(df: DataFrame, c: str, out: str) -> DataFrame:
        text = F.lower(F.trim(c))
        cuts = F.transform(F.sequence(F.lit(1), F.length(out)), lambda i: F.concat(F.substr(out, F.lit(1), i - 1), F.substr(out, i + 1)))
        known = df.select(text.alias(out)).where(F.length(out) > 0).distinct()
        return known.select(out, F.explode(F.array_distinct(F.concat(F.array(out), cuts))).alias("form"))

    met = forms(values, column, "value").join(forms(labels, label, "suggestion"), "form").select("value", "suggestion").distinct()
    return met.where(F.levenshtein("value", "suggestion", 1) >= 0)

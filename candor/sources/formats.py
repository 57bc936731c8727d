"""Files beside plain Parquet: gene sets, ontologies, wide matrices, embeddings, JSON lines, partitioned folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SourceError(ValueError):
    """A source that is missing or not what it is declared to be."""


def parquet(spark: SparkSession, path: str) -> DataFrame:
    """A table of Parquet files; corrupt or missing files are errors, never fewer rows."""
    return spark.read.option("ignoreCorruptFiles", "false").option("ignoreMissingFiles", "false").parquet(path)


def partitioned(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of k=v folders, with the types that the schema declares."""
    return spark.read.schema(schema).option("basePath", path).parquet(path)


def sharded(spark: SparkSession, path: str) -> DataFrame:
    """A folder of Parquet part files; a folder that is missing or has none is an error, not an empty table."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(there) or not any(f.getPath().getName().endswith(".parquet") for f in files.listStatus(there)):
        raise SourceError(f"{path} holds no part files")
    return parquet(spark, path)


def single_file(spark: SparkSession, pattern: str, fragment: str) -> DataFrame:
    """The Parquet files of a glob, with fragment_key: what the regular expression finds in each one's name."""
    return parquet(spark, pattern).select("*", F.regexp_extract("_metadata.file_name", fragment, 1).alias("fragment_key"))


def distinct_names(names: list[str]) -> list[str]:
    """Column names, later ones of the same name marked by their place."""
    return [n if names.index(n) == i else f"{n}#{i}" for i, n in enumerate(names)]


def delimited(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",", null: str = "", preamble: int = 0) -> DataFrame:
    """A delimited file with a header after `preamble` lines; without a schema all columns are strings.

    Header names that occur again are marked by their place. The preamble and the header are the first lines of the
    file; lines equal to them further down are left out too.
    """
    head = [r.value for r in spark.read.text(path).limit(preamble + 1).collect()]
    if len(head) <= preamble:
        raise SourceError(f"{path} has no header")
    shape = schema or ", ".join(f"`{n}` string" for n in distinct_names(head[-1].split(sep)))
    lines = spark.read.text(path).where(~F.col("value").isin(head))
    parsed = lines.select(F.from_csv("value", shape, {"sep": sep, "nullValue": null, "mode": "FAILFAST"}).alias("row")).select("row.*")
    texts = [f.name for f in parsed.schema if f.dataType.simpleString() == "string"]
    return parsed.withColumns({c: F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`")) for c in texts})


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(path, schema=schema, mode="FAILFAST")


def gene_sets(spark: SparkSession, path: str) -> DataFrame:
    """GMT lines: set_id, description and members."""
    cells = F.split("value", "\t")
    return spark.read.text(path).where("value != ''").select(cells[0].alias("set_id"), cells[1].alias("description"), F.filter(F.slice(cells, 3, F.greatest(F.size(cells) - 2, F.lit(0))), lambda x: x != "").alias("members"))


def ontology(spark: SparkSession, path: str) -> DataFrame:
    """OBO terms: id, name, namespace, definition, synonyms (label, scope in lower case), alternative ids, subsets, parents (is_a), related terms, whether obsolete, and what replaces them.

    What follows " !" is a comment only where ids stand: in parents, relationships and replacements.
    """
    stanza = spark.read.text(path, lineSep="\n\n").where(F.ltrim("value", F.lit("\n")).startswith("[Term]"))
    lines = F.split("value", "\n")

    def tagged(tag: str, of_ids: bool = False):
        found = F.transform(F.filter(lines, lambda x: x.startswith(f"{tag}: ")), lambda x: F.trim(F.substr(x, F.lit(len(tag) + 3))))
        return F.transform(found, lambda x: F.regexp_replace(x, r"\s+!.*$", "")) if of_ids else found

    quoted = r'^"((?:[^"\\]|\\.)*)"'
    return stanza.select(
        tagged("id", True)[0].alias("id"),
        F.get(tagged("name"), F.lit(0)).alias("name"),
        F.get(tagged("namespace"), F.lit(0)).alias("namespace"),
        F.regexp_extract(F.get(tagged("def"), F.lit(0)), quoted, 1).alias("definition"),
        F.transform(tagged("synonym"), lambda x: F.struct(F.regexp_extract(x, quoted, 1).alias("label"), F.lower(F.regexp_extract(x, r'"\s+([A-Z]+)', 1)).alias("scope"))).alias("synonyms"),
        tagged("alt_id", True).alias("alt_ids"),
        tagged("subset", True).alias("subsets"),
        tagged("is_a", True).alias("parents"),
        tagged("relationship", True).alias("relationships"),
        tagged("xref", True).alias("xrefs"),
        F.coalesce(F.get(tagged("is_obsolete"), F.lit(0)) == "true", F.lit(False)).alias("obsolete"),
        tagged("replaced_by", True).alias("replaced_by"),
        tagged("consider", True).alias("consider"),
    )


def long_view(matrix: DataFrame, row_key: str, columns: list[str] | None = None, value: str = "value") -> DataFrame:
    """A wide matrix as one row for each cell; only the named columns are read."""
    chosen = columns or [c for c in matrix.columns if c != row_key]
    return matrix.select(row_key, *chosen).unpivot([row_key], chosen, "col_key", value)


def wide_matrix(spark: SparkSession, path: str, row_key: str, columns: list[str] | None = None, sep: str = ",") -> DataFrame:
    """The long view of a wide file whose header names the columns (numbers)."""
    head = spark.read.text(path).limit(1).first()
    if head is None:
        raise SourceError(f"{path} has no header")
    names = distinct_names(head.value.split(sep))
    names[0] = row_key
    table = spark.read.csv(path, sep=sep, header=True, enforceSchema=True, schema=", ".join(f"`{n}` {'string' if i == 0 else 'double'}" for i, n in enumerate(names)))
    return long_view(table, row_key, columns)


def write_gene_sets(sets: DataFrame, path: str) -> None:
    sets.select(F.concat_ws("\t", "set_id", "description", F.array_join("members", "\t")).alias("value")).write.mode("overwrite").text(path)


def materialise(rows: DataFrame, path: str) -> DataFrame:
    """Rows written as Parquet; gives them as read back."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path)

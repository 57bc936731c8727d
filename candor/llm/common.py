"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table of documents."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def id_bucket(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id written as text, modulo; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("null")).cast("binary")) % modulus


def share(rows: int, bound: int, column: str = "doc_id") -> Column:
    """True for about `bound` of `rows` rows, chosen by a hash of the id (all rows if they are fewer)."""
    parts = 1_000_003
    return F.pmod(F.xxhash64(F.col(column), F.lit(11)), F.lit(parts)) < F.lit(int(parts * min(1.0, bound / max(rows, 1))) + 1)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names; only where none is named and all is one machine a temporary one."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read back: smaller on disk than a checkpoint, for larger tables."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved(df: DataFrame) -> DataFrame:
    """`df` written to the checkpoint folder all executors share, and read back; lineage ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def numbered(docs: DataFrame) -> DataFrame:
    """`docs` with a number of its own for each row (kept_row), written once so that numbers never change."""
    return written(docs.withColumn("kept_row", F.monotonically_increasing_id()))


def least_rows(rows: DataFrame, *by: str) -> DataFrame:
    """row and doc_id of the first of each group by (doc_id, row); null ids come last."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    return rows.groupBy(*by).agg(first).select("first.row", "first.doc_id")


def met(rows: DataFrame, facts: DataFrame, left: str, right: str, size: str, total: int) -> DataFrame:
    """`rows` joined with the one row of `facts` for their key, where `size` is how many of the `total` rows have it.

    Keys of a hundredth of all rows or more are at most a hundred: they are broadcast, so that no task gathers the rows
    of a hot key. The others meet by a shuffle.
    """
    hot = F.col(size) * 100 >= total
    same = F.col(left) == F.col(right)
    often = F.broadcast(facts.where(hot))
    return rows.join(often, same).unionByName(rows.join(often.select(right), same, "left_anti").join(facts.where(~hot).hint("merge"), same))

"""URL filters: an as-of join of captures with dated list entries, in DataFrame functions only.

A list is a table of dated changes (key, category, listed: add or remove, since). Changes of one key and category
become validity intervals [since, until). A key is a host, which also stands for its subdomains; a path prefix of one
host, ending in "/"; or one URL's host and path, with or without its query. A capture asks for its host and each parent
domain, for each folder of its path down to the deepest that the list has, and for its URL; the entries of those keys
that are active at its fetch time decide: the longest key wins, then the first key and the smallest category.

Hosts are compared in lower case without user, port or trailing dots; an IP address (IPv6 in brackets) has no parents.
Paths and queries are compared as they are written; fragments never count. A change without a time or key is ignored;
of changes of one key and category at one time, removal wins. A capture without a time, or whose URL is null or has no
host, meets no entry. Every capture gives one row; repeated rows stay. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SALTS = 16
_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def _bare(host: Column) -> Column:
    return F.lower(F.regexp_replace(host, r"\.+$", ""))


def host(url: str = "url") -> Column:
    return F.coalesce(_bare(F.regexp_extract(url, _AUTHORITY, 1)), F.lit(""))


def intervals(changes: DataFrame) -> DataFrame:
    """key, category, since, until (null: still listed) of the times when a key is listed."""
    key = F.concat(_bare(F.regexp_extract("key", r"^([^/]*)", 1)), F.regexp_extract("key", r"^[^/]*(.*)$", 1))
    known = changes.where(F.col("key").isNotNull() & F.col("since").isNotNull()).select(key.alias("key"), F.coalesce("category", F.lit("")).alias("category"), "listed", "since")
    known = known.groupBy("key", "category", "since").agg(F.max("listed").alias("listed"))
    order = Window.partitionBy("key", "category").orderBy("since")
    return known.withColumn("until", F.lead("since").over(order)).where("listed = 'add'").drop("listed")


def keys(deepest: int, url: str = "url") -> Column:
    """The keys that a URL asks for, folders down to `deepest`; null without a host."""
    name = host(url)
    parts = F.split(name, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    hosts = F.when(name.rlike(r"^\[|^[0-9.]+$"), F.array(name)).otherwise(parents)
    path = F.regexp_extract(url, _PATH, 1)
    path = F.when(path == "", "/").otherwise(path)
    folders = F.split(path, "/")
    depth = F.least(F.size(folders) - 1, F.lit(deepest))
    prefixes = F.when(depth > 0, F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda i: F.concat(name, F.array_join(F.slice(folders, 1, i), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    return F.when(name != "", F.array_distinct(F.concat(hosts, prefixes, F.array(F.concat(name, path), F.concat(name, path, query)))))


def judge(captures: DataFrame, changes: DataFrame, most_broadcast: int = 100_000) -> DataFrame:
    """(page_id, url, fetched) to page_id, host, fetched, blocked, matched_key, category.

    The list is broadcast only if it has at most `most_broadcast` intervals. A longer one meets the captures' keys by a
    shuffle on keys; a key that a hundredth of the captures or more ask for is dealt over `SALTS` tasks, its intervals
    going to each (such keys are at most a hundred for each key that a capture asks for, so they are broadcast). The
    matches of a capture meet again by the number of its row.
    """
    listed = intervals(changes)
    facts = listed.agg(F.count("*").alias("n"), F.max(F.length("key") - F.length(F.translate("key", "/", ""))).alias("deepest")).first()
    numbered = captures.select("page_id", "url", "fetched").withColumn("row", F.monotonically_increasing_id())
    asked = numbered.select("row", "fetched", F.explode(keys(facts.deepest or 0)).alias("asked_key"))
    active = (F.col("asked_key") == F.col("key")) & (F.col("since") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))
    if facts.n <= most_broadcast:
        met = asked.join(F.broadcast(listed), active)
    else:
        total = captures.count()
        heavy = F.broadcast(asked.groupBy(F.col("asked_key").alias("heavy")).count().where(F.col("count") * 100 >= total).select("heavy"))
        dealt = asked.join(heavy, F.col("asked_key") == F.col("heavy"), "left").withColumn("salt", F.when(F.col("heavy").isNotNull(), F.pmod(F.xxhash64("row"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
        spread = listed.join(heavy, F.col("key") == F.col("heavy"), "left")
        spread = spread.select("key", "category", "since", "until", F.explode(F.sequence(F.lit(0), F.when(F.col("heavy").isNotNull(), SALTS - 1).otherwise(0))).alias("of_salt"))
        met = dealt.join(spread.hint("merge"), active & (F.col("salt") == F.col("of_salt")))
    best = met.groupBy(F.col("row").alias("of_row")).agg(F.min(F.struct((-F.length("key")).alias("rank"), "key", "category")).alias("best"))
    out = numbered.join(best, F.col("row") == F.col("of_row"), "left")
    return out.select("page_id", host().alias("host"), "fetched", F.col("best").isNotNull().alias("blocked"), F.col("best.key").alias("matched_key"), F.col("best.category").alias("category"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, each with a day of 2024 as its fetch time, set by its number (the table has none)."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 7, F.lit(366)).cast("int")).alias("fetched"))


def changes_of(pages: DataFrame) -> DataFrame:
    """A dated list that grows with the pages: their hosts, their first folders and every third URL, listed and removed on days set by a hash.

    A key's md5 sets its category, the day it is listed, how long it stays, and whether it comes back.
    """
    name, path = host(), F.regexp_extract("url", _PATH, 1)
    parent = F.regexp_replace(name, r"^[^.]+\.", "")
    own = F.array(name, F.when(F.size(F.split(name, r"\.")) > 3, parent), F.concat(name, F.regexp_extract(path, r"^(/[^/]+/)", 1)), F.when(F.col("page_id") % 3 == 0, F.concat(name, path)))
    found = pages.where(name != "").select(F.explode(F.array_compact(own)).alias("key")).distinct()
    number = lambda a: F.conv(F.substr(F.md5("key"), F.lit(a), F.lit(4)), 16, 10).cast("int")
    dated = found.select("key", F.concat(F.lit("c"), number(1) % 5).alias("category"), (number(5) % 330).alias("day"), (number(9) % 90 + 1).alias("stay"), (number(13) % 3 == 0).alias("again"))
    days = F.array(F.struct(F.lit("add").alias("listed"), F.col("day").alias("at")), F.struct(F.lit("remove").alias("listed"), (F.col("day") + F.col("stay")).alias("at")))
    days = F.when(F.col("again"), F.concat(days, F.array(F.struct(F.lit("add").alias("listed"), (F.col("day") + F.col("stay") + 20).alias("at"))))).otherwise(days)
    return dated.select("key", "category", F.explode(days).alias("x")).select("key", "category", "x.listed", F.date_add(F.lit("2024-01-01").cast("date"), F.col("x.at")).alias("since"))


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages against their list, joined by a shuffle at every size."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(captures(spark, sf_dir), changes_of(pages), most_broadcast=0).withColumn("fetched", F.col("fetched").cast("string"))


ORACLE = r"""WITH p AS (SELECT page_id, url, DATE '2024-01-01' + CAST((page_id * 7) % 366 AS INTEGER) AS fetched,
  coalesce(lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)', 1), '\.+$', '')), '') AS host,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS bare, regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) AS query FROM pages),
own AS (SELECT *, CASE WHEN bare = '' THEN '/' ELSE bare END AS path FROM p),
named AS (SELECT host AS key FROM own WHERE host <> '' UNION SELECT regexp_replace(host, '^[^.]+\.', '') FROM own WHERE len(string_split(host, '.')) > 3
  UNION SELECT host || regexp_extract(bare, '^(/[^/]+/)', 1) FROM own WHERE host <> '' UNION SELECT host || bare FROM own WHERE host <> '' AND page_id % 3 = 0),
dated AS (SELECT key, 'c' || CAST(CAST('0x' || substr(md5(key), 1, 4) AS INTEGER) % 5 AS VARCHAR) AS category, CAST('0x' || substr(md5(key), 5, 4) AS INTEGER) % 330 AS day,
  CAST('0x' || substr(md5(key), 9, 4) AS INTEGER) % 90 + 1 AS stay, CAST('0x' || substr(md5(key), 13, 4) AS INTEGER) % 3 = 0 AS again FROM named),
listed AS (SELECT key, category, day AS since, day + stay AS until FROM dated UNION ALL SELECT key, category, day + stay + 20, NULL FROM dated WHERE again),
met AS (SELECT a.page_id, a.host, a.fetched, l.key, l.category, row_number() OVER (PARTITION BY a.page_id ORDER BY length(l.key) DESC NULLS LAST, l.key, l.category) AS place
 FROM own a LEFT JOIN listed l ON (
   CASE WHEN contains(l.key, '/') THEN starts_with(l.key, a.host || '/') AND (l.key = a.host || a.path OR l.key = a.host || a.path || a.query OR (ends_with(l.key, '/') AND starts_with(a.host || a.path, l.key)))
        ELSE a.host = l.key OR ends_with(a.host, '.' || l.key) END)
   AND DATE '2024-01-01' + l.since <= a.fetched AND (l.until IS NULL OR a.fetched < DATE '2024-01-01' + l.until))
SELECT page_id, host, CAST(CAST(fetched AS DATE) AS VARCHAR) AS fetched, key IS NOT NULL AS blocked, key AS matched_key, category FROM met WHERE place = 1"""

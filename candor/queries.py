"""All queries of the engine by name, each with its equivalent in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candor.functions.scalar import below, latest_day, normalised, phase_number, squeezed
from candor.operators import graph, quality, resolve, statistics, transforms, verbs
from candor.plans.order import best_per, top, with_boundary
from candor.plans.predicate import unknown_counts, where
from candor.sources.formats import long_view, parquet
from candor.streaming.events import windowed


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None):
    def added(run):
        QUERIES[run.__name__] = Query(run, sql)
        return run

    return added


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return parquet(spark, f"{sf_dir}/{name}.parquet")


def r6(c) -> F.Column:
    return F.round(c, 6)


def _orders(spark, d):
    """Orders whose price is unknown for every seventh key, and whose priority is for every fifth."""
    o = table(spark, d, "orders")
    return o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("priority"))


_O = "(SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS priority FROM orders) o"


# filters


@query(f"SELECT o_orderkey FROM {_O} WHERE price > 250000 OR priority = '1-URGENT'")
def filter_kleene_or(spark, d):
    o = _orders(spark, d)
    return o.where(where(o, {"or": [{"gt": ["price", 250000]}, {"eq": ["priority", "1-URGENT"]}]})).select("o_orderkey")


@query(f"SELECT o_orderkey, price FROM {_O} WHERE price BETWEEN 1000 AND 50000 AND o_orderstatus IN ('F', 'O')")
def filter_range_in(spark, d):
    o = _orders(spark, d)
    return o.where(where(o, {"range": ["price", 1000, 50000, True, True]}, {"in": ["o_orderstatus", ["F", "O"]]})).select("o_orderkey", "price")


@query(f"SELECT o_orderkey FROM {_O} WHERE NOT (price > 100000 AND priority <> '5-LOW')")
def filter_not_null_unknown(spark, d):
    o = _orders(spark, d)
    return o.where(where(o, {"not": {"and": [{"gt": ["price", 100000]}, {"ne": ["priority", "5-LOW"]}]}})).select("o_orderkey")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE abs(c_acctbal) < 500")
def filter_abs(spark, d):
    c = table(spark, d, "customer")
    return c.where(where(c, {"lt_abs": ["c_acctbal", 500]})).select("c_custkey", "c_acctbal")


@query("SELECT c_custkey FROM customer WHERE 1 = 0")
def filter_type_mismatch_is_unknown(spark, d):
    c = table(spark, d, "customer")
    return c.where(where(c, {"eq": ["c_acctbal", "many"]})).select("c_custkey")


def _baskets(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_partkey", "l_quantity", "l_returnflag")).alias("items"))


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def filter_any_item(spark, d):
    b = _baskets(spark, d)
    return b.where(where(b, {"gt": ["items[].l_quantity", 45]}, {"eq": ["items[].l_returnflag", "R"]})).select("l_orderkey")


@query("SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_and(l_quantity >= 20)")
def filter_all_items(spark, d):
    b = _baskets(spark, d)
    return b.where(where(b, {"all": ["items", {"ge": ["l_quantity", 20]}]})).select("l_orderkey")


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey = 7")
def filter_contains(spark, d):
    b = _baskets(spark, d).select("l_orderkey", F.col("items.l_partkey").alias("parts"))
    return b.where(where(b, {"contains": ["parts", 7]})).select("l_orderkey")


@query("SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_returnflag = 'R') > 0")
def filter_nonempty(spark, d):
    b = _baskets(spark, d).select("l_orderkey", F.filter("items", lambda x: x["l_returnflag"] == "R").alias("returned"))
    return b.where(where(b, {"nonempty": "returned"})).select("l_orderkey")


@query(
    """SELECT p_partkey, p_type = 'ECONOMY' AS is_exact, lower(p_type) = 'economy' AS is_casefold, contains(p_name, 'ar') AS is_substring,
    contains(lower(p_name), 'AR'.lower()) AS is_casefold_substring, regexp_matches(lower(p_name), '(^|[^0-9A-Za-z_])part($|[^0-9A-Za-z_])') AS is_word FROM part"""
)
def filter_text_modes(spark, d):
    p = table(spark, d, "part")
    modes = [("exact", "p_type", "ECONOMY"), ("casefold", "p_type", "economy"), ("substring", "p_name", "ar"), ("casefold_substring", "p_name", "AR"), ("word", "p_name", "part")]
    return p.select("p_partkey", *(where(p, {"text": [c, s, m]}).alias(f"is_{m}") for m, c, s in modes))


_LATE = "(SELECT o_orderkey, l_partkey, l_suppkey, l_linenumber, date_diff('day', o_orderdate, l_shipdate) AS days, l_linestatus = 'F' AS done FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _late(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("o_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.datediff("l_shipdate", "o_orderdate").alias("days"), (F.col("l_linestatus") == "F").alias("done"), "o_orderpriority")


@query(f"SELECT count(*) FILTER (days <= 60 AND done) AS n_true, count(*) FILTER (days > 60) AS n_false, count(*) FILTER (days <= 60 AND NOT done) AS n_unknown FROM {_LATE}")
def filter_censored(spark, d):
    j = _late(spark, d)
    test = where(j, {"censored": ["days", "done", "le", 60]})
    return j.agg(F.count_if(test).alias("n_true"), F.count_if(~test).alias("n_false"), F.count_if(test.isNull()).alias("n_unknown"))


@query(
    f"""SELECT count(*) FILTER (price > 100000 AND priority = '1-URGENT') AS total,
    count(*) FILTER ((price > 100000 AND priority = '1-URGENT') IS NULL) AS excluded_unknown,
    count(*) FILTER ((price > 100000 AND priority = '1-URGENT') IS NULL AND price IS NULL) AS unknown_price,
    count(*) FILTER ((price > 100000 AND priority = '1-URGENT') IS NULL AND priority IS NULL) AS unknown_priority FROM {_O}"""
)
def serve_count_with_unknown(spark, d):
    return unknown_counts(_orders(spark, d), {"gt": ["price", 100000]}, {"eq": ["priority", "1-URGENT"]})


@query("SELECT l_orderkey, count(*) AS n_items, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY 1")
def item_table_explode(spark, d):
    b = _baskets(spark, d).select("l_orderkey", F.posexplode("items").alias("pos", "item"))
    return b.groupBy("l_orderkey").agg((F.max("pos") + 1).cast("long").alias("n_items"), F.sum(F.col("item.l_quantity").cast("long")).alias("quantity"))


# rankings


@query(
    """SELECT o_orderkey, o_orderpriority, o_totalprice, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'
    QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 5"""
)
def find_topk_per_group(spark, d):
    view = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    found = verbs.find(view, [{"eq": ["c_mktsegment", "BUILDING"]}], [("o_totalprice", "desc")], ["o_orderkey"], 5, ["o_orderpriority"])
    return found.rows.select("o_orderkey", "o_orderpriority", "o_totalprice", "c_mktsegment")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def find_topk(spark, d):
    return verbs.find(table(spark, d, "orders"), [{"eq": ["o_orderstatus", "F"]}], [("o_totalprice", "desc")], ["o_orderkey"], 20).rows.select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 15")
def find_topk_abs(spark, d):
    return top(table(spark, d, "customer"), [("c_acctbal", "desc_abs")], ["c_custkey"], 15).select("c_custkey", "c_acctbal")


@query("SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) = 1")
def find_distinct_best(spark, d):
    return best_per(table(spark, d, "part"), ["p_brand"], [("p_retailprice", "desc")], ["p_partkey"]).select("p_brand", "p_partkey", "p_retailprice")


@query(
    """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1)
    ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"""
)
def find_limit_grain(spark, d):
    return verbs.find(table(spark, d, "orders"), [], [("o_totalprice", "desc")], ["o_orderkey"], 10, grain=["o_custkey"]).rows.select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT p_partkey, p_size, p_brand FROM part WHERE p_size IN (SELECT p_size FROM (SELECT p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 30))")
def find_boundary(spark, d):
    return with_boundary(table(spark, d, "part"), "p_size", [("p_size", "desc")], ["p_partkey"], 30).select("p_partkey", "p_size", "p_brand")


# aggregates


def _aggregate(how, value, round_it=True, **more):
    def run(spark, d):
        out = verbs.aggregate(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", how, **more)
        return out.withColumn("value", r6("value")) if round_it else out

    return run


for _name, _how, _sql in (
    ("agg_count", "count", "count(l_extendedprice)"),
    ("agg_count_distinct", "count_distinct", "count(DISTINCT l_extendedprice)"),
    ("agg_median", "median", "round(median(l_extendedprice), 6)"),
    ("agg_min", "min", "round(min(l_extendedprice), 6)"),
    ("agg_max", "max", "round(max(l_extendedprice), 6)"),
    ("agg_max_abs", "max_abs", "round(max(l_extendedprice), 6)"),
):
    QUERIES[_name] = Query(
        _aggregate(_how, _sql, not _how.startswith("count")),
        f"SELECT l_returnflag, l_linestatus, {_sql} AS value, count(l_extendedprice) AS n, count(*) - count(l_extendedprice) AS n_unknown FROM lineitem GROUP BY 1, 2",
    )


@query("SELECT l_suppkey, round(avg(l_quantity), 4) AS value, count(*) AS n, CAST(0 AS BIGINT) AS n_unknown FROM lineitem GROUP BY 1 HAVING count(*) >= 50")
def agg_mean_min_n(spark, d):
    return verbs.aggregate(table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", "mean", min_n=50).withColumn("value", F.round("value", 4))


@query("SELECT event_type, round(sum(value), 2) AS value, count(value) AS n, count(*) - count(value) AS n_unknown FROM events GROUP BY 1")
def agg_sum(spark, d):
    return verbs.aggregate(table(spark, d, "events"), ["event_type"], "value", "sum").withColumn("value", F.round("value", 2))


@query("SELECT p_type, round(exp(avg(ln(p_retailprice))), 4) AS value, count(*) AS n, CAST(0 AS BIGINT) AS n_unknown FROM part GROUP BY 1")
def agg_geomean(spark, d):
    return verbs.aggregate(table(spark, d, "part"), ["p_type"], "p_retailprice", "geometric_mean").withColumn("value", F.round("value", 4))


@query("SELECT o_custkey, count(*) AS n_items, min(o_orderkey) AS first_order, max(o_orderkey) AS last_order FROM orders GROUP BY 1 HAVING count(*) >= 12")
def agg_nest_having(spark, d):
    n = verbs.nest(table(spark, d, "orders"), ["o_custkey"], ["o_orderkey", "o_totalprice"], ["o_orderkey"], 12)
    return n.select("o_custkey", "n_items", F.col("items")[0]["o_orderkey"].alias("first_order"), F.element_at("items", -1)["o_orderkey"].alias("last_order"))


@query(
    """SELECT c_custkey, c_acctbal, sign FROM (SELECT *, CASE WHEN c_acctbal > 0 THEN 'positive' ELSE 'negative' END AS sign FROM customer WHERE c_acctbal <> 0)
    QUALIFY row_number() OVER (PARTITION BY sign ORDER BY abs(c_acctbal) DESC, c_custkey) <= 10"""
)
def agg_split_sign(spark, d):
    return verbs.split_by_sign(table(spark, d, "customer"), "c_acctbal", ["c_custkey"], 10).select("c_custkey", "c_acctbal", "sign")


@query("SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1")
def vocab_column(spark, d):
    return verbs.vocab(table(spark, d, "part"), "p_brand")


@query(
    "SELECT count(*) AS n_pairs FROM (SELECT DISTINCT least(c_nationkey, s_nationkey), greatest(c_nationkey, s_nationkey) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"
)
def agg_grain_pairs(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return verbs.distinct_pairs(j.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")), "c_nationkey", "s_nationkey")


# sets, lookups, search


@query(
    """SELECT o_custkey, CASE WHEN bool_or(early) AND bool_or(NOT early) THEN 'both' WHEN bool_or(early) THEN 'left_only' ELSE 'right_only' END AS side
    FROM (SELECT o_custkey, year(o_orderdate) <= 1994 AS early FROM orders WHERE year(o_orderdate) <= 1994 OR year(o_orderdate) >= 1997) GROUP BY 1"""
)
def set_compare(spark, d):
    o = table(spark, d, "orders")
    return verbs.compare_sets(o.where(F.year("o_orderdate") <= 1994), o.where(F.year("o_orderdate") >= 1997), ["o_custkey"])


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey = 5")
def lookup_key(spark, d):
    return verbs.lookup(table(spark, d, "part"), {"p_partkey": 5}).select("p_partkey", "p_name", "p_brand")


@query(
    """SELECT p_partkey, p_name, CASE best.r WHEN 0 THEN 'exact' WHEN 1 THEN 'casefold' WHEN 2 THEN 'prefix' WHEN 3 THEN 'word' ELSE 'substring' END AS match_class
    FROM (SELECT *, least(CASE WHEN a IS NOT NULL THEN {'r': a, 'l': 0} END, CASE WHEN b IS NOT NULL THEN {'r': b, 'l': 1} END) AS best FROM (SELECT *,
      CASE WHEN p_name = 'eco' THEN 0 WHEN lower(p_name) = 'eco' THEN 1 WHEN starts_with(lower(p_name), 'eco') THEN 2 WHEN regexp_matches(lower(p_name), '(^|\\W)eco($|\\W)') THEN 3 WHEN contains(lower(p_name), 'eco') THEN 4 END AS a,
      CASE WHEN p_type = 'eco' THEN 0 WHEN lower(p_type) = 'eco' THEN 1 WHEN starts_with(lower(p_type), 'eco') THEN 2 WHEN regexp_matches(lower(p_type), '(^|\\W)eco($|\\W)') THEN 3 WHEN contains(lower(p_type), 'eco') THEN 4 END AS b FROM part))
    WHERE best IS NOT NULL ORDER BY best.r, best.l, p_partkey LIMIT 20"""
)
def search_match_class(spark, d):
    return verbs.search(table(spark, d, "part"), ["p_name", "p_type"], "eco", ["p_partkey"], 20).select("p_partkey", "p_name", "match_class")


def _hierarchy(spark, d):
    r, n, c = (table(spark, d, x) for x in ("region", "nation", "customer"))
    up = r.join(n, F.col("r_regionkey") == F.col("n_regionkey")).select(F.concat(F.lit("r"), "r_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child"))
    return up.unionByName(c.select(F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.concat(F.lit("c"), "c_custkey").alias("child")))


@query(
    """SELECT 'r1' AS node, 0 AS depth UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation WHERE n_regionkey = 1
    UNION ALL SELECT 'c' || c_custkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1"""
)
def expand_descendants(spark, d):
    return graph.expand(_hierarchy(spark, d), "parent", "child", spark.createDataFrame([("r1",)], "node string"))


@query("SELECT 'n' || c_nationkey AS node, 1 AS depth FROM customer WHERE c_custkey = 3 UNION ALL SELECT 'r' || n_regionkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 3")
def expand_ancestors(spark, d):
    return graph.expand(_hierarchy(spark, d), "parent", "child", spark.createDataFrame([("c3",)], "node string"), "ancestors", False)


@query("SELECT c_custkey AS member, 'n' || c_nationkey AS via, 1 AS depth FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
def members_propagated(spark, d):
    direct = table(spark, d, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("set_id"), F.col("c_custkey").alias("member"))
    up = _hierarchy(spark, d).where(F.col("parent").startswith("r"))
    return graph.members(direct, "set_id", "member", up, "parent", "child", "r2")


def _bipartite(spark, d):
    return table(spark, d, "lineitem").groupBy(F.concat(F.lit("s"), "l_suppkey").alias("a"), F.concat(F.lit("p"), "l_partkey").alias("b")).agg(F.count("*").alias("n_lines"))


_E = "(SELECT 's' || l_suppkey AS a, 'p' || l_partkey AS b, count(*) AS n_lines FROM lineitem GROUP BY 1, 2)"


@query(f"SELECT b AS partner, n_lines FROM {_E} WHERE a = 's1' ORDER BY n_lines DESC, b LIMIT 25")
def neighbors_one_hop(spark, d):
    return graph.neighbors(_bipartite(spark, d), "a", "b", "s1", [("n_lines", "desc")], 25).select("partner", "n_lines")


@query(f"WITH e AS (SELECT * FROM {_E}), h1 AS (SELECT DISTINCT b AS node FROM e WHERE a = 's1') SELECT 's1' AS node, 0 AS hop UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT DISTINCT a, 2 FROM e JOIN h1 ON b = node WHERE a <> 's1'")
def network_two_hops(spark, d):
    return graph.expand_network(_bipartite(spark, d), "a", "b", spark.createDataFrame([("s1",)], "node string"), 2, 100_000)


@query(f"SELECT b AS partner, count(DISTINCT a) AS n_targets, max(n_lines) AS best_score FROM {_E} WHERE a IN ('s1', 's2', 's3') GROUP BY 1 HAVING count(DISTINCT a) >= 2")
def common_interactors(spark, d):
    return graph.common_partners(_bipartite(spark, d), "a", "b", spark.createDataFrame([("s1",), ("s2",), ("s3",)], "node string"), 2, "n_lines")


_COS = "list_dot_product(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(x.embedding AS DOUBLE[]), CAST(x.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(y.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[]))))"


@query(f"SELECT x.vec_id, round({_COS}, 6) AS score FROM embeddings x, embeddings y WHERE y.vec_id = 1 AND x.vec_id <> 1 ORDER BY {_COS} DESC, x.vec_id LIMIT 10")
def similar_topk(spark, d):
    return verbs.similar(table(spark, d, "embeddings"), "vec_id", "embedding", 1, 10).withColumn("score", r6("score"))


@query(f"SELECT x.vec_id AS a, y.vec_id AS b, round({_COS}, 6) AS score FROM embeddings x, embeddings y WHERE x.vec_id = 2 AND y.vec_id = 3")
def pair_similarity(spark, d):
    return verbs.pair_similarity(table(spark, d, "embeddings"), "vec_id", "embedding", 2, 3).withColumn("score", r6("score"))


@query(
    """WITH v(value) AS (VALUES ('Customer#000000001'), (' 2 '), ('7'), ('NATION_3'), ('nobody'), ('algeria'))
    SELECT value, CASE WHEN n.n_nationkey IS NOT NULL OR m.n_nationkey IS NOT NULL OR k.n_nationkey IS NOT NULL OR k2.n_nationkey IS NOT NULL THEN 'resolved' ELSE 'not_found' END AS status,
    CAST(coalesce(k.n_nationkey, k2.n_nationkey, n.n_nationkey, m.n_nationkey) AS VARCHAR) AS canonical,
    CASE WHEN k.n_nationkey IS NOT NULL THEN 'exact' WHEN k2.n_nationkey IS NOT NULL THEN 'normalized' WHEN n.n_nationkey IS NOT NULL THEN 'label_exact' WHEN m.n_nationkey IS NOT NULL THEN 'label_casefold' END AS rule
    FROM v LEFT JOIN nation k ON CAST(k.n_nationkey AS VARCHAR) = value LEFT JOIN nation k2 ON CAST(k2.n_nationkey AS VARCHAR) = trim(value) LEFT JOIN nation n ON n.n_name = trim(value) LEFT JOIN nation m ON lower(m.n_name) = lower(trim(value))"""
)
def resolve_ids(spark, d):
    messy = spark.createDataFrame([("Customer#000000001",), (" 2 ",), ("7",), ("NATION_3",), ("nobody",), ("algeria",)], "value string")
    return resolve.resolve(messy, "value", resolve.index(table(spark, d, "nation"), "n_nationkey", "n_name"))


# statistics


@query(
    """WITH u AS (SELECT DISTINCT l_partkey AS k FROM lineitem), q AS (SELECT DISTINCT l_partkey AS k FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey = 3),
    s AS (SELECT p_brand, count(*) AS size, count(q.k) AS overlap FROM part JOIN u ON p_partkey = u.k LEFT JOIN q ON p_partkey = q.k GROUP BY 1 HAVING count(*) BETWEEN 2 AND 5000)
    SELECT p_brand, size, overlap, round(size * (SELECT count(*) FROM q) / (SELECT count(*) FROM u), 6) AS expected FROM s"""
)
def enrich_sets(spark, d):
    return _enriched(spark, d).select("p_brand", "size", "overlap", r6("expected").alias("expected"))


def _enriched(spark, d):
    li = table(spark, d, "lineitem")
    asked = li.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).where("s_nationkey = 3").select("l_partkey")
    return statistics.enrich(table(spark, d, "part"), "p_brand", "p_partkey", asked, li.select("l_partkey"), 2, 5000)


@query()
def enrich_p_and_q(spark, d):
    return _enriched(spark, d).select("p_brand", "overlap", r6("p").alias("p"), r6("q").alias("q"), r6("fold").alias("fold"))


@query(
    """WITH p AS (SELECT p_partkey, p_brand, (p_partkey * 37 % 1000) / 1000.0 AS p FROM part), r AS (SELECT *, count(*) OVER (PARTITION BY p_brand) AS m, rank() OVER (PARTITION BY p_brand ORDER BY p) + count(*) OVER (PARTITION BY p_brand, p) - 1 AS k FROM p)
    SELECT p_partkey, round(least(1.0, min(p * m / k) OVER (PARTITION BY p_brand ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 6) AS q FROM r"""
)
def bh_adjust(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", (F.col("p_partkey") * 37 % 1000 / 1000.0).alias("p"))
    return statistics.adjusted(p, "p", ["p_brand"]).select("p_partkey", r6("q").alias("q"))


_KM = f"""c AS (SELECT o_orderpriority, days, count(*) FILTER (done) AS d, count(*) AS leave FROM (SELECT o_orderpriority, date_diff('day', o_orderdate, l_shipdate) AS days, l_linestatus = 'F' AS done FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1, 2),
    a AS (SELECT *, sum(leave) OVER (PARTITION BY o_orderpriority ORDER BY days ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS at_risk FROM c),
    s AS (SELECT *, CASE WHEN max(CASE WHEN d = at_risk THEN 1 ELSE 0 END) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN d < at_risk THEN ln(1 - d / at_risk) ELSE 0 END) OVER w) END AS survival FROM a WINDOW w AS (PARTITION BY o_orderpriority ORDER BY days ROWS UNBOUNDED PRECEDING))"""


@query(f"WITH {_KM} SELECT o_orderpriority, CAST(days AS INTEGER) AS days, d, CAST(at_risk AS BIGINT) AS at_risk, round(survival, 6) AS survival FROM s WHERE d > 0")
def kaplan_meier(spark, d):
    return statistics.survival_curve(_late(spark, d), "o_orderpriority", "days", "done").select("o_orderpriority", "days", "d", "at_risk", r6("survival").alias("survival"))


@query(f"WITH {_KM} SELECT o_orderpriority, CAST(min(CASE WHEN survival <= 0.5 + 1e-12 THEN days END) AS INTEGER) AS median_time FROM s WHERE d > 0 GROUP BY 1")
def km_median(spark, d):
    return statistics.survival_median(statistics.survival_curve(_late(spark, d), "o_orderpriority", "days", "done"), "o_orderpriority", "days")


def _segments(spark, d):
    """Each segment's orders per brand and month against the segment's even share, as an effect."""
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("c_mktsegment", F.month("o_orderdate").alias("month"), "p_brand").agg((F.count("*") - 8).alias("effect"))


_SEG = "(SELECT c_mktsegment, CAST(month(o_orderdate) AS INTEGER) AS month, p_brand, count(*) - 8 AS effect FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)"


@query(
    f"""WITH a AS (SELECT month, p_brand, effect FROM {_SEG} WHERE c_mktsegment = 'BUILDING'), b AS (SELECT month, p_brand, effect FROM {_SEG} WHERE c_mktsegment = 'MACHINERY')
    SELECT month, p_brand, a.effect AS effect_a, b.effect AS effect_b, CASE WHEN b.effect IS NULL THEN 'unique_to_a' WHEN a.effect IS NULL THEN 'unique_to_b' WHEN sign(a.effect) = sign(b.effect) THEN 'same_direction' ELSE 'opposite_direction' END AS kind
    FROM a FULL JOIN b USING (month, p_brand)"""
)
def pairs_compare(spark, d):
    s = _segments(spark, d)
    return verbs.paired(s.where("c_mktsegment = 'BUILDING'"), s.where("c_mktsegment = 'MACHINERY'"), ["month"], "p_brand", "effect")


@query(
    f"""WITH a AS (SELECT month, p_brand, effect FROM {_SEG} WHERE c_mktsegment = 'BUILDING'), b AS (SELECT month, p_brand, effect FROM {_SEG} WHERE c_mktsegment = 'MACHINERY')
    SELECT month, CASE WHEN count(*) >= 3 THEN round(corr(a.effect, b.effect), 6) END AS r FROM a JOIN b USING (month, p_brand) GROUP BY 1"""
)
def pairs_pearson(spark, d):
    return pairs_compare(spark, d).groupBy("month").agg(r6(statistics.pearson("effect_a", "effect_b")).alias("r")).where("r is not null")


@query(
    f"""WITH s AS (SELECT p_brand, c_mktsegment, sum(effect) AS effect FROM {_SEG} GROUP BY 1, 2) SELECT h.p_brand, CAST(h.effect AS BIGINT) AS effect, round(e.elsewhere, 6) AS elsewhere, e.n_elsewhere, round(abs(h.effect) / e.elsewhere, 6) AS ratio, e.elsewhere IS NULL AS exclusive
    FROM (SELECT * FROM s WHERE c_mktsegment = 'BUILDING') h LEFT JOIN (SELECT p_brand, avg(abs(effect)) AS elsewhere, count(DISTINCT c_mktsegment) AS n_elsewhere FROM s WHERE c_mktsegment <> 'BUILDING' GROUP BY 1) e USING (p_brand)"""
)
def selectivity(spark, d):
    s = _segments(spark, d).groupBy("p_brand", "c_mktsegment").agg(F.sum("effect").alias("effect"))
    return verbs.selectivity(s, "p_brand", "c_mktsegment", "BUILDING", "effect").withColumns({"elsewhere": r6("elsewhere"), "ratio": r6("ratio")})


_REV = "(SELECT p_type, r_name, sum(l_quantity) AS v FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)"


def _regions(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    j = j.join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("p_type", "r_name").agg(F.sum("l_quantity").alias("v"))


@query(f"SELECT t.p_type, t.v AS target_value, median(o.v) AS median_other, count(*) AS n_other, round(t.v / median(o.v), 6) AS fold FROM {_REV} t JOIN {_REV} o ON t.p_type = o.p_type AND o.r_name <> 'ASIA' WHERE t.r_name = 'ASIA' GROUP BY 1, 2")
def derived_specificity(spark, d):
    return verbs.specificity(_regions(spark, d), "p_type", "r_name", "v", "ASIA").withColumn("fold", r6("fold"))


@query(
    """WITH e AS (SELECT p_brand, p_partkey, p_retailprice - 1200 AS effect FROM part)
    SELECT p_brand, count(DISTINCT p_partkey) AS n_units, round(avg(effect), 6) AS mean_effect, round(avg(CASE WHEN effect <= -200 THEN 1.0 ELSE 0 END), 6) AS share,
    (SELECT string_agg(p_partkey, ',' ORDER BY effect, p_partkey) FROM (SELECT * FROM e x WHERE x.p_brand = e.p_brand ORDER BY effect, p_partkey LIMIT 5)) AS lowest FROM e GROUP BY 1 HAVING count(*) >= 10"""
)
def derived_essentiality_by_group(spark, d):
    p = table(spark, d, "part").select("p_brand", "p_partkey", (F.col("p_retailprice") - 1200).alias("effect"))
    return verbs.level_groups(p, "p_brand", "p_partkey", "effect", -200, 10).withColumns({"mean_effect": r6("mean_effect"), "share": r6("share")})


# shapes


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("SELECT o_orderstatus, " + ", ".join(f"coalesce(count(*) FILTER (o_orderpriority = '{p}'), 0) AS p{i}" for i, p in enumerate(_PRIORITIES, 1)) + " FROM orders GROUP BY 1")
def pivot_long_to_wide(spark, d):
    wide = table(spark, d, "orders").groupBy("o_orderstatus").pivot("o_orderpriority", _PRIORITIES).count()
    return wide.select("o_orderstatus", *(F.coalesce(F.col(f"`{p}`"), F.lit(0)).cast("long").alias(f"p{i}") for i, p in enumerate(_PRIORITIES, 1)))


@query("SELECT s_suppkey, 'balance' AS col_key, s_acctbal AS value FROM supplier UNION ALL SELECT s_suppkey, 'nation', CAST(s_nationkey AS DOUBLE) FROM supplier")
def matrix_unpivot(spark, d):
    return long_view(table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation")), "s_suppkey", ["balance", "nation"])


# checks


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def quality_key_duplicates(spark, d):
    return quality.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def quality_dangling_refs(spark, d):
    return quality.dangling(table(spark, d, "lineitem"), "l_partkey", table(spark, d, "part").where("p_size > 5"), "p_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query(f"SELECT 'price' AS \"column\", count(*) FILTER (price IS NULL) AS n_null, count(*) AS n_rows FROM {_O} UNION ALL SELECT 'priority', count(*) FILTER (priority IS NULL), count(*) FROM {_O}")
def quality_nulls(spark, d):
    return quality.nulls(_orders(spark, d), ["price", "priority"])


@query("WITH e AS (SELECT DISTINCT c_nationkey AS a, o_custkey % 25 AS b FROM orders JOIN customer ON o_custkey = c_custkey) SELECT a, b FROM e x WHERE NOT EXISTS (SELECT 1 FROM e y WHERE y.a = x.b AND y.b = x.a)")
def quality_reverse_edges(spark, d):
    e = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("a"), (F.col("o_custkey") % 25).alias("b")).distinct()
    return graph.missing_reverse(e, "a", "b")


@query("SELECT 'c_custkey' AS \"column\", count(c_custkey) AS n_known, count(DISTINCT c_custkey) AS n_distinct, CAST(min(c_custkey) AS VARCHAR) AS low, CAST(max(c_custkey) AS VARCHAR) AS high FROM customer UNION ALL SELECT 'c_mktsegment', count(c_mktsegment), count(DISTINCT c_mktsegment), min(c_mktsegment), max(c_mktsegment) FROM customer")
def quality_leaf_statistics(spark, d):
    return quality.leaf_statistics(table(spark, d, "customer"), ["c_custkey", "c_mktsegment"])


@query("SELECT count(*) AS n_rows, CAST(sum(CAST('0x' || left(sha256(concat_ws('|', CAST(o_orderkey AS VARCHAR), o_orderstatus)), 8) AS BIGINT)) AS BIGINT) AS digest FROM orders")
def provenance_digest(spark, d):
    return quality.digest(table(spark, d, "orders"), ["o_orderkey", "o_orderstatus"])


# transforms


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS o_totalprice, false AS unchecked FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1995-06-30'")
def leakage_ceiling(spark, d):
    o = table(spark, d, "orders").withColumn("changed", F.when(F.col("o_orderkey") % 3 == 0, F.lit("1999-01-01")))
    return transforms.ceiling(o, "o_orderdate", "changed", ["o_totalprice"], "1995-06-30").select("o_orderkey", "o_totalprice", "unchecked")


@query("SELECT o_custkey, o_orderpriority, min(o_orderstatus) AS o_orderstatus, CAST(CASE WHEN count(DISTINCT o_orderstatus) > 1 THEN 1 ELSE 0 END AS BIGINT) AS conflicts FROM orders GROUP BY 1, 2")
def transform_levels(spark, d):
    return transforms.levels(table(spark, d, "orders"), ["o_custkey", "o_orderpriority"], ["o_orderstatus"])


@query("SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS n_met, count(*) FILTER (l_returnflag = 'A') AS n_not_met, count(*) FILTER (l_returnflag = 'N') AS n_unknown FROM lineitem GROUP BY 1")
def transform_flag_partition(spark, d):
    flag = F.when(F.col("l_returnflag") == "R", True).when(F.col("l_returnflag") == "A", False)
    b = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_partkey", flag.alias("ok"))).alias("items"))
    out = transforms.flag_partition(b, "items", "ok")
    return out.select("l_orderkey", *(F.size(f"items_{k}").cast("long").alias(f"n_{k}") for k in ("met", "not_met", "unknown")))


@query("SELECT l_orderkey, CASE WHEN count(*) > 3 THEN CAST(count(*) AS INTEGER) END AS items_total, CAST(least(count(*), 3) AS INTEGER) AS n_items, min(l_partkey) AS first_part FROM lineitem GROUP BY 1")
def transform_trim(spark, d):
    b = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_partkey")).alias("items"))
    out = transforms.trim(b, "items", 3)
    return out.select("l_orderkey", "items_total", F.size("items").alias("n_items"), F.col("items")[0].alias("first_part"))


@query("SELECT c_custkey, CASE WHEN c_acctbal BETWEEN 0 AND 5000 THEN c_acctbal END AS c_acctbal FROM customer")
def transform_validity(spark, d):
    return transforms.valid(table(spark, d, "customer"), ["c_acctbal"], 0, 5000).select("c_custkey", "c_acctbal")


@query("SELECT o_orderkey, last_day(CAST(o_orderdate AS DATE)) AS latest FROM orders")
def date_latest_day(spark, d):
    return table(spark, d, "orders").select("o_orderkey", latest_day(F.date_format("o_orderdate", "yyyy-MM")).alias("latest"))


@query("SELECT c_custkey, lower(regexp_replace(trim(c_name), '^Customer#', '')) AS bare FROM customer")
def identifier_normalise(spark, d):
    return table(spark, d, "customer").select("c_custkey", normalised(F.col("c_name"), ["strip", "strip_prefix=Customer#", "lower"]).alias("bare"))


# analyses


@query("SELECT event_type, count(DISTINCT user_id) AS n_cells, round(sum(value), 2) AS total, round(avg(CASE WHEN value > 0 THEN 1.0 ELSE 0 END), 6) AS detected FROM events GROUP BY 1 HAVING count(DISTINCT user_id) >= 3")
def analysis_pseudobulk(spark, d):
    return statistics.pseudobulk(table(spark, d, "events"), ["event_type"], "user_id", "value", 3).select("event_type", "n_cells", F.round("total", 2).alias("total"), r6("detected").alias("detected"))


@query(
    """WITH q AS (SELECT p_brand, quantile_cont(p_retailprice, 0.25) AS lo, quantile_cont(p_retailprice, 0.75) AS hi FROM part GROUP BY 1)
    SELECT p_partkey, CASE WHEN p_retailprice <= lo THEN 'low' ELSE 'high' END AS part FROM part JOIN q USING (p_brand) WHERE p_retailprice <= lo OR p_retailprice >= hi"""
)
def analysis_quartile_split(spark, d):
    return statistics.quartile_split(table(spark, d, "part"), "p_brand", "p_retailprice").select("p_partkey", "part")


@query("SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER (PARTITION BY p_brand)) / nullif(stddev_samp(p_retailprice) OVER (PARTITION BY p_brand), 0), 6) AS z FROM part")
def analysis_zscore_composite(spark, d):
    return statistics.z_scores(table(spark, d, "part"), "p_brand", "p_retailprice").select("p_partkey", r6("z").alias("z"))


@query(
    """WITH r AS (SELECT quality, toxic, rank() OVER (PARTITION BY quality ORDER BY n_chars) + (count(*) OVER (PARTITION BY quality, n_chars) - 1) / 2.0 AS mid FROM labels JOIN documents USING (doc_id)),
    g AS (SELECT quality, count(*) FILTER (toxic = 1) AS n1, count(*) FILTER (toxic = 0) AS n0, sum(mid) FILTER (toxic = 1) AS s FROM r GROUP BY 1)
    SELECT quality, n1 AS n_positive, n0 AS n_negative, CASE WHEN n1 * n0 > 0 THEN round((s - n1 * (n1 + 1) / 2) / (n1 * n0), 6) END AS auc FROM g"""
)
def analysis_auc(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    return statistics.auc(j, ["quality"], "n_chars", "toxic").select("quality", "n_positive", "n_negative", r6("auc").alias("auc"))


@query(
    """WITH c AS (SELECT o_orderstatus, count(*) FILTER (o_totalprice > 150000 AND o_orderpriority < '3') AS a, count(*) FILTER (o_totalprice > 150000 AND o_orderpriority >= '3') AS b, count(*) FILTER (o_totalprice <= 150000 AND o_orderpriority < '3') AS c, count(*) FILTER (o_totalprice <= 150000 AND o_orderpriority >= '3') AS d FROM orders GROUP BY 1)
    SELECT o_orderstatus, a, b, c, d, round(a * d / (b * c), 6) AS odds_ratio FROM c"""
)
def analysis_2x2_odds(spark, d):
    out = statistics.odds(table(spark, d, "orders"), ["o_orderstatus"], F.col("o_totalprice") > 150000, F.col("o_orderpriority") < "3")
    return out.select("o_orderstatus", "a", "b", "c", "d", r6("odds_ratio").alias("odds_ratio"))


@query(f"SELECT p_type, round((count(*) - sum(v) / max(v)) / (count(*) - 1), 6) AS tau FROM {_REV} GROUP BY 1")
def analysis_tau(spark, d):
    return statistics.tau(_regions(spark, d), "p_type", "v").withColumn("tau", r6("tau"))


@query(
    """WITH m AS (SELECT p_brand, count(*)::DOUBLE AS n, skewness(p_retailprice) AS g1, kurtosis(p_retailprice) AS g2 FROM part GROUP BY 1)
    SELECT p_brand, round((g1 * g1 + 1) / (g2 + 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3))), 4) AS bc FROM m WHERE n >= 4"""
)
def analysis_bimodality(spark, d):
    return statistics.bimodality(table(spark, d, "part"), "p_brand", "p_retailprice").where("bc is not null").withColumn("bc", F.round("bc", 4))


@query()
def analysis_two_means(spark, d):
    return statistics.two_means(table(spark, d, "part"), "p_type", "p_retailprice").withColumn("threshold", F.round("threshold", 4))


@query(
    """SELECT a.o_orderkey FROM orders a WHERE a.o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderstatus = 'O' AND b.o_orderdate >= a.o_orderdate)"""
)
def analysis_phase_progression(spark, d):
    o = table(spark, d, "orders")
    later = o.where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_open"))
    return o.where("o_orderstatus = 'F'").join(later, "o_custkey").where("last_open >= o_orderdate").select("o_orderkey")


@query(
    """SELECT o_custkey, count(DISTINCT o_orderkey) AS n_orders, max(o_orderdate) AS latest, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS combo FROM orders GROUP BY 1"""
)
def analysis_trial_rollup(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderkey").alias("n_orders"), F.max("o_orderdate").alias("latest"), F.array_join(F.sort_array(F.collect_set("o_orderpriority")), "|").alias("combo"))


@query()
def sample_balanced(spark, d):
    return verbs.balanced_sample(table(spark, d, "customer"), "c_nationkey", "c_mktsegment", "c_custkey", 500).select("c_custkey", "c_nationkey", "c_mktsegment")


@query("SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'removed' WHEN p_partkey % 13 = 0 THEN 'added' ELSE 'changed' END AS change FROM part WHERE (p_partkey % 11 = 0) <> (p_partkey % 13 = 0) OR (p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 AND p_partkey % 17 = 0)")
def release_diff(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_retailprice")
    new = p.where("p_partkey % 11 != 0").withColumn("p_retailprice", F.when(F.col("p_partkey") % 17 == 0, F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice")))
    return verbs.release_diff(p.where("p_partkey % 13 != 0"), new, ["p_partkey"], ["p_retailprice"])


# further verbs and functions


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey = 5 AND l_linenumber = 1")
def lookup_composite(spark, d):
    return verbs.lookup(table(spark, d, "lineitem"), {"l_orderkey": 5, "l_linenumber": 1}).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment) AS segments, count(DISTINCT c_mktsegment) AS n_segments FROM customer GROUP BY 1")
def agg_distinct_values(spark, d):
    found = table(spark, d, "customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_set("c_mktsegment")).alias("s"))
    return found.select("c_nationkey", F.array_join("s", "|").alias("segments"), F.size("s").cast("long").alias("n_segments"))


@query("SELECT DISTINCT c_custkey FROM customer WHERE c_nationkey = 4")
def members_direct(spark, d):
    return graph.direct_members(table(spark, d, "customer"), "c_nationkey", "c_custkey", 4)


@query(
    """WITH a AS (SELECT 'n' || c_nationkey AS s, c_custkey AS m FROM customer WHERE c_custkey % 3 <> 0 UNION SELECT 'r' || n_regionkey, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 2 = 0)
    SELECT count(*) AS n_annotations, count(*) FILTER (s LIKE 'r%' AND m % 3 <> 0) AS n_mixed, round(count(*) FILTER (s LIKE 'r%' AND m % 3 <> 0) / count(*), 6) AS fraction FROM a"""
)
def members_mixed_fraction(spark, d):
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    own = c.where("c_custkey % 3 != 0").select(F.concat(F.lit("n"), "c_nationkey").alias("s"), F.col("c_custkey").alias("m"))
    top = c.where("c_custkey % 2 = 0").select(F.concat(F.lit("r"), "n_regionkey").alias("s"), F.col("c_custkey").alias("m"))
    up = _hierarchy(spark, d).where(F.col("parent").startswith("r"))
    return graph.mixed_fraction(own.unionByName(top), "s", "m", up, "parent", "child").withColumn("fraction", r6("fraction"))


@query(
    """WITH RECURSIVE e AS (SELECT n_nationkey AS a, CAST(n_nationkey * 7 % 20 AS INTEGER) AS b FROM nation), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
    SELECT a, b FROM e WHERE a IN (SELECT a FROM r WHERE a = b)"""
)
def graph_cycles(spark, d):
    e = table(spark, d, "nation").select(F.col("n_nationkey").alias("a"), (F.col("n_nationkey") * 7 % 20).cast("int").alias("b"))
    return graph.cyclic_nodes(e, "a", "b")


@query(
    """WITH v AS (SELECT DISTINCT lower(trim(left(n_name, 2) || substr(n_name, 4))) AS value FROM nation WHERE n_nationkey % 2 = 0 UNION SELECT lower(trim(n_name || 'X')) FROM nation WHERE n_nationkey % 3 = 0)
    SELECT DISTINCT value, lower(trim(n_name)) AS suggestion FROM v, nation WHERE levenshtein(value, lower(trim(n_name))) <= 1"""
)
def resolve_suggestions(spark, d):
    n = table(spark, d, "nation")
    messy = n.where("n_nationkey % 2 = 0").select(F.expr("left(n_name, 2) || substr(n_name, 4)").alias("value")).unionByName(n.where("n_nationkey % 3 = 0").select(F.expr("n_name || 'X'").alias("value")))
    return resolve.suggestions(messy, "value", n, "n_name")


@query("SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS midrank FROM part")
def analysis_midrank(spark, d):
    return statistics.midranks(table(spark, d, "part"), ["p_brand"], "p_size").select("p_partkey", "midrank")


@query(f"SELECT p_type, r_name, round(v / sum(v) OVER (PARTITION BY p_type), 6) AS share FROM {_REV}")
def analysis_proportions(spark, d):
    return statistics.proportions(_regions(spark, d), ["p_type"], "v").select("p_type", "r_name", r6("share").alias("share"))


@query(
    """SELECT p_partkey FROM part WHERE p_size >= (SELECT quantile_cont(p_size, 0.75) FROM part) AND p_retailprice >= (SELECT quantile_cont(p_retailprice, 0.75) FROM part)"""
)
def analysis_top_fraction(spark, d):
    return statistics.top_fraction(table(spark, d, "part"), ["p_size", "p_retailprice"], 0.25).select("p_partkey")


@query(
    """WITH s AS (SELECT c_nationkey, count(*) AS n, sum(count(*)) OVER () AS r FROM customer GROUP BY 1), p AS (SELECT *, least(100, r) AS w FROM s),
    f AS (SELECT c_nationkey, n, w, CAST(n * w // r AS BIGINT) AS base, n * w % r AS rest FROM p),
    q AS (SELECT c_nationkey, n, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, c_nationkey) <= w - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM f)
    SELECT c_nationkey, n, CAST(quota AS BIGINT) AS quota, CAST(quota AS BIGINT) AS drawn FROM q"""
)
def sample_quota(spark, d):
    c = table(spark, d, "customer")
    drawn = statistics.downsample(c, "c_nationkey", "c_custkey", 100).groupBy("c_nationkey").agg(F.count("*").alias("drawn"))
    return statistics.quotas(c, "c_nationkey", 100).join(drawn, "c_nationkey", "left").select("c_nationkey", "n", "quota", F.coalesce("drawn", F.lit(0)).cast("long").alias("drawn"))


@query("SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 0.5 WHEN 1 THEN 2.0 WHEN 2 THEN 2.0 WHEN 3 THEN 3.0 WHEN 4 THEN 4.0 END::DOUBLE AS phase FROM orders")
def scalar_phase_number(spark, d):
    written = F.element_at(F.array(*map(F.lit, ("Early Phase 1", "PHASE II", "Phase 1/Phase 2", "Phase III", "Phase 4", "N/A"))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", phase_number(written).alias("phase"))


@query("SELECT p_brand, round((avg(CASE WHEN p_size > 25 THEN 1.0 ELSE 0 END) * (count(*) - 1) + 0.5) / count(*), 6) AS share FROM part GROUP BY 1")
def scalar_squeezed(spark, d):
    shares = table(spark, d, "part").groupBy("p_brand").agg(F.avg((F.col("p_size") > 25).cast("double")).alias("s"), F.count("*").alias("n"))
    return shares.select("p_brand", r6(squeezed(F.col("s"), F.col("n"))).alias("share"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE -(l_orderkey % 400) < -200 OR (l_orderkey % 400 = 200 AND 1 + l_quantity / 10 < 3)")
def filter_mantissa_exponent(spark, d):
    li = table(spark, d, "lineitem").select("*", (1 + F.col("l_quantity") / 10).alias("m"), (-(F.col("l_orderkey") % 400)).alias("e"))
    return li.where(below("m", "e", 3.0, -200)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_path_value(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def windowed_counts(spark, d):
    return windowed(table(spark, d, "events"), "1 day").select(F.unix_timestamp("start").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


from candor import analyses  # noqa: E402, F401  registers its queries in QUERIES

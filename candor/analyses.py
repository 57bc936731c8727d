"""Queries of the relational analyses and of identifier forms, each with its equivalent in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from candor.functions.scalar import IDENTIFIERS, is_kind
from candor.operators import analysis, graph, statistics, verbs
from candor.plans.predicate import where
from candor.queries import _E, _O, _bipartite, _orders, query, r6, table


@query("SELECT user_id, count(DISTINCT CASE WHEN value > 0 THEN event_type END) AS n_genes, round(sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END) / sum(value), 6) AS share FROM events GROUP BY 1 HAVING count(DISTINCT CASE WHEN value > 0 THEN event_type END) BETWEEN 2 AND 9 AND coalesce(sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END) / sum(value), 0) <= 0.5")
def analysis_qc_filter(spark, d):
    return analysis.qc_filter(table(spark, d, "events"), "user_id", "event_type", "value", 2, 9, F.col("event_type") == "click", 0.5).withColumn("share", r6("share"))


@query("SELECT event_id, round(ln(1 + 10000 * value / sum(value) OVER (PARTITION BY user_id)), 6) AS value FROM events")
def analysis_normalise_log1p(spark, d):
    return analysis.normalise_log1p(table(spark, d, "events").select("event_id", "user_id", F.col("value").alias("count")), "user_id", "count").select("event_id", r6("value").alias("value"))


@query(
    """WITH n AS (SELECT c_nationkey, o_orderstatus, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2, 3 HAVING count(*) >= 3), e AS (SELECT c_nationkey, o_orderstatus, count(*) AS d FROM n GROUP BY 1, 2 HAVING count(*) >= 2)
    SELECT c_nationkey, min(d) AS least_donors FROM e GROUP BY 1 HAVING count(*) = 2"""
)
def analysis_eligible_types(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return analysis.eligible_types(j, "c_nationkey", "o_orderstatus", "o_custkey", ["F", "O"], 2, 3)


@query("SELECT o_orderpriority, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS n_cases, count(DISTINCT CASE WHEN NOT o_orderstatus = 'F' THEN o_custkey END) AS n_controls, count(DISTINCT year(o_orderdate)) AS n_datasets FROM orders GROUP BY 1 HAVING count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) >= 5 AND count(DISTINCT CASE WHEN NOT o_orderstatus = 'F' THEN o_custkey END) >= 5")
def analysis_disease_qc(spark, d):
    o = table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    return analysis.arm_counts(o, "o_orderpriority", F.col("o_orderstatus") == "F", "o_custkey", "year", 5)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def analysis_without_overlap(spark, d):
    o = table(spark, d, "orders")
    return analysis.without_overlap(o.where("o_orderstatus = 'P'"), o.where("o_orderstatus = 'O'"), "o_custkey").select("o_orderkey")


_SUP = "(SELECT s_suppkey, s_nationkey, CAST(s_suppkey % 3 AS INTEGER) AS b, CAST(s_suppkey % 7 AS INTEGER) AS c FROM supplier)"


@query(
    f"""WITH s AS {_SUP}, r AS (SELECT * FROM s WHERE s_suppkey % 2 = 0), n AS (SELECT * FROM s WHERE s_suppkey % 2 = 1),
    m AS (SELECT r.s_suppkey AS key, n.s_suppkey AS normal_key, CASE WHEN r.c = n.c THEN 0 WHEN r.b = n.b THEN 1 ELSE 2 END AS level FROM r JOIN n USING (s_nationkey))
    SELECT key, normal_key, CAST(level AS INTEGER) AS level FROM m QUALIFY level = min(level) OVER (PARTITION BY key)"""
)
def analysis_prioritised_normals(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), "s_nationkey", (F.col("s_suppkey") % 3).cast("int").alias("b"), (F.col("s_suppkey") % 7).cast("int").alias("c"))
    return analysis.prioritised(s.where("key % 2 = 0"), s.where("key % 2 = 1").withColumnRenamed("key", "normal_key"), "s_nationkey", ["c", "b"], "key", "normal_key")


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE round(p_retailprice + p_partkey % 3, 6) END AS ours, round(p_retailprice, 6) AS theirs, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_partkey % 3 AS DOUBLE) END AS difference,
    CASE WHEN p_partkey % 5 = 0 THEN 'missing' WHEN p_partkey % 3 <= 1 THEN 'equal' ELSE 'different' END AS status FROM part"""
)
def analysis_compare_tables(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_retailprice")
    ours = p.where("p_partkey % 5 != 0").withColumn("p_retailprice", F.col("p_retailprice") + F.col("p_partkey") % 3)
    out = analysis.compared(ours, p, ["p_partkey"], "p_retailprice", 1.001)
    return out.withColumns({c: r6(c) for c in ("ours", "theirs", "difference")})


@query(
    """WITH m AS (SELECT DISTINCT l_partkey AS probe, l_suppkey % 4 AS gene FROM lineitem WHERE l_partkey % 3 = 0), s AS (SELECT probe, min(gene) AS gene FROM m GROUP BY 1 HAVING count(*) = 1)
    SELECT CAST(gene AS BIGINT) AS gene, l_linenumber AS sample, round(avg(l_quantity), 6) AS value FROM lineitem JOIN s ON l_partkey = probe GROUP BY 1, 2"""
)
def analysis_collapse_probes(spark, d):
    li = table(spark, d, "lineitem")
    probes = li.where("l_partkey % 3 = 0").select(F.col("l_partkey").alias("probe"), (F.col("l_suppkey") % 4).cast("long").alias("gene"))
    values = li.select(F.col("l_partkey").alias("probe"), F.col("l_linenumber").alias("sample"), F.col("l_quantity").alias("value"))
    return analysis.collapse_probes(values, probes, "probe", "gene", "sample", "value").withColumn("value", r6("value"))


@query(
    """WITH v AS (SELECT n_nationkey AS k FROM nation UNION SELECT 900), m AS (SELECT k, count(DISTINCT s_suppkey) AS n, min(s_suppkey) AS t FROM v LEFT JOIN supplier ON s_nationkey = k AND s_suppkey % 5 = 0 GROUP BY 1)
    SELECT CAST(k AS INTEGER) AS k, CASE WHEN n = 1 THEN t END AS target, CASE WHEN n = 1 THEN 'mapped' WHEN n > 1 THEN 'ambiguous' ELSE 'not_found' END AS status FROM m"""
)
def resolve_crosswalk(spark, d):
    values = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("k")).unionByName(spark.createDataFrame([(900,)], "k int"))
    return analysis.hop(values, "k", table(spark, d, "supplier").where("s_suppkey % 5 = 0"), "s_nationkey", "s_suppkey")


@query(f"SELECT o_custkey, min(priority) AS priority, count(DISTINCT priority) > 1 AS conflict FROM {_O} GROUP BY 1")
def agg_one_per_level(spark, d):
    return analysis.one_per_level(_orders(spark, d), ["o_custkey"], "priority")


_LEVELS = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]


@query(
    f"""WITH l AS (SELECT o_custkey, list_position({_LEVELS}, priority) AS p FROM {_O} WHERE priority IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY p) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM l)
    SELECT o_custkey, list_extract({_LEVELS}, CAST(p AS INTEGER)) AS value FROM r WHERE k = CAST(ceil(n / 2) AS BIGINT)"""
)
def agg_ordinal_median(spark, d):
    return analysis.ordinal(_orders(spark, d), ["o_custkey"], "priority", _LEVELS, "median")


@query(f"SELECT o_custkey, list_extract({_LEVELS}, CAST(max(list_position({_LEVELS}, priority)) AS INTEGER)) AS value FROM {_O} WHERE priority IS NOT NULL GROUP BY 1")
def agg_ordinal_max(spark, d):
    return analysis.ordinal(_orders(spark, d), ["o_custkey"], "priority", _LEVELS, "max")


@query(
    """WITH p AS (SELECT l_suppkey, 1 + l_quantity / 10 AS m, CAST(-(l_orderkey % 400) AS BIGINT) AS e FROM lineitem)
    SELECT l_suppkey, round(m, 6) AS m, e FROM p QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY log10(m) + e, m, e) = 1"""
)
def agg_least_p(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", (1 + F.col("l_quantity") / 10).alias("m"), (-(F.col("l_orderkey") % 400)).cast("long").alias("e"))
    return analysis.least_p(li, ["l_suppkey"], "m", "e").withColumn("m", r6("m"))


_SPOTS = "(SELECT s_suppkey, s_nationkey, s_suppkey * 37 % 101 AS x, s_suppkey * 53 % 97 AS y, s_acctbal FROM supplier)"
_RINGS = f"""near AS (SELECT q.s_suppkey AS query, p.s_suppkey AS neighbour, p.s_acctbal, p.s_suppkey % 2 AS l, row_number() OVER (PARTITION BY q.s_suppkey ORDER BY (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y), p.s_suppkey) AS place
    FROM {_SPOTS} q JOIN {_SPOTS} p ON q.s_nationkey = p.s_nationkey AND p.s_suppkey <> q.s_suppkey WHERE q.s_suppkey % 20 = 0)"""


def _spots(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", "s_nationkey", (F.col("s_suppkey") * 37 % 101).alias("x"), (F.col("s_suppkey") * 53 % 97).alias("y"), "s_acctbal", (F.col("s_suppkey") % 2).alias("l"))


def _rings(spark, d):
    return analysis.rings(_spots(spark, d), "s_nationkey", "s_suppkey", "x", "y", [2, 3], F.col("s_suppkey") % 20 == 0)


@query(f"WITH {_RINGS} SELECT query, neighbour, CAST(place AS INTEGER) AS place, CAST(CASE WHEN place <= 2 THEN 1 ELSE 2 END AS INTEGER) AS ring FROM near WHERE place <= 5")
def analysis_knn_rings(spark, d):
    return _rings(spark, d)


@query(f"WITH {_RINGS} SELECT query, CAST(CASE WHEN place <= 2 THEN 1 ELSE 2 END AS INTEGER) AS ring, round(avg(s_acctbal), 4) AS mean FROM near WHERE place <= 5 GROUP BY 1, 2")
def analysis_ring_means(spark, d):
    return analysis.ring_means(_rings(spark, d), _spots(spark, d), "s_suppkey", "s_acctbal").withColumn("mean", F.round("mean", 4))


@query(f"WITH {_RINGS}, c AS (SELECT query, l, count(*) AS c FROM near WHERE place <= 5 GROUP BY 1, 2) SELECT query, round(sum(c) * sum(c) / sum(c * c), 6) AS ilisi FROM c GROUP BY 1")
def analysis_ilisi(spark, d):
    return analysis.mixing(_rings(spark, d), _spots(spark, d), "s_suppkey", "l").withColumn("ilisi", r6("ilisi"))


@query("SELECT p_brand, CAST(max(p_size) AS INTEGER) AS max_phase, count(DISTINCT p_partkey) AS n_trials, max(p_size) >= 50 AS reached FROM part GROUP BY 1")
def analysis_target_levels(spark, d):
    return analysis.target_levels(table(spark, d, "part").withColumn("p_size", F.col("p_size").cast("int")), "p_brand", "p_partkey", "p_size", 50)


@query("WITH p AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 48) SELECT l_orderkey, CAST(max(CASE WHEN p.l_partkey IS NOT NULL THEN 1 ELSE 0 END) AS INTEGER) AS flag FROM lineitem l LEFT JOIN p ON l.l_partkey = p.l_partkey AND l.l_suppkey = p.l_suppkey GROUP BY 1")
def analysis_genetic_flags(spark, d):
    li = table(spark, d, "lineitem")
    return analysis.flagged_pairs(li, "l_orderkey", "l_partkey", "l_suppkey", li.where("l_quantity > 48").select("l_partkey", "l_suppkey"))


@query(
    """WITH t AS (SELECT o_orderkey, o_orderstatus, o_orderdate, list_sort(list(DISTINCT l_suppkey % 5)) AS s, list(DISTINCT l_partkey % 9) AS o FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)
    SELECT a.o_orderkey FROM t a WHERE a.o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM t b WHERE b.o_orderstatus = 'P' AND b.s = a.s AND list_has_any(b.o, a.o) AND b.o_orderdate >= a.o_orderdate)"""
)
def analysis_progression_sets(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    t = j.groupBy("o_orderkey", "o_orderstatus", "o_orderdate").agg(F.collect_set(F.col("l_suppkey") % 5).alias("s"), F.collect_set(F.col("l_partkey") % 9).alias("o"))
    return analysis.progression(t, "o_orderkey", "o_orderstatus", "F", "P", "s", "o", "o_orderdate")


@query("SELECT event_type, round(avg(CASE WHEN coalesce(value, 0) > 0 THEN 1.0 ELSE 0 END), 6) AS share FROM events GROUP BY 1 HAVING avg(CASE WHEN coalesce(value, 0) > 0 THEN 1.0 ELSE 0 END) >= 0.5")
def analysis_detected(spark, d):
    return analysis.detected(table(spark, d, "events"), "event_type", "value", 0.5).withColumn("share", r6("share"))


@query(
    """WITH b AS (SELECT p_size AS a, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE p_size END AS b, p_brand AS c, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS e FROM part)
    SELECT 'p_size' AS field, count(*) AS n, count(*) FILTER (a = b) AS n_equal, round(count(*) FILTER (a = b) / count(*), 6) AS share FROM b UNION ALL SELECT 'p_brand', count(e), count(*) FILTER (c = e), round(count(*) FILTER (c = e) / count(e), 6) FROM b"""
)
def analysis_agreement(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_brand")
    theirs = p.select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, 0).otherwise(F.col("p_size")).alias("p_size"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).alias("p_brand"))
    return analysis.shared_answers(p, theirs, "p_partkey", ["p_size", "p_brand"]).withColumn("share", r6("share"))


@query("SELECT p_brand, round(quantile_cont(CAST(p_retailprice AS DOUBLE), 0.1), 6) AS q0, round(quantile_cont(CAST(p_retailprice AS DOUBLE), 0.9), 6) AS q1 FROM part GROUP BY 1")
def stat_quantiles(spark, d):
    return statistics.quantiles(table(spark, d, "part"), ["p_brand"], "p_retailprice", [0.1, 0.9]).select("p_brand", r6("q0").alias("q0"), r6("q1").alias("q1"))


@query(f"WITH e AS (SELECT * FROM {_E}), h1 AS (SELECT DISTINCT b AS node FROM e WHERE a = 's1'), n AS (SELECT 's1' AS node UNION SELECT node FROM h1 UNION SELECT a FROM e JOIN h1 ON b = node) SELECT least(a, b) AS a, greatest(a, b) AS b, n_lines FROM e WHERE a IN (SELECT node FROM n) AND b IN (SELECT node FROM n)")
def network_edges_of_two_hops(spark, d):
    e = _bipartite(spark, d)
    return graph.network_edges(e, "a", "b", graph.expand_network(e, "a", "b", spark.createDataFrame([("s1",)], "node string"), 2, 100_000))


@query(f"SELECT o_orderkey FROM {_O} WHERE priority IS NULL AND NOT price IS NULL")
def filter_is_null(spark, d):
    o = _orders(spark, d)
    return o.where(where(o, {"is_null": "priority"}, {"not": {"is_null": "price"}})).select("o_orderkey")


@query("WITH s AS (SELECT o_custkey, o_orderstatus FROM orders WHERE o_custkey % 7 <> 0 UNION ALL SELECT NULL, o_orderstatus FROM orders WHERE o_custkey % 7 = 0) SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'F') AND bool_or(o_orderstatus <> 'F') THEN 'both' WHEN bool_or(o_orderstatus = 'F') THEN 'left_only' ELSE 'right_only' END AS side FROM s GROUP BY 1")
def set_compare_null_keys(spark, d):
    o = table(spark, d, "orders").select(F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("o_custkey"), "o_orderstatus")
    return verbs.compare_sets(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus != 'F'"), ["o_custkey"])


_FORMS = {
    "cellosaurus": "CVCL_0030", "census_joinid": "12", "cell_barcode": "ACGTACGTAC-1", "census_feature": "ENSG00000141510", "chembl_molecule": "CHEMBL25", "chromosome": "X", "depmap_cell_line": "ACH-000001", "doi": "10.1000/xyz",
    "drug_name": "aspirin", "ensembl_gene": "ENSG00000141510", "ensembl_gene_mouse": "ENSMUSG00000059552", "ensembl_gene_any": "ENSRNOG00000010756", "europepmc_ppr": "PPR1", "geo_gsm": "GSM12", "go": "GO:0006915", "hgnc_symbol": "TP53",
    "hpo": "HP_0000118", "inchikey": "BSYNRYMUTXBXSQ-UHFFFAOYSA-N", "ncbi_taxon": "9606", "ncbi_gene": "7157", "nct_id": "NCT00000102", "cell_ontology": "CL:0000540", "uberon": "UBERON:0000955", "disease_name": "asthma", "pmcid": "PMC12",
    "pmid": "123", "reactome": "R-HSA-109581", "rsid": "rs7412", "so": "SO:0001583", "study_locus_id": "0123456789abcdef0123456789abcdef", "cbio_cancer_type": "brca", "cbio_study": "brca_tcga", "cbio_sample": "TCGA-A1-A0SB-01",
    "cbio_patient": "TCGA-A1-A0SB", "europepmc_id": "PPR12", "ot_disease": "EFO_0000305", "gwas_study": "GCST000001", "tahoe_drug": "a drug", "tahoe_gene_name": "TP53", "uniprot_accession": "P04637", "ot_variant": "19_44908822_C_T",
}


@query(
    "WITH f(kind, value, pattern) AS (VALUES " + ", ".join(f"('{k}', '{v}', '{IDENTIFIERS[k]}')" for k, v in _FORMS.items()) + ") SELECT kind, regexp_matches(value, pattern) AS own, (SELECT count(*) FROM f g WHERE regexp_matches(f.value, g.pattern)) AS n_kinds FROM f"
)
def identifier_kinds(spark, d):
    rows = spark.createDataFrame(list(_FORMS.items()), "kind string, value string")
    matched = {k: is_kind(F.col("value"), k) for k in _FORMS}
    own = F.coalesce(*(F.when(F.col("kind") == k, m) for k, m in matched.items()))
    n = sum((m.cast("long") for m in matched.values()), F.lit(0))
    return rows.select("kind", own.alias("own"), n.alias("n_kinds"))

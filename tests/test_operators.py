"""Operators on nulls, ties, empty tables and texts of any length, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from candor.functions import scalar
from candor.functions.scalar import phase_number
from candor.operators import analysis, graph, resolve, statistics, transforms, verbs
from candor.plans import predicate
from candor.sources import formats


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_suggestions_equal_all_pairs(spark):
    pick = random.Random(5)
    texts = ["".join(pick.choice("abé") for _ in range(pick.randint(0, 5))) for _ in range(160)]
    values, labels = texts[:80], texts[80:]
    got = resolve.suggestions(spark.createDataFrame([(v,) for v in [*values, None]], "v string"), "v", spark.createDataFrame([(x,) for x in [*labels, None]], "l string"), "l")
    assert {tuple(r) for r in got.collect()} == {(v, x) for v in values for x in labels if v and x and one_edit(v, x)}


def test_midranks_of_nulls_and_ties(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 3), ("a", None), ("b", 2)], "g string, x int")
    assert sorted((r.g, r.x or 0, r.midrank or 0) for r in statistics.midranks(df, ["g"], "x").collect()) == [("a", 0, 0), ("a", 1, 1.5), ("a", 1, 1.5), ("a", 3, 3.0), ("b", 2, 1.0)]


def test_quotas_sum_to_the_total_or_all_rows(spark):
    df = spark.createDataFrame([(g, i) for g, n in (("a", 7), ("b", 2), ("c", 1)) for i in range(n)], "g string, k int")
    for total, want in ((5, 5), (10, 10), (99, 10), (0, 0)):
        assert sum(r.quota for r in statistics.quotas(df, "g", total).collect()) == want
        assert statistics.downsample(df, "g", "k", total).count() == want
    assert statistics.downsample(df.where("false"), "g", "k", 5).count() == 0


def test_phases(spark):
    df = spark.createDataFrame([("Early Phase 1",), ("PHASE II/III",), ("Phase 10",), ("",), (None,), ("Phase IV",), ("PHASE 0",), ("2.5",), ("EARLY PHASE 2",), ("N/A",)], "t string")
    assert [r[0] for r in df.select(phase_number(df.t)).collect()] == [0.5, 3.0, 1.0, None, None, 4.0, 0.5, 2.5, 2.0, None]


def test_mixed_fraction_of_nothing(spark):
    rows, edges = spark.createDataFrame([], "s string, m int"), spark.createDataFrame([("r", "n")], "p string, c string")
    assert graph.mixed_fraction(rows, "s", "m", edges, "p", "c").first().asDict() == {"n_annotations": 0, "n_mixed": 0, "fraction": None}


def test_sets_with_null_keys_meet_once(spark):
    a, b = spark.createDataFrame([(None, 1), (1, None), (2, 2)], "k int, j int"), spark.createDataFrame([(None, 1), (1, None), (3, 3)], "k int, j int")
    got = {(r.k, r.j): r.side for r in verbs.compare_sets(a, b, ["k", "j"]).collect()}
    assert got == {(None, 1): "both", (1, None): "both", (2, 2): "left_only", (3, 3): "right_only"}
    diff = verbs.release_diff(a.withColumn("v", F.lit(1)), b.withColumn("v", F.when(F.col("k") == 1, 2).otherwise(1)), ["k", "j"], ["v"])
    assert {(r.k, r.j, r.change) for r in diff.collect()} == {(1, None, "changed"), (2, 2, "removed"), (3, 3, "added")}
    pairs = verbs.paired(a.withColumn("e", F.lit(1.0)), b.withColumn("e", F.lit(-2.0)), ["k"], "j", "e")
    assert sorted(r.kind for r in pairs.collect()) == ["opposite_direction", "opposite_direction", "unique_to_a", "unique_to_b"]


def test_cycles_are_components_not_what_lies_between(spark):
    pick = random.Random(3)
    for trial in range(4):
        edges = {(1, 2), (2, 1), (2, 5), (5, 3), (3, 4), (4, 3), (7, 7), (8, 9)} if not trial else {(pick.randrange(14), pick.randrange(14)) for _ in range(18)}
        reach = {n: {n} for e in edges for n in e}
        for _ in range(20):
            for x, y in edges:
                for n in reach:
                    if x in reach[n]:
                        reach[n] |= {y}
        want = {(x, y) for x, y in edges if x in reach[y]}
        got = {tuple(r) for r in graph.cyclic_nodes(spark.createDataFrame(sorted(edges), "a int, b int"), "a", "b").collect()}
        assert got == want
    with pytest.raises(graph.GraphError):
        graph.expand(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "p int, c int"), "p", "c", spark.createDataFrame([(1,)], "n int"))


def test_samples_fill_up(spark):
    rows = [(o, i, n) for o, i, count in (("x", "a", 3), ("x", "b", 40), ("y", "a", 5), ("z", "a", 50), ("z", "b", 5)) for n in range(count)]
    df = spark.createDataFrame([(o, i, k) for k, (o, i, _) in enumerate(rows)], "o string, i string, k int")
    for total, want in ((50, 50), (103, 103), (500, 103), (1, 1)):
        drawn = verbs.balanced_sample(df, "o", "i", "k", total).collect()
        assert len(drawn) == want == len({r.k for r in drawn})
    got = {}
    for r in verbs.balanced_sample(df, "o", "i", "k", 50).collect():
        got[r.o, r.i] = got.get((r.o, r.i), 0) + 1
    assert got == {("x", "a"): 3, ("x", "b"): 20, ("y", "a"): 5, ("z", "a"): 17, ("z", "b"): 5}


def test_unreadable_dates_are_kept_and_marked(spark):
    df = spark.createDataFrame([(1, "2020-01-01", None), (2, "soon", None), (3, None, None), (4, "2022", None), (5, "2020", "when?"), (6, "May 2020", "2023-01-01")], "k int, at string, changed string").withColumn("v", F.col("k"))
    got = {r.k: (r.v, r.unchecked) for r in transforms.ceiling(df, "at", "changed", ["v"], "2021-06-30").collect()}
    assert got == {1: (1, False), 2: (2, True), 3: (3, True), 5: (5, True), 6: (None, False)}


def test_requests_that_cannot_be_answered_raise(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 2.0])], "k int, v array<double>")
    for anchor in (1, 9):
        with pytest.raises(verbs.VerbError):
            verbs.similar(df, "k", "v", anchor, 5)
    with pytest.raises(verbs.VerbError):
        verbs.vocab(df, "k", 1)


def test_predicates_equal_their_twin_on_one_row(spark):
    pick, values = random.Random(11), [None, 0, 1, -2, 3]
    rows = [(i, pick.choice(values), pick.choice([None, float("nan"), 0.5, -1.5]), pick.choice([None, "", "Ab", "ab c"]), pick.choice([None, [], [1, None], [1, 3], [None]])) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, a int, f double, s string, l array<int>")

    def tree(depth):
        if depth and pick.random() < 0.5:
            kind = pick.choice(["and", "or", "not"])
            return {"not": tree(depth - 1)} if kind == "not" else {kind: [tree(depth - 1) for _ in range(pick.randint(1, 3))]}
        return pick.choice([{"eq": ["a", 1]}, {"ne": ["a", 0]}, {"lt": ["f", 0.7]}, {"ge": ["a", 0]}, {"in": ["a", [1, 3]]}, {"in": ["a", [1, None]]}, {"gt_abs": ["f", 1]}, {"range": ["a", -1, 2, True, False]}, {"contains": ["l", 1]}, {"nonempty": "l"}, {"is_null": "f"}, {"eq": ["s", 3]}, {"text": ["s", "AB", "casefold_substring"]}, {"text": ["s", "ab", "word"]}])

    trees = [tree(3) for _ in range(60)]
    got = df.select("i", *(predicate.where(df, p).alias(f"p{k}") for k, p in enumerate(trees))).collect()
    for r in got:
        row = dict(zip(("i", "a", "f", "s", "l"), rows[r.i]))
        for k, p in enumerate(trees):
            assert r[f"p{k}"] == predicate.truth(p, row), (p, row)
    assert predicate.bind({"in": ["a", [{"param": "x"}, 5]]}, {"x": [1, 2]}) == {"in": ["a", [1, 2, 5]]}
    with pytest.raises(predicate.PredicateError):
        predicate.bind({"eq": ["a", {"param": "y"}]}, {})


def test_files_come_back(spark, tmp_path):
    (tmp_path / "a.csv").write_text("#v1\n# two\nid,x,x\n1,2.5,\n2,NA,7\n")
    got = formats.delimited(spark, str(tmp_path / "a.csv"), null="NA", preamble=2)
    assert got.columns == ["id", "x", "x#2"] and [tuple(r) for r in got.orderBy("id").collect()] == [("1", "2.5", None), ("2", None, "7")]
    typed = formats.delimited(spark, str(tmp_path / "a.csv"), "id int, x double, y double", null="NA", preamble=2)
    assert [tuple(r) for r in typed.orderBy("id").collect()] == [(1, 2.5, None), (2, None, 7.0)]
    (tmp_path / "m.csv").write_text("gene,A (1),B (2)\ng1,1.5,2\ng2,,4\n")
    wide = formats.wide_matrix(spark, str(tmp_path / "m.csv"), "gene", ["B (2)"])
    assert sorted(tuple(r) for r in wide.collect()) == [("g1", "B (2)", 2.0), ("g2", "B (2)", 4.0)]
    (tmp_path / "r.jsonl").write_text('{"k": 1, "v": [1, 2]}\n{"k": 2, "v": null}\n')
    assert formats.json_lines(spark, str(tmp_path / "r.jsonl"), "k int, v array<int>").where("v is null").count() == 1
    sets = spark.createDataFrame([("s1", "d", ["a", "b"]), ("s2", "", ["c"])], "set_id string, description string, members array<string>")
    formats.write_gene_sets(sets, str(tmp_path / "gmt"))
    assert sorted(map(tuple, formats.gene_sets(spark, str(tmp_path / "gmt")).select("set_id", "description", "members").collect())) == [("s1", "d", ["a", "b"]), ("s2", "", ["c"])]
    (tmp_path / "o.obo").write_text('format-version: 1.2\n\n[Term]\nid: X:1\nname: one ! two\nnamespace: ns\ndef: "what it is" [r]\nalt_id: X:9\nsubset: slim\nsynonym: "uno" EXACT []\nis_a: X:0 ! zero\nrelationship: part_of X:5 ! five\n\n[Term]\nid: X:2\nname: gone\nis_obsolete: true\nreplaced_by: X:1\n')
    terms = {r.id: r for r in formats.ontology(spark, str(tmp_path / "o.obo")).collect()}
    assert terms["X:1"].name == "one ! two" and terms["X:1"].parents == ["X:0"] and [tuple(x) for x in terms["X:1"].synonyms] == [("uno", "exact")]
    assert (terms["X:1"].namespace, terms["X:1"].definition, terms["X:1"].alt_ids, terms["X:1"].subsets) == ("ns", "what it is", ["X:9"], ["slim"])
    assert terms["X:2"].obsolete and terms["X:2"].replaced_by == ["X:1"]
    made = formats.materialise(sets, str(tmp_path / "out"))
    assert made.count() == 2
    sets.withColumn("part", F.lit("x1")).write.partitionBy("part").parquet(str(tmp_path / "hive"))
    assert formats.partitioned(spark, str(tmp_path / "hive"), "set_id string, description string, members array<string>, part string").where("part = 'x1'").count() == 2
    with pytest.raises(formats.SourceError):
        formats.sharded(spark, str(tmp_path / "nothing"))
    known = scalar.known(spark.createDataFrame([(float("nan"), -1), (1.0, 2)], "x double, phase int"), {"phase": [-1]})
    assert sorted(map(tuple, known.collect()), key=str) == [(1.0, 2), (None, None)]


def test_identifier_forms(spark):
    good = {"ensembl_gene": "ENSG00000141510", "go": "GO:0006915", "uniprot_accession": "P04637", "ot_variant": "19_44908822_C_T", "nct_id": "NCT00000102", "rsid": "rs7412", "doi": "10.1000/xyz123", "europepmc_id": "PMC123", "gwas_study": "GCST000001", "ot_disease": "EFO_0000305", "chromosome": "X", "study_locus_id": "0" * 32}
    for kind, value in good.items():
        df = spark.createDataFrame([(value,), (value + "!",), ("",)], "v string")
        assert [r[0] for r in df.select(scalar.is_kind(df.v, kind)).collect()] == [True, kind == "doi", False], kind


def test_rings_equal_all_pairs_without_making_them(spark):
    rng = random.Random(6)
    spots = [(1, rng.random(), rng.random()) for _ in range(300)] + [(1, 500 + 1e-6 * rng.random(), -3.0) for _ in range(200)]  # two scales
    spots += [(2, 1.0, 1.0)] * 60 + [(3, float(i % 7), float(i % 5)) for i in range(90)] + [(4, 0.0, 0.0), (4, 1.0, 0.0), (None, 0.0, 0.0)]
    spots += [(5, None, 1.0), (5, 1.0, 2.0), (5, 3.0, None), (5, float("inf"), 0.0), (5, float("nan"), 0.0), (5, 0.0, 0.0)]
    rows = [(i, *s) for i, s in enumerate(spots)]
    points = spark.createDataFrame(rows, "k long, s int, x double, y double")

    def rank(q, p):
        if None in (*q[2:], *p[2:]):
            return 2, 0.0
        d = (p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2
        return (1, 0.0) if d != d else (0, d)

    want = set()
    for q in rows:
        if q[0] % 3 == 0 or q[1] == 5:
            others = sorted((rank(q, p), p[0]) for p in rows if p[1] == q[1] is not None and p[0] != q[0])
            want |= {(q[0], p, i + 1, 1 if i < 2 else 2) for i, (_, p) in enumerate(others[:5])}
    got = analysis.rings(points, "s", "k", "x", "y", [2, 3], (F.col("k") % 3 == 0) | (F.col("s") == 5))
    assert {tuple(r) for r in got.collect()} == want
    many = spark.range(20_000).select(F.col("id").alias("k"), F.lit(1).alias("s"), (F.col("id") * 37 % 10_007).alias("x"), (F.col("id") * 53 % 9_973).alias("y"))
    met = analysis._near(many.select(F.col("s").alias("s_"), F.col("k").alias("k_"), F.col("x").alias("x_"), F.col("y").alias("y_")), many.where("k % 20 = 0").select(F.col("s").alias("s_"), F.col("k").alias("q_"), F.col("x").alias("qx_"), F.col("y").alias("qy_")), 5)
    assert met.count() < 200 * 1000  # all pairs are 20 million

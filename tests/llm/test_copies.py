import random

import corpus_pipeline
import numpy as np
from candor.llm import simhash


def brute_shingles(text):
    found = (text or "").lower().split()
    return {tuple(found[i : i + 5]) for i in range(max(len(found) - 4, 1))} if found else set()


def brute_least(rows):
    """Rows that come first in their group of Jaccard 0.8 or more."""
    sets = [brute_shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if (not a and not sets[j]) or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]) > 0:
                root[find(i)] = find(j)
    best = {}
    for i, r in enumerate(rows):
        best.setdefault(find(i), []).append((r[0] is None, r[0] or 0, i))
    return [rows[min(b)[2]] for b in best.values()]


def test_ordinary_near_copies_go_and_others_stay(spark):
    rng = random.Random(8)
    texts = ["One two", "one  TWO", "", None, "a b c d e f"]
    for _ in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(80, 500))]
        texts.append(" ".join(base))
        for changed in (len(base) // 90 + 1, len(base) // 60, len(base) // 30, len(base) // 15):
            near = list(base)
            for _ in range(changed):
                near[rng.randrange(len(near))] = "x"
            texts.append(" ".join(near))
    rows = [(i, t, "s", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, row int").repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    got, want = {r.doc_id for r in kept.collect()}, {r[0] for r in brute_least(rows)}
    assert want <= got  # nothing goes that is no near copy
    assert len(got - want) <= 0.05 * (len(rows) - len(want))
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_null_and_repeated_ids_stay_apart(spark):
    rows = [(None, f"text number {i} of its own kind", i) for i in range(6)] + [(7, "first of two texts here", 6), (7, "quite another text this is", 7), (None, "quite another text this is", 8), (None, "", 9), (None, None, 10)]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, at int"), "").collect()
    at = {r["at"] for r in kept}
    assert len(kept) == 9 and set(range(8)) < at and len(at & {9, 10}) == 1


def test_no_link_of_a_loose_group_is_left_out(spark):
    rng = random.Random(3)
    rows = []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(100)]
        for _ in range(50):  # most pairs are below the threshold, some above it
            near = list(base)
            for at in rng.sample(range(100), rng.choice((1, 2, 3, 4))):
                near[at] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(near)))
    for n in (5, 20, 45, 90):  # exactly 0.8 and just below
        a = [f"n{n}w{i}" for i in range(n + 4)]
        rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(a + [f"y{n}{i}" for i in range(n // 4)]))]
        rows += [(len(rows), " ".join(f"z{w}" for w in a)), (len(rows) + 1, " ".join([f"z{w}" for w in a] + [f"y{n}{i}" for i in range(n // 4 + 1)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == sorted(r[0] for r in brute_least(rows))


def test_the_last_join_makes_no_pair_of_texts_that_share_a_passage_only_and_loses_no_link(spark):
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [" ".join(f"d{d}w{i}" for i in range(2000)) + " " + passage for d in range(30)]  # so long that 512 bits tell nothing
    for _ in range(40):
        near = [f"g{i}" for i in range(120)]
        for at in rng.sample(range(120), rng.choice((1, 2, 3, 4))):
            near[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(near))
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string").selectExpr("row", "row as doc_id", "text")
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # no shingle is known as frequent
    classes = simhash._signed(docs, 5, 0.8, none).withColumnRenamed("doc_id", "row").localCheckpoint()
    shared = simhash.shared_keys(classes)
    made = {(r.a, r.b) for r in simhash.apart(shared, classes, spark.createDataFrame([], "node long, root long"), 0.8).collect()}
    assert not [p for p in made if p[0] < 30 or p[1] < 30]
    sets = [brute_shingles(t) for t in texts]
    few = {}
    for r in shared.where("n <= 3").collect():
        few.setdefault(r.key, []).append(r.row)
    met = {(min(a, b), max(a, b)) for rows in few.values() for a in rows for b in rows if a != b}
    links = {(a, b) for b in range(len(sets)) for a in range(b) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert len(links) > 50 and links - met <= made

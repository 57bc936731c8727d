"""Held-out accuracy and brute-force twins of the operators that learn."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from candor.llm import langid, recurrent, toxicity, vectors

SYLLABLES = {"en": ["the", "ing", "er", "th", "ow"], "de": ["sch", "ung", "ein", "ü", "ich"], "fr": ["eau", "é", "oi", "que", "le"]}


def words(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        lang = rng.choice(["en", "de", "fr"])
        text = words(rng, lang, rng.randint(5, 60))
        if i % 6 == 0:
            text = text.replace(" ", " moron ", 3)
        rows.append((i, text, lang if i % 10 else None, "s", 1))
    rows += [(600, None, "en", "s", 1), (601, "", "de", "s", 1), (602, "123 !!", "en", "s", 1), (603, "x" * 50_000, "en", "s", 1), (5, rows[5][1], "fr", "s", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int")


def test_language(spark, docs):
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = langid.predict(docs).collect()
    assert len(rows) == 605
    held = [r for r in rows if r.held_out and truth[r.doc_id] and r.doc_id < 600]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) > 0.97 * len(held)
    assert {r.lang_pred for r in rows if r.doc_id in (600, 601, 602)} == {"und"}
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    kept = langid.with_language(docs)
    assert kept.columns == docs.columns and not {600, 601, 602} & {r.doc_id for r in kept.collect()}
    assert langid.predict(docs.limit(0)).count() == 0


def test_letters_are_unicode_letters(spark, docs):
    made = langid.fit(docs)
    assert made.predict(["² ½", "①②", "Ⅷ", "123 !!", "", "_"])[0] == ["und"] * 6
    assert made.predict(["日本", "é", "the thing"])[0][2] == "en" and "und" not in made.predict(["日本", "é"])[0]


def test_language_equals_brute_force(spark, docs):
    """The same rule with dictionaries of n-grams instead of filters."""
    counts: dict[str, Counter] = {}
    rows = docs.collect()

    def grams(text):
        found = "".join(c if ord(c) >= 128 or c.isalpha() else " " for c in (text or "").lower()).encode()
        found = b"  " + found + b"  "
        return [found[i : i + 4] for i in range(len(found) - 3)]

    for r in rows:
        if r.lang and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            counts.setdefault(r.lang, Counter()).update(grams(r.text))
    totals = {x: sum(c.values()) for x, c in counts.items()}
    top = Counter()
    for x, c in counts.items():
        for g, n in c.items():
            top[g] = max(top[g], n / totals[x])
    got = Counter()
    answers = Counter((r.doc_id, r.lang_pred, round(r.score, 1)) for r in langid.predict(docs).collect())
    near = Counter((r.doc_id, r.lang_pred) for r in langid.predict(docs).collect())
    for r in rows:
        own = grams(r.text)
        hits = {x: sum(c[g] / totals[x] >= top[g] * 0.25 and c[g] > 0 for g in own) for x, c in counts.items()}
        best = min(hits, key=lambda x: (-hits[x], x))
        got[(r.doc_id, best if any(c.isalpha() for c in r.text or "") else "und")] += 1
    assert sum((got & near).values()) >= 0.99 * len(rows) and sum(answers.values()) == len(rows)


def test_filters_hold_all_they_were_given(spark):
    """More languages than one word has bits, and more than a task counts at once."""
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(110 - i % 26 % 13)}q" * 9, f"l{i:02}") for i in range(70)] * 2
    made = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1), remainder=9)
    assert len(made.langs) == 70 and made.masks.shape[0] == 2
    names, scores = made.predict([t for _, t, _ in rows])
    assert sum(n == x for n, (_, _, x) in zip(names, rows)) >= 0.95 * len(rows) and min(scores) > 0.7


def test_slots_are_the_same_on_spark(spark):
    ids = np.arange(0, 1 << 20, 997)
    df = spark.createDataFrame([(int(i),) for i in ids], "id int")
    got = {r.id: r.s for r in df.select("id", langid._slots(df.id, 17).alias("s")).collect()}
    assert [tuple(got[int(i)]) for i in ids] == list(zip(*(a.tolist() for a in langid.slots(ids, 17))))


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(600)] + [(7, 1, None), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.score(docs, labels).collect()
    held = [r for r in rows if r.held_out and r.doc_id < 600]
    assert sum(r.predicted == (r.doc_id % 6 == 0) for r in held) > 0.95 * len(held)
    assert len(rows) == 605 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert toxicity.without_toxic(docs, labels).columns == docs.columns
    assert toxicity.score(docs.limit(0), labels).count() == 0
    assert toxicity.score(docs, labels.limit(0)).count() == 605


def test_toxicity_equals_brute_force(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(600)], "doc_id long, toxic int")
    rows, marks, sample = docs.collect(), {i: int(i % 6 == 0) for i in range(600)}, []
    grams = lambda t: {f" {(t or '').lower()} "[i : i + k] for k in (4, 5) for i in range(len(t or "") + 3 - k)}
    sample = [(grams(r.text), marks[r.doc_id]) for r in rows if r.doc_id in marks and zlib.crc32(str(r.doc_id).encode()) % 5]
    n1 = sum(m for _, m in sample)
    n0 = len(sample) - n1
    clean, bad = Counter(), Counter()
    for own, m in sample:
        (bad if m else clean).update(own)
    ratio = {g: math.log((bad[g] + 0.5) / (n1 + 1)) - math.log((clean[g] + 0.5) / (n0 + 1)) for g in clean.keys() | bad.keys() if bad[g] + clean[g] >= 3}
    ratio = {g: r for g, r in ratio.items() if abs(r) / math.sqrt(1 / (bad[g] + 0.5) + 1 / (clean[g] + 0.5)) >= 3}
    names = sorted(ratio)
    at = {g: i for i, g in enumerate(names)}
    pairs = np.array([(i, at[g]) for i, (own, _) in enumerate(sample) for g in own if g in at])
    weights, bias = toxicity.logistic(pairs[:, 0], pairs[:, 1], np.array([ratio[g] for g in names]), np.array([float(m) for _, m in sample]))
    want = sorted((r.doc_id, round(1 / (1 + math.exp(-bias - sum(weights[at[g]] for g in grams(r.text) if g in at))), 6)) for r in rows)
    got = sorted((r.doc_id, round(r.score, 6)) for r in toxicity.score(docs, labels).collect())
    assert len(names) > 10 and all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-5 for a, b in zip(got, want))


def test_labels_of_one_class_filter_nothing(spark, docs):
    for mark in (0, 1):
        labels = spark.createDataFrame([(i, mark) for i in range(600)], "doc_id long, toxic int")
        assert toxicity.without_toxic(docs, labels).count() == 605
    nulls = docs.selectExpr("cast(null as long) as doc_id", "text", "lang", "source", "score")
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(600)], "doc_id long, toxic int")
    assert toxicity.without_toxic(nulls.unionByName(docs), labels).where("doc_id is null").count() > 400


def test_recurrent_base_is_exact_and_the_model_is_better(spark, docs):
    rows = recurrent.score(docs, model_words=20, known_words=60).collect()
    texts = [(r.doc_id, (r.text or "").encode().lower().split() + [b""]) for r in docs.collect()]
    counts = Counter()
    for i, found in texts:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(found)
    total, kinds = sum(counts.values()), len(counts)
    want = sorted((i, len(f), sum(w in counts for w in f), round(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in f), 6)) for i, f in texts)
    assert sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows) == want
    assert all(r.train_tokens == total and r.score < 0 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert recurrent.score(docs.limit(0)).count() == 0


def brute_score(net, doc):
    """The same network, a word and a number at a time."""
    p, h = {k: v.astype(float) for k, v in net.p.items()}, net.hidden
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    state, last, total = [0.0] * h, 0, 0.0
    for word in doc:
        fed = [sum(p["embed"][last][i] * p["into"][i][j] for i in range(h)) + p["gates"][j] for j in range(3 * h)]
        rec = [sum(state[i] * p["across"][i][j] for i in range(h)) for j in range(3 * h)]
        z, r = [sigmoid(fed[j] + rec[j]) for j in range(h)], [sigmoid(fed[h + j] + rec[h + j]) for j in range(h)]
        new = [math.tanh(fed[2 * h + j] + r[j] * rec[2 * h + j]) for j in range(h)]
        state = [new[j] + z[j] * (state[j] - new[j]) for j in range(h)]
        c, w = divmod(int(word), net.width)
        outer = [sum(state[i] * p["class_w"][i][k] for i in range(h)) + p["class_b"][k] for k in range(net.classes)]
        inner = [sum(state[i] * p["word_w"][c][i][k] for i in range(h)) + p["word_b"][c][k] for k in range(net.width)]
        total += outer[c] - math.log(sum(map(math.exp, outer))) + inner[w] - math.log(sum(map(math.exp, inner)))
        last = word
    return total


def test_recurrent_score_equals_brute_force(spark, docs):
    """The whole score: the network's words by the network, others by their share, of known and of rare words."""
    some = docs.where("doc_id < 40 or doc_id > 599 and doc_id < 603")
    given = some.selectExpr("doc_id", "coalesce(text, '') as text", "crc32(cast(cast(doc_id as string) as binary)) % 7 = 2 as held_out")
    model, counts = recurrent.model_of(given.where("not held_out"), 20, 40, 2, 8)
    n = {r.word.encode(): r.n for r in counts.collect()}
    own = dict(list(model.known.items())[: model.size])
    others = model.total - n[b""] - sum(n[w] for w in own)
    kinds = len(n) - len(own) - 1
    got = {(r.doc_id, r.n_tokens): r.score for r in recurrent.score(some, model_words=20, known_words=40, rounds=2, hidden=8).collect()}
    for r in given.collect():
        found = r.text.encode().lower().split()
        want = brute_score(model.network, [own[w] + 2 if w in own else 1 for w in found] + [0]) / math.log(10)
        want += sum(math.log10((n.get(w, 0) + 1) / (others + kinds + 1)) for w in found if w not in own)
        assert abs(got[r.doc_id, len(found) + 1] - want) < 1e-3 * max(1, len(found) / 50), r.doc_id


def test_recurrent_gradients_equal_differences():
    """One window's gradients against small changes of every weight."""
    rng = np.random.default_rng(1)
    net = recurrent.Network([5, 9, 4, 3, 2, 2, 1], hidden=3)
    net.p = {k: rng.normal(0, 0.5, v.shape) for k, v in net.p.items()}
    tokens = rng.integers(0, 7, (6, 4))

    def loss():
        total, state = 0.0, np.zeros((4, 3))
        for last, goal in zip(tokens, tokens[1:]):
            state = net.step((net.p["embed"] @ net.p["into"] + net.p["gates"])[last], state)[0]
            total -= net.log_likelihood(state, goal).sum()
        return total / 20

    grads, _ = net.gradients(tokens[:-1], tokens[1:], np.zeros((4, 3)))
    assert grads.keys() == net.p.keys()
    for name, weights in net.p.items():
        for i in np.ndindex(weights.shape):
            was, found = weights[i], []
            for step in (1e-5, -1e-5):
                weights[i] = was + step
                found.append(loss())
            weights[i] = was
            assert abs((found[0] - found[1]) / 2e-5 - grads[name][i]) < 1e-6, (name, i)


def test_recurrent_probabilities_sum_to_one_and_windows_do_not_matter():
    net = recurrent.Network([5, 9, 4, 3, 2, 2, 1], hidden=4)
    net.train(np.array([0, 2, 3, 1, 4, 0, 2, 2, 1, 5, 6] * 60, np.int32), lanes=4, window=5)
    state = np.random.default_rng(0).normal(size=(1, 4)).astype(np.float32)
    total = sum(math.exp(net.log_likelihood(state, np.array([w]))[0]) for w in range(7))
    assert abs(total - 1) < 1e-5
    texts = [np.array([2, 3, 1, 4] * 30 + [0], np.int32), np.array([0], np.int32), np.array([5, 6, 0], np.int32)]
    assert np.allclose(net.score(texts, 7), net.score(texts, 640), atol=1e-4)
    assert np.allclose(net.score(texts, 7), [net.score([t], 16)[0] for t in texts], atol=1e-4)


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    points = np.concatenate([base + rng.normal(size=base.shape) * s for s in (0, 0.02, 0.05, 0.1)] + [base[:5]]).astype(np.float32)
    rows = [(i, [float(x) for x in p], 1) for i, p in enumerate(points)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, [None] + [1.0] * 15, 1), (n + 4, [1.0, 2.0], 1)]
    got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep int")).collect()}
    p = points.astype(np.float64)
    unit = p / np.linalg.norm(p, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    label = np.arange(n)
    for _ in range(n):
        label = np.array([label[near[i]].min() for i in range(n)])
    found = sum(got[i].n_links for i in range(n))
    assert found >= 0.98 * (near.sum() - n)
    assert sum(got[i].component_id == label[i] for i in range(n)) >= 0.98 * n
    assert all(got[i].n_links == 0 and got[i].kept and got[i].component_id == i for i in range(n, n + 5)) and len(got) == n + 5


def brute_links(points, least=0.95):
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    return unit @ unit.T >= least


@pytest.mark.parametrize("fan", [1024, 8])
def test_probes_find_links_over_many_lists(spark, fan):
    """Thousands of vectors in hundreds of lists, of one level and of three, against all pairs."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(900, 32))
    points = np.concatenate([base, *(base + rng.normal(size=base.shape) * s for s in (0.1, 0.15, 0.2, 0.24))])
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), per_list=16, fan=fan).collect()}
    near = brute_links(points)
    found, want = sum(r.n_links for r in got.values()), near.sum() - len(points)
    assert want > 5000 and 0.98 * want <= found <= want


def test_vectors_of_rare_lengths_great_size_and_shared_ids(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [1e300, 2e300, 3e300]), (4, [2e300, 4e300, 6.1e300]), (5, [1e-310, 2e-310, 3e-310]), (6, []), (None, [5.0, 0.0]), (None, [5.0, 0.0]), (7, [5.0, 0.1])]
    rows += [(8, [1.0, 0.0, 0.0, 0.0]), (8, [1.0, 0.1, 0.0, 0.0]), (9, [0.0, 0.0, 1.0, 0.0]), (9, [0.0, 1.0, 0.0, 0.0])]
    got = sorted(vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), key=lambda r: (r.vec_id is None, r.vec_id or 0))
    assert [(r.vec_id, r.n_links, r.component_id, r.kept) for r in got] == [
        (0, 2, 0, True), (1, 2, 0, False), (2, 2, 0, False), (3, 2, 3, True), (4, 2, 3, False), (5, 2, 3, False), (6, 0, 6, True), (7, 2, 7, True),
        (8, 1, 8, True), (8, 1, 8, True), (9, 0, 9, True), (9, 0, 9, True), (None, 2, 7, False), (None, 2, 7, False),
    ]
    nothing = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.near_duplicates(nothing).count() == 0


def test_recurrent_trains_on_every_document(spark):
    rows = [(i if i % 3 else None, "a b " * (i % 4) + "c") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    net = recurrent.Network([3000, 3000, 3000])
    before = net.p["embed"].copy()
    seen = recurrent.fit(net, df, lambda text: np.array([2 if w == b"c" else 1 for w in recurrent.words(text)] + [0], np.int32))
    assert seen == sum(len(t.split()) + 1 for _, t in rows)
    assert not np.array_equal(before, net.p["embed"])

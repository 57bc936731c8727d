import random

from xxhash import xxh64_intdigest

from candor.llm import simhash


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    return {p: find(p) for p in prints}


def test_groups_equal_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    texts = [None, "", "  \n", "One", "one", "ONE two", "a b c", "A\tb\x0bc", "é É x"]
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(3, 300))]
        texts.append(" ".join(base))
        for _ in range(3):
            near = list(base)
            near[rng.randrange(len(near))] = rng.choice(words)
            texts.append(" ".join(near))
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(4, "one", "again", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    got = simhash.digest(docs).collect()
    prints = [brute_print(r[1]) for r in rows]
    root = brute_groups(set(prints))
    least = {}
    for r, p in zip(rows, prints):
        least[root[p]] = min(least.get(root[p], 10**9), r[0])
    want = sorted((r[0], f"{p:016x}", least[root[p]]) for r, p in zip(rows, prints))
    assert sorted(tuple(r) for r in got) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))
    assert simhash.digest(docs.limit(0)).count() == 0


def test_every_distance_up_to_three_links_and_no_more(spark):
    rng = random.Random(9)
    prints = set()
    for distance in (1, 2, 3, 4, 5):
        for _ in range(60):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), distance):
                b ^= 1 << bit
            prints |= {a, b}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    from candor.llm.components import components

    got = {r.node % 2**64: r.root for r in components(simhash.linked(df)).collect()}
    want = brute_groups(prints)
    for a in prints:
        for b in prints:
            assert (a == b or (a in got and b in got and got[a] == got[b])) == (want[a] == want[b])


def test_null_and_repeated_ids_of_different_groups_stay_apart(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(80)) for _ in range(8)]
    rows = [(None, t, i) for i, t in enumerate(texts[:6])] + [(7, texts[6], 6), (7, texts[7], 7), (None, texts[7], 8), (None, texts[0], 9)]
    kept = [r["at"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, at int")).collect()]
    assert len(kept) == 8 and {1, 2, 3, 4, 5, 6, 7} < set(kept) and len({0, 9} & set(kept)) == 1

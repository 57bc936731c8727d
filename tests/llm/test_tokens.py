import base64
import hashlib
import random
import zlib

import public_tokenizers as P
import pytest

from candor.llm import bpe, packing

SHAPE = "doc_id long, text string, start string, ids int"
NASTY = [None, "", " ", "  ", "   x", "a", "a  b", "a \n b", "x\n\n y ", "\t a  b", "naïve café — 日本語 🙂🙂", "aaaaaaaaaaaaaaaaaaaaaaaaa", "don't I'LL they've 123 456,789", "a" * 5000, " " * 300, "x <|endoftext|> y", "a  <|endoftext|>  b<|endoftext|><|endoftext|>c <|endof", "<|endoftext|>", " <|endoftext|> \n x", "\x1c a \x1f b", "foo \x85bar", "…… !!! ---- ==== \r\n \r\n z"]


def texts():
    rng = random.Random(5)
    pool = ["the", "re", "ing", " ", "  ", "\n", "\t", "é", "ß", "日", "🙂", "1", "22", "'s", "'", "!", "aa", " ", "　", "=", "__"]
    return NASTY + ["".join(rng.choice(pool) for _ in range(rng.randint(1, 60))) for _ in range(1500)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 7) for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[3]], SHAPE)


def test_round_trip_equals_tiktoken(spark, docs):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.round_trip(docs, path).collect()}
    for i, t in enumerate(texts()):
        ids = plain.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids), t
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip(docs.limit(0), path).count() == 0


def test_offsets_and_split_characters(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    df = spark.createDataFrame([(1, "naïve 日本語 🙂 x"), (2, "")], "doc_id long, text string")
    rows = {r.doc_id: r for r in bpe.encode(df, path, with_offsets=True).collect()}
    _, table = bpe.codec(path)
    text = "naïve 日本語 🙂 x"
    assert bpe.decode(rows[1].ids, table) == text
    for i, s, e in zip(rows[1].ids, rows[1].starts, rows[1].ends):
        piece = table[i].decode("utf-8", "ignore")
        assert piece in text[s:e]
    assert rows[1].ends[-1] == len(text) and rows[2].ids == []


def test_ids_of_any_tokenizers_file(tmp_path):
    """The file's own settings hold, whether tiktoken can read it or not."""
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    plain, fast = Tokenizer.from_file(path), packing.Encoder(path)
    some = [t or "" for t in texts()] + [" " * 200_000, "ab" * 100_000, "<|endoftext|>" * 3 + " x"]
    assert fast.fast is not None
    assert [list(memoryview(x).cast("I")) for x in fast.batch(some)] == [plain.encode(t, add_special_tokens=False).ids for t in some]
    plain.add_tokens(["zz"])
    plain.add_special_tokens([__import__("tokenizers").AddedToken("<s>", lstrip=True)])
    plain.save(str(tmp_path / "own.json"))
    other = packing.Encoder(str(tmp_path / "own.json"))
    some = ["a <s> b", "pizza <|endoftext|>", ""]
    assert other.fast is None
    assert [list(memoryview(x).cast("I")) for x in other.batch(some)] == [plain.encode(t, add_special_tokens=False).ids for t in some]
    word = packing.Encoder(P.path("word_bpe_49k.json"))
    assert list(memoryview(word.batch(["Some Words here"])[0]).cast("I")) == Tokenizer.from_file(P.path("word_bpe_49k.json")).encode("Some Words here", add_special_tokens=False).ids


def test_packing_is_exact_and_tight(spark, docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = packing.pack(docs.repartition(7), P.path("byte_bpe_50k.json"), size=64, open_windows=8).collect()
    want = {i: plain.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts())}
    by_doc, by_window = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_window.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(want)
    for i, ids in want.items():
        copies = 2 if i == 3 else 1
        assert sum(r.length for r in by_doc[i]) == copies * len(ids)
        for r in by_doc[i]:
            part = ids[r.start : r.start + r.length]
            assert len(part) == r.length and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
    for own in by_window.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    used = sum(r.length for r in rows)
    assert used / (64 * len(by_window)) > 0.93
    assert packing.pack(docs.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_open_windows_merge_whatever_share_of_all_they_are(spark):
    rows = [(i, "a b" if i < 4 else " a" * n) for i, n in enumerate([0] * 4 + [1600] * 4)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 8), "doc_id long, text string")
    path = P.path("byte_bpe_50k.json")
    for some in (docs, docs.where("doc_id < 4")):
        got = packing.pack(some, path, size=16, open_windows=2, fan_in=2).collect()
        used = sum(r.length for r in got)
        assert len({r.sequence_id for r in got}) == -(-used // 16)  # 2 and 100 % of the windows stay open at first

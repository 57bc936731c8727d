"""Near duplicates by SimHash: fingerprints, links at few differing bits by ball hashing, and groups of linked documents.

Meet in the middle: two fingerprints that differ in at most three bits reach a common variant when one flips at
most one bit and the other at most two, and of three differing bits two lie in the same half of the word. So every
fingerprint emits all variants within one bit; those of odd parity also emit their variants with two bits flipped
in one half (three differing bits mean that one parity is odd and one is even). Fingerprints shuffle on variants.
All that meet on a variant from one bit away are within two bits of each other, and all that meet it from two bits
away are within three bits of those: one edge to the smallest of them keeps the links of the group, and no pairs
within a group are made. A group holds at most the ball around its variant, however many documents there are.

Screening first: fingerprints that differ in at most three bits agree in one half up to one bit, so only those
that meet another on a half (with or without one flipped bit) emit variants of the whole word.

`groups` links by one fingerprint, as the query op3_simhash does. A Jaccard of 0.8 is out of its reach: two such texts
differ in about ten of 64 bits. `near_copies` therefore takes these links, over the set of five-word shingles, as a first
step that joins large groups by few pairs, and then finds every other pair by prefixes: two sets with a Jaccard of
`least` share a shingle among the first (1 - least) of each, in any order that is the same for all. Rare shingles come
first; which are frequent is counted on a sixth of the texts, which bears on the speed only. A link is a pair whose exact Jaccard is
`least` or more, and none is left out.

Null and empty texts have fingerprint zero and link like any other. Rows with equal ids are kept apart; a null id
is never the smallest of its group, unless all are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candor.llm.bpe import slices
from candor.llm.common import least_rows, met, numbered, saved, share, text_or_empty, written
from candor.llm.components import components


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many rows of an array of 64-bit words have each bit, all words of a row in turn."""
    total = np.zeros(64 * hashes.shape[1], np.int64)
    for a in range(0, len(hashes), 255):  # so many that a byte holds the count
        rows = np.ascontiguousarray(hashes[a : a + 255])
        total += np.add.reduce(np.unpackbits(rows.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return total


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """Bits set in over half of the hashes of the text's shingles, as a signed 64-bit integer."""
    from xxhash import xxh64_intdigest

    found = text.encode().lower().split()
    if not found:
        return 0
    total = np.zeros(64, np.int64)
    n = max(1, len(found) - words + 1)
    for at in range(0, n, 65536):
        block = found[at : at + 65536 + words - 1]
        shingles = map(b" ".join, zip(*(block[i:] for i in range(words)), strict=False)) if len(found) >= words else [b" ".join(found)]
        hashes = np.fromiter((xxh64_intdigest(s, seed) for s in shingles), np.uint64)
        total += bit_counts(hashes[:, None])
    bits = np.packbits(2 * total > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp (long) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, "doc_id long, fp long")


def _long(value: int) -> Column:
    return F.lit(value - (1 << 64) if value >= 1 << 63 else value)


def _masks(masks: list[int]) -> Column:
    return F.array(*(_long(m) for m in masks))


ONE = [0, *(1 << i for i in range(64))]
TWO = [1 << i | 1 << j for half in (range(32), range(32, 64)) for i in half for j in half if i < j]


def _dealt(fps: DataFrame) -> DataFrame:
    """Fingerprints over all shuffle partitions: few bytes, but each becomes many rows, so they must not meet in a few tasks.

    Dealt by a hash of fp, since Spark leaves out a deal by the column that they are already grouped by.
    """
    return fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))


def _screened(fps: DataFrame) -> DataFrame:
    """The fingerprints that agree with another in one half up to one bit."""
    fps = _dealt(fps)
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    flips = _masks([0, *(1 << i for i in range(32))])
    emitted = fps.select(
        "fp",
        F.explode(F.concat(F.transform(flips, lambda m: low.bitwiseXOR(m)), F.transform(flips, lambda m: high.bitwiseXOR(m).bitwiseOR(F.lit(1 << 32))))).alias("key"),
    )
    exact = F.when(F.shiftrightunsigned("key", 32) == 0, low == F.col("key")).otherwise(high.bitwiseOR(F.lit(1 << 32)) == F.col("key"))
    emitted = emitted.withColumn("own", exact.cast("int"))
    shared = emitted.groupBy("key").agg(F.sum("own").alias("owners"), F.count("*").alias("n")).where("owners >= 1 and n >= 2").select("key")
    # Spark takes an explode for no larger than its input, and so would broadcast what isn't small
    return emitted.join(shared.hint("merge"), "key", "left_semi").select("fp").distinct()


def linked(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) to edges (a, b) that keep every link within three bits."""
    some = _dealt(saved(_screened(fps)))
    odd = F.bit_count("fp") % 2 == 1
    near = some.select("fp", F.lit(True).alias("near"), F.explode(F.transform(_masks(ONE), lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    far = some.where(odd).select("fp", F.lit(False).alias("near"), F.explode(F.transform(_masks(TWO), lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    met = near.unionByName(far)
    hubs = met.groupBy("variant").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("hub"), F.count("*").alias("n")).where("n > 1 and hub is not null")
    return met.join(hubs.select("variant", "hub").hint("merge"), "variant").where("fp != hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()


def groups(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp, component_id: the smallest id among all documents reachable over links."""
    found = saved(fingerprints(docs, words))
    distinct = saved(found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    total = distinct.agg(F.sum("n")).first()[0] or 0
    tree = components(linked(distinct.select("fp")))
    of = distinct.join(tree.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    roots = of.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = saved(of.join(roots, "root").select(F.col("fp").alias("label_fp"), "component_id", "n"))
    return met(found, labels, "fp", "label_fp", "n", total).select("doc_id", "fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without near duplicates: of each group the row whose id is the smallest stays, once.

    Rows are told apart by a number, so null and repeated ids of different groups are kept apart.
    """
    given = numbered(docs)
    found = groups(given.select(F.col("kept_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    ids = given.select(F.col("kept_row").alias("of"), "doc_id")
    kept = least_rows(found.join(ids.hint("merge"), F.col("row") == F.col("of")), "component_id").select(F.col("row").alias("least_row"))
    return given.join(kept.hint("merge"), F.col("kept_row") == F.col("least_row"), "left_semi").drop("kept_row")


# Near copies: fingerprints, prefixes and exact Jaccard.

_P = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > 200_000:
            self.clear()
        found = self[word] = xxh64_intdigest(word, 42)
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingles(found: list[bytes], words: int, hashes: dict) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    if not found:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    wide = min(words, len(each))
    total = np.full(len(each) - wide + 1, wide, np.uint64)
    for i in range(wide):
        total = _mixed(total * _P + each[i : len(each) - wide + 1 + i])
    return np.unique(total)


BEFORE = 4
SKETCH, WIDE = 9, 14  # 512 bits; sets of over a thousand hashes, which fill them, have another sketch of 16,384 bits


def print_of(found: np.ndarray) -> int:
    """The fingerprint of 64 bits of a set of hashes, as a signed integer."""
    total = np.zeros(64, np.int64)
    with np.errstate(over="ignore"):
        for a in range(0, len(found), 8192):
            total += bit_counts(_mixed(found[a : a + 8192, None] * _P))
    return int(np.packbits(2 * total > len(found), bitorder="little").view("<i8")[0])


def sketch(found: np.ndarray, bits: int = SKETCH) -> np.ndarray:
    """Parities of how many hashes fall to each bit: two sets differ in at least as many hashes as their sketches in bits."""
    odd = np.bincount((found >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def prefix(found: np.ndarray, least: float, often: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """So many of a set's hashes, rare ones first, that sets with a Jaccard of `least` have one in common."""
    ids, counts = often
    seen = np.zeros(len(found), np.int64)
    if len(ids):
        at = np.minimum(np.searchsorted(ids, found), len(ids) - 1)
        seen = np.where(ids[at] == found, counts[at], 0)
    return found[np.lexsort((found, seen))[: len(found) - int(np.ceil(least * len(found) - 1e-9)) + 1]]


def _own(text: str, words: int, hashes: dict) -> np.ndarray:
    return shingles(text.encode("utf-8", "replace").lower().split(), words, hashes)


def frequent(docs: DataFrame, words: int, sample_rows: int = 8_000, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that occur in three or more texts of a sample, ascending, and in how many; `most` of them at most.

    The sample is a sixth of the texts, and not fewer than `sample_rows`: with a fixed one, a shingle could be in more and
    more texts of a growing table unseen, and all these texts would meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(_own(t, words, hashes).view(np.int64))], ["id"])

    total = docs.count()
    some = docs.where(share(total, max(sample_rows, total // 6))).select(text_or_empty().alias("text")).mapInArrow(run, "id long")
    best = some.groupBy("id").agg(F.count("*").alias("n")).where("n >= 3").orderBy(F.desc("n"), "id").limit(most).toArrow()
    ids, counts = best.column("id").to_numpy().view(np.uint64), best.column("n").to_numpy()
    order = np.argsort(ids)
    return ids[order], counts[order]


def _signed(docs: DataFrame, words: int, least: float, often: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, same (the md5 of the text), the size of its set of shingles, fingerprint, sketch and prefix of each document."""
    known = docs.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in slices(texts, 2_000_000):
                sets = [_own(t, words, hashes) for t in texts[a:b]]
                found = [pa.array([len(x) for x in sets]), pa.array([print_of(x) for x in sets])]
                found += [pa.array(c, pa.list_(pa.int64())) for c in ([sketch(x) for x in sets], [sketch(x, WIDE) if len(x) > 1000 else None for x in sets], [prefix(x, least, known.value).view(np.int64) if len(x) else () for x in sets])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *found], ["doc_id", "same", "size", "fp", "sketch", "wide", "prefix"])

    return docs.select("doc_id", _same(), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, same binary, size long, fp long, sketch array<long>, wide array<long>, prefix array<long>")


def _same() -> Column:
    return F.unhex(F.md5(text_or_empty().cast("binary"))).alias("same")


def _alike(words: int, least: float):
    """Of rows (a, b, x, y) those whose texts x and y have a Jaccard of `least` or more, as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):  # not all texts of a batch as strings at a time
                left, right = _own(x.as_py(), words, hashes), _own(y.as_py(), words, hashes)
                common = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(common >= least * (len(left) + len(right) - common) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


SIEVE = 1 << 26


def sieved(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """`rows` (own_id, own_same and more) with `maybe`: false only if `wanted` (own_id, own_same) has no such pair.

    A bitmap of `SIEVE` bits, 8 MB however large the tables are, goes to every task. A full one only lets more through.
    """
    at = F.pmod(F.xxhash64("own_id", "own_same"), F.lit(SIEVE)) + 1
    bits = wanted.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("of_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    placed = rows.withColumn("at", at).withColumn("bucket", F.bitmap_bucket_number("at")).withColumn("bit", F.bitmap_bit_position("at"))
    met = placed.join(F.broadcast(bits), F.col("bucket") == F.col("of_bucket"), "left")
    byte = F.conv(F.hex(F.expr("substring(bits, cast(bit div 8 + 1 as int), 1)")), 16, 10).cast("int")
    found = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(bit % 8 as int))")) != 0, F.lit(False))
    return met.withColumn("maybe", found).drop("at", "bucket", "bit", "of_bucket", "bits")


def _keyed(docs: DataFrame, columns: list) -> DataFrame:
    """Columns of `docs`, and own_id and own_same, which are never null, so that one dealing by them serves several steps."""
    return docs.select(*columns, _id_text("doc_id").alias("own_id"), F.coalesce(_same(), F.lit(b"")).alias("own_same"))


def _id_text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("null"))


def _may_link(least: float) -> Column:
    """Whether sets of size_a and size_b with sketch_a and sketch_b can have a Jaccard of `least`; false only if they can't."""
    differ = sum((F.bit_count(F.col("sketch_a")[i].bitwiseXOR(F.col("sketch_b")[i])) for i in range((1 << SKETCH) // 64)), F.lit(0))
    both = F.col("size_a") + F.col("size_b")
    return (F.least("size_a", "size_b") >= least * F.greatest("size_a", "size_b") - 1e-9) & (differ <= both * ((1 - least) / (1 + least)) + 1e-9)


def _side(rows: DataFrame, end: str) -> DataFrame:
    return rows.select(F.col("row").alias(end), F.col("size").alias(f"size_{end}"), F.col("sketch").alias(f"sketch_{end}"))


def alike_prints(placed: DataFrame) -> DataFrame:
    """Pairs (a, b) that tie rows of equal fingerprints, and of fingerprints linked at three bits or less."""
    heads = saved(placed.groupBy("fp").agg(F.min("row").alias("head")))
    equal = placed.select("row", "fp").join(heads.hint("merge"), "fp").where("row != head").select(F.col("row").alias("a"), F.col("head").alias("b"))
    of = lambda end: heads.select(F.col("fp").alias(f"fp_{end}"), F.col("head").alias(f"head_{end}"))
    near = linked(heads.select("fp")).join(of("a").hint("merge"), F.col("a") == F.col("fp_a")).join(of("b").hint("merge"), F.col("b") == F.col("fp_b"))
    return equal.unionByName(near.select(F.col("head_a").alias("a"), F.col("head_b").alias("b")))


def shared_keys(classes: DataFrame) -> DataFrame:
    """row and key for the shingles that several prefixes hold; n of them, the first and last row of which are low and high."""
    same = Window.partitionBy("key")
    keys = classes.select("row", F.explode("prefix").alias("key"))
    return saved(keys.select("row", "key", F.min("row").over(same).alias("low"), F.max("row").over(same).alias("high"), F.count("*").over(same).alias("n")).where("n > 1"))


def _enough_shared(least: float) -> Column:
    """Whether prefixes with `keys_a` and `keys_b` keys left hold as many shared ones as a Jaccard of `least` needs; false only if not.

    Such sets have `common` hashes or more in common. A prefix, in the order of all sets, lacks at most (size - common) of
    them, and those of the prefix that ends first lie in the other one too.
    """
    common = F.ceil((F.col("size_a") + F.col("size_b")) * (least / (1 + least)) - 1e-6)
    needed = lambda end: common - F.ceil(F.col(f"size_{end}") * least - 1e-9) + 1  # noqa: E731  the length of its prefix, size - ceil(least * size) + 1, less (size - common)
    return F.least("keys_a", "keys_b") >= F.least(needed("a"), needed("b"))


def apart(shared: DataFrame, placed: DataFrame, tree: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of different groups that share a key and may link. Pairs that share a key of up to three rows have been compared.

    So a link between groups shows in keys of more rows and of several groups only, and there in as many as its sizes
    ask for. The rows of a key meet in blocks of about `block`, so that no task gets all pairs of a frequent one. What can
    be told from sizes, numbers of keys and sketches is told within the join. Keys have one order, frequent ones last; a pair
    that shares one of the `BEFORE` keys just before this one comes there, so that it is not made anew at each of its keys.
    """
    block, same = 500, Window.partitionBy("key")
    rooted = shared.where("n > 3").join(tree.hint("merge"), F.col("row") == F.col("node"), "left").select("key", "row", "n", F.coalesce("root", "row").alias("root"))
    several = rooted.withColumns({"first": F.min("root").over(same), "last": F.max("root").over(same)}).where("first != last").select("key", "row", "root", "n", F.ceil(F.col("n") / block).alias("blocks"))
    own = Window.partitionBy("row")
    before = F.array_compact(F.array(*(F.lag("key", i).over(own.orderBy("n", "key")) for i in range(1, BEFORE + 1))))
    kept = several.select("key", "row", "root", "blocks", F.count("*").over(own).alias("keys"), before.alias("before"))
    rows = saved(kept.join(placed.select("row", "size", "sketch").hint("merge"), "row"))
    side = lambda end, at: rows.select("key", at.alias("block"), F.col("row").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in ("root", "size", "keys", "before", "sketch")))
    left, right = side("a", F.pmod(F.xxhash64("row"), "blocks")), side("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    may = (F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & _enough_shared(least) & _may_link(least) & ~F.arrays_overlap("before_a", "before_b")
    return left.join(right.hint("merge"), ["key", "block"]).where(may).select("a", "b").distinct()


def _wide_enough(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Without the pairs of two large sets whose wide sketches differ in too many bits."""
    large = classes.where("wide is not null")
    of = lambda end: large.select(F.col("row").alias(end), F.col("size").alias(f"size_{end}"), F.col("wide").alias(f"wide_{end}"))
    differ = F.aggregate(F.zip_with("wide_a", "wide_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
    both = pairs.join(of("a").hint("merge"), "a", "left").join(of("b").hint("merge"), "b", "left")
    return both.where(F.coalesce(differ <= (F.col("size_a") + F.col("size_b")) * ((1 - least) / (1 + least)) + 1e-9, F.lit(True))).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs whose sets of shingles have a Jaccard of `least` or more."""
    pairs = saved(_wide_enough(pairs, classes, least))
    asked = pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct()
    asked = saved(asked.join(classes.select("row", "doc_id", "same").hint("merge"), "row").select("row", _id_text("doc_id").alias("own_id"), F.col("same").alias("own_same")))
    some = sieved(_keyed(docs, [text_or_empty().alias("text")]), asked).where("maybe").select("own_id", "own_same", "text")
    texts = written(some.join(asked.hint("merge"), ["own_id", "own_same"]).select("row", "text").dropDuplicates(["row"]))
    left, right = texts.select(F.col("row").alias("a"), F.col("text").alias("x")), texts.select(F.col("row").alias("b"), F.col("text").alias("y"))
    both = pairs.select("a", "b").join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    return both.select("a", "b", "x", "y").mapInArrow(_alike(words, least), "a long, b long")


def linked_rows(docs: DataFrame, classes: DataFrame, words: int, least: float) -> DataFrame:
    """(node, root) of the groups that all pairs with a Jaccard of `least` or more make.

    Rows are first compared with those of like fingerprints and with the first and the last row of each key, then with all
    rows of other groups that share a key.
    """
    placed = classes.where("size > 0").select("row", "fp", "size", "sketch")
    shared = shared_keys(classes)
    hubs = shared.where("row != low").select(F.col("row").alias("a"), F.col("low").alias("b")).unionByName(shared.where("row != high").select(F.col("high").alias("a"), F.col("row").alias("b")))
    pairs = alike_prints(placed).unionByName(hubs).distinct().join(_side(placed, "a").hint("merge"), "a").join(_side(placed, "b").hint("merge"), "b")
    edges = saved(verified(saved(pairs.where(_may_link(least)).select("a", "b")), docs, classes, words, least))
    tree = components(edges)
    more = saved(verified(saved(apart(shared, placed, tree, least)), docs, classes, words, least))
    return components(tree.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def near_copies(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """Classes of equal texts: row (a number), doc_id (the smallest), same (the md5 of the text), root of the group.

    Texts of fewer than `words` words are one shingle; null and empty texts are one class, and have no fingerprint.
    """
    signed = written(_signed(docs, words, least, frequent(docs, words)))
    first = F.min_by(F.struct(*signed.drop("same").columns), F.struct(F.col("doc_id").isNull(), "doc_id")).alias("first")
    classes = written(signed.groupBy("same").agg(first).select("same", "first.*", F.monotonically_increasing_id().alias("row")))
    blank = classes.where("size = 0").agg(F.min("row").alias("blank"))
    tree = linked_rows(docs, classes, words, least)
    rooted = classes.join(tree.hint("merge"), F.col("row") == F.col("node"), "left").join(F.broadcast(blank))
    return rooted.select("row", "doc_id", "same", F.when(F.col("size") == 0, F.col("blank")).otherwise(F.coalesce("root", "row")).alias("root"))


def without_near_copies(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """Of each group of near copies (Jaccard of `words`-word shingles) the row with the smallest id; a null id only if all are null.

    Rows with null or repeated ids are told apart by their texts, so they never merge rows of different groups; of rows
    with one id and one text, one stays.
    """
    found = written(near_copies(docs, words, least))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    kept = found.groupBy("root").agg(F.min_by(F.struct("doc_id", "same"), order).alias("best")).select(_id_text("best.doc_id").alias("own_id"), F.col("best.same").alias("own_same"))
    return kept_once(docs, kept)


def kept_once(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The documents named by `kept` (own_id, own_same), one row of each.

    Only rows that may have to go are dealt over the tasks: those of pairs that are not kept, or that occur again.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    kept = saved(kept)
    counted = _keyed(docs, []).groupBy("own_id", "own_same").agg(F.count("*").alias("n"))
    doubtful = counted.join(kept.withColumn("stays", F.lit(True)).hint("merge"), ["own_id", "own_same"], "left").where("n > 1 or stays is null").select("own_id", "own_same")
    rows = sieved(_keyed(docs, [F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)]), doubtful)
    one = rows.where("maybe").groupBy("own_id", "own_same").agg(F.first(F.struct(*names)).alias("row"))
    some = one.join(kept.hint("merge"), ["own_id", "own_same"], "left_semi").select("row.*")
    return rows.where("not maybe").select(*names).unionByName(some).select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)))

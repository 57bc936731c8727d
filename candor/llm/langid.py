"""Language identification by bit-sliced Bloom filters: each slot holds a bit per language.

Training counts hashed byte 4-grams per language over all training documents (lower case, ASCII other than letters as
blanks). A language holds an n-gram if it is there at least `near` times as frequent, by share of the language's
n-grams, as in the language where it is most frequent; so rare and common n-grams count alike, and a large training
set works as a small one does. The filter has about four slots for each n-gram of the language that holds the most; the
slots' masks are put together on Spark. One lookup of an n-gram, the AND of its slots, tells every language that holds
it. A document's hits are counted per language and corrected for the filter's false positives; the most hits decide,
the alphabet breaks ties. The score is the share of its n-grams that the language holds.

Null texts and texts without a letter (of a Unicode category L) are 'und' with score 0, and so is everything if there
is nothing to learn from. A text whose n-grams no filter holds gets the language with the most training text, with
score 0. Only text and, for training, lang are read; languages past the 64th take further words of the masks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor.llm.bpe import slices
from candor.llm.common import id_bucket, saved, text_or_empty
from candor.llm.grams import hashed, letters_only

ORDER, BITS, HASHES = 4, 20, 3
LANGUAGES_AT_ONCE = 24
_LETTER = regex.compile(r"\p{L}")
_MULTIPLY = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, id, n); a task holds the counts of a few languages at a time."""
    seen: dict[str, np.ndarray] = {}

    def flushed() -> Iterator[pa.RecordBatch]:
        for lang, counts in seen.items():
            found = np.flatnonzero(counts)
            for a in range(0, len(found), 100_000):
                part = found[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part.astype(np.int32)), pa.array(counts[part].astype(np.int64))], ["lang", "id", "n"])
        seen.clear()

    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, b in slices(texts, 700_000):
            for lang in sorted(set(langs[a:b])):
                ids, _ = hashed([letters_only(t) for t, x in zip(texts[a:b], langs[a:b], strict=True) if x == lang], ORDER, BITS)
                if lang not in seen:
                    if len(seen) >= LANGUAGES_AT_ONCE:
                        yield from flushed()
                    seen[lang] = np.zeros(1 << BITS, np.uint32)
                seen[lang] += np.bincount(ids, minlength=1 << BITS).astype(np.uint32)
    yield from flushed()


def slots(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    """The filter's slots of n-gram ids, one array for each hash."""
    wide = (ids.astype(np.int64) + 1)[None] * np.array(_MULTIPLY, np.int64)[:, None]
    return list(((wide ^ (wide >> 15)) & 0xFFFFFFFF) * 0x2C1B3C6D >> 7 & ((1 << bits) - 1))


def _slots(ids: Column, bits: int) -> Column:
    """The same on Spark."""

    def one(by: int) -> Column:
        wide = (ids.cast("long") + 1) * F.lit(by)
        mixed = wide.bitwiseXOR(F.shiftright(wide, 15)).bitwiseAND(F.lit(0xFFFFFFFF)) * F.lit(0x2C1B3C6D)
        return F.shiftright(mixed, 7).bitwiseAND(F.lit((1 << bits) - 1))

    return F.array(*map(one, _MULTIPLY))


class Filters:
    """Bit-sliced Bloom filters of the languages' n-grams: `masks` has a row of slots for each 64 languages."""

    def __init__(self, langs: list[str], usual: str, masks: np.ndarray):
        self.langs, self.usual, self.masks = langs, usual, masks
        self.bits = int(masks.shape[1]).bit_length() - 1
        self.false = np.array([float((masks[i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean()) ** HASHES for i in range(len(langs))])

    def hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected hits, a row for each text and a column for each language, and the texts' numbers of n-grams."""
        ids, counts = hashed([letters_only(t) for t in texts], ORDER, BITS)
        docs = np.repeat(np.arange(len(texts)), counts)
        found = np.zeros((len(texts), len(self.langs)))
        where = slots(ids, self.bits)
        for w, masks in enumerate(self.masks):
            held = masks[where[0]]
            for at in where[1:]:
                held &= masks[at]
            for i in range(64 * w, min(64 * w + 64, len(self.langs))):
                found[:, i] = np.bincount(docs[(held >> np.uint64(i % 64) & np.uint64(1)).astype(bool)], minlength=len(texts))
        return (found - counts[:, None] * self.false) / (1 - np.minimum(self.false, 0.999)), counts

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        found, counts = self.hits(texts)
        best = found.argmax(axis=1)
        most = found[np.arange(len(texts)), best]
        lettered = [bool(_LETTER.search(t)) for t in texts]
        names = [("und" if not ok else self.langs[b] if m > 0 else self.usual) for ok, b, m in zip(lettered, best, most, strict=True)]
        scores = [float(min(1.0, max(0.0, m / max(n, 1)))) if ok else 0.0 for ok, m, n in zip(lettered, most, counts, strict=True)]
        return names, scores


def fit(docs: DataFrame, held_out: int = 4, remainder: int = 2, near: float = 0.25) -> Filters:
    """Filters from all documents with a language outside the held-out share."""
    train = docs.where(F.col("lang").isNotNull() & (id_bucket(held_out) != remainder)).select("lang", text_or_empty().alias("text"))
    counted = saved(train.mapInArrow(_count, "lang string, id int, n long").groupBy("lang", "id").agg(F.sum("n").alias("n")))
    totals = {r.lang: r.total for r in counted.groupBy("lang").agg(F.sum("n").alias("total")).collect()}
    langs = sorted(totals)
    if not langs:
        return Filters([], "und", np.zeros((1, 1), np.uint64))
    known = docs.sparkSession.createDataFrame([(x, i, float(totals[x])) for i, x in enumerate(langs)], "lang string, place int, total double")
    shares = counted.join(F.broadcast(known), "lang").select("id", "place", (F.col("n") / F.col("total")).alias("share"))
    by_id = shares.groupBy("id").agg(F.max("share").alias("top"), F.collect_list(F.struct("place", "share")).alias("own"))
    held = by_id.select("id", F.transform(F.filter("own", lambda x: x["share"] >= F.col("top") * near), lambda x: x["place"]).alias("places"))
    held = saved(held.select("id", F.explode("places").alias("place")))
    most = held.groupBy("place").count().agg(F.max("count")).first()[0] or 1
    bits = max(10, int(4 * most - 1).bit_length())
    word, bit = F.expr("cast(place div 64 as int)"), F.expr("shiftleft(1L, cast(place % 64 as int))")
    masks = np.zeros(((len(langs) + 63) // 64, 1 << bits), np.uint64)
    flat = held.select(word.alias("word"), bit.alias("bit"), F.explode(_slots(F.col("id"), bits)).alias("slot"))
    got = flat.groupBy("word", "slot").agg(F.bit_or("bit").alias("mask")).toArrow()
    masks[got.column("word").to_numpy(), got.column("slot").to_numpy()] = got.column("mask").to_numpy().view(np.uint64)
    return Filters(langs, max(langs, key=lambda x: (totals[x], x)), masks)


def predict(docs: DataFrame, held_out: int = 4, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, held_out, remainder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in slices(texts, 700_000):
                names, scores = model.value.predict(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    given = docs.select("doc_id", (id_bucket(held_out) == remainder).alias("held_out"), text_or_empty().alias("text"))
    return given.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def with_language(docs: DataFrame, least_score: float = 0.2) -> DataFrame:
    """The documents in a language of the model (not 'und', and that score at least), with their columns as they are."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            for a, b in slices(texts, 700_000):
                names, scores = model.value.predict(texts[a:b])
                yield batch.slice(a, b - a).filter(pa.array([n != "und" and s >= least_score for n, s in zip(names, scores, strict=True)]))

    return docs.mapInArrow(run, docs.schema)

"""Byte-level BPE over Arrow batches: encoding with the tokenizers library, offsets, and decoding.

A text is cut before each single blank that a non-blank follows. The split pattern never matches across such a
place, so the pieces encode on their own and their ids joined are the ids of the text; each distinct piece is
encoded once while it stays in a bounded cache (two generations, so that what is still in use outlives a full one).
Texts with other runs of white space are cut by a slower rule.

Null text counts as empty: no ids. Very long texts without blanks are encoded in one call and not cached.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from candor.llm.common import text_or_empty

_CUT = re.compile(r" (?=\S)")


class Pieces:
    """Ids of texts as packed little-endian unsigned 32-bit integers, from a bounded cache of pieces."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], most: int = 500_000, longest: int = 48):
        self.encode, self.most, self.longest = encode, most, longest
        self.after: dict[str, bytes] = {}  # ids of " " + key
        self.before: dict[str, bytes] = {}  # the last full generation

    def _packed(self, texts: list[str]) -> list[bytes]:
        return [array("I", ids).tobytes() for ids in self.encode(texts)] if texts else []

    def batch(self, texts: list[str]) -> list[bytes]:
        if len(self.after) > self.most:
            self.before, self.after = self.after, {}
        known, older = self.after, self.before
        cuts = [t.split(" ") for t in texts]
        new = set()
        for cut in cuts:
            new.update(cut[1:])
        new = new.difference(known)
        odd = {x for x in new if not x or x[0].isspace()}
        if odd:
            for i, cut in enumerate(cuts):
                if not odd.isdisjoint(cut[1:]):
                    cuts[i] = cut = _CUT.split(texts[i])
                    new.update(cut[1:])
            new = new.difference(odd).difference(known)
        again = [x for x in new if x in older]
        known.update((x, older[x]) for x in again)
        new.difference_update(again)
        fresh = [x for x in new if len(x) <= self.longest]
        known.update(zip(fresh, self._packed([" " + x for x in fresh]), strict=True))
        long = [x for x in new if len(x) > self.longest]
        more = dict(zip(long, self._packed([" " + x for x in long]), strict=True))
        heads = self._packed([cut[0] for cut in cuts])
        out = []
        for head, cut in zip(heads, cuts, strict=True):
            got = list(map(known.get, cut[1:]))
            if None in got:
                got = [more[x] if y is None else y for x, y in zip(cut[1:], got, strict=True)]
            out.append(head + b"".join(got))
        return out


def slices(texts: list[str], chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Runs of rows of about so many characters, for bounded work at a time."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def rank_file(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    return [chr(b) if b in set(plain) else chr(256 + sum(1 for x in range(b) if x not in set(plain))) for b in range(256)]


def tokenizer_of(ranks: dict[bytes, int]):
    """The tokenizers library's encoder with the vocabulary and merge order of a rank file.

    Any two neighbours whose bytes joined are in the vocabulary merge, the lowest rank first; a match that is
    itself in the vocabulary is one token.
    """
    from public_tokenizers import PATTERN
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    chars = byte_chars()
    written = {t: "".join(chars[b] for b in t) for t in ranks}
    merges = [
        (written[t[:i]], written[t[i:]])
        for t in sorted(ranks, key=ranks.__getitem__)
        if len(t) > 1
        for i in range(1, len(t))
        if t[:i] in ranks and t[i:] in ranks
    ]
    made = Tokenizer(models.BPE(vocab={written[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(PATTERN), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    made.decoder = decoders.ByteLevel()
    return made


_HELD: dict[str, tuple[Pieces, list[bytes]]] = {}


def codec(path: str) -> tuple[Pieces, list[bytes]]:
    """This process's encoder for a rank file, and the bytes of each id."""
    if path not in _HELD:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        ranks = rank_file(path)
        made = tokenizer_of(ranks)
        table = [b""] * (max(ranks.values()) + 1)
        back = {c: b for b, c in enumerate(byte_chars())}
        for token, number in made.get_vocab().items():
            table[number] = bytes(back[c] for c in token)
        _HELD[path] = Pieces(lambda texts: [e.ids for e in made.encode_batch_fast(texts, add_special_tokens=False)]), table
    return _HELD[path]


def offsets(ids: list[int], table: list[bytes]) -> tuple[list[int], list[int]]:
    """First and one-past-last character of each id; ids that share a split character all cover it."""
    sizes = np.array([len(table[i]) for i in ids], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(table[i] for i in ids), np.uint8)
    char = np.cumsum((data & 0xC0) != 0x80) - 1
    if not len(ids):
        return [], []
    return char[ends - sizes].tolist(), (char[ends - 1] + 1).tolist()


def decode(ids: list[int], table: list[bytes]) -> str:
    """Text of ids: bytes are joined before they are read as UTF-8, so characters split over ids come back whole."""
    return b"".join(map(table.__getitem__, ids)).decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, with_offsets: bool = False) -> DataFrame:
    """doc_id, ids array<int>, and on request starts and ends: the characters each id covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, table = codec(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                ids = [np.frombuffer(x, "<u4").tolist() for x in pieces.batch(texts[a:b])]
                columns = [batch.column(0).slice(a, b - a), pa.array(ids, pa.list_(pa.int32()))]
                if with_offsets:
                    spans = [offsets(x, table) for x in ids]
                    columns += [pa.array([s for s, _ in spans], pa.list_(pa.int32())), pa.array([e for _, e in spans], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "starts", "ends"][: len(columns)])

    shape = "doc_id long, ids array<int>" + (", starts array<int>, ends array<int>" if with_offsets else "")
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, shape)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document, encoded and decoded again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, table = codec(path)
        numbers = [str(i) for i in range(len(table))]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                counts, written, back = [], [], []
                for packed in pieces.batch(texts[a:b]):
                    ids = array("I")
                    ids.frombytes(packed)
                    counts.append(len(ids))
                    written.append(hashlib.sha256(",".join(map(numbers.__getitem__, ids)).encode()).hexdigest())
                    back.append(hashlib.sha256(b"".join(map(table.__getitem__, ids))).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), pa.array(written), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

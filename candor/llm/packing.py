"""Packing documents into training windows: bounded-space best fit in each partition, then merges of what is left open.

Ids are those of a file of the tokenizers library with its own settings: its added tokens count wherever a text spells
them out. A document's ids, with the end id appended, are cut only where they exceed a window. The first windows-full
of a long document are windows of their own; the rest goes to the open window it fits best. Each partition keeps
`open_windows` of them; when none fits, the fullest is closed. What stays open at the end of the partitions is merged
in rounds, each task taking about `fan_in` times as many windows as it may leave open, whatever the size of the input.
Each round has `fan_in` times fewer tasks, and the last has one, which sees no more windows than any other.

Null text counts as empty: the end id alone. Rows with equal ids are packed apart. Every pass is written to the
checkpoint folder, so ids are made once and a lost executor doesn't renumber windows.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.llm.bpe import byte_chars, slices
from candor.llm.common import saved, text_or_empty

SHAPE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open boolean"
NAMES = [x.split()[0] for x in SHAPE.split(", ")]


class Encoder:
    """Ids of whole texts by a tokenizers file, packed as little-endian unsigned 32-bit integers.

    The usual byte-level file (merges in the order of their ids, the common split, added tokens that take nothing with
    them) is read into tiktoken, which gives the same ids several times as fast; any other file is left to its library.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.fast = self._usual(file)
        if self.fast is None:
            from tokenizers import Tokenizer

            self.made = Tokenizer.from_file(path)

    @staticmethod
    def _usual(file: dict):
        import tiktoken
        from public_tokenizers import PATTERN

        model, cut, added = file["model"], file["pre_tokenizer"] or {}, file["added_tokens"]
        whole = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
        whole &= cut.get("type") == "ByteLevel" and cut.get("use_regex", False) and not cut.get("add_prefix_space", True) and not file["normalizer"] and not file["post_processor"]
        whole &= not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        if not whole:
            return None
        back, vocab = {c: b for b, c in enumerate(byte_chars())}, model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        order = [vocab[a + b] for a, b in pairs]
        ranks = {bytes(map(back.__getitem__, t)): n for t, n in vocab.items() if n not in {x["id"] for x in added}}
        if order != sorted(set(order)) or len(ranks) != len(order) + 256 or order[0] != 256:
            return None
        return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in added})

    def batch(self, texts: list[str]) -> list[bytes]:
        if self.fast is None:
            return [array("I", e.ids).tobytes() for e in self.made.encode_batch_fast(texts, add_special_tokens=False)]
        marks = self.fast.special_tokens_set
        return [array("I", self.fast.encode(t, allowed_special="all") if any(m in t for m in marks) else self.fast.encode_ordinary(t)).tobytes() for t in texts]


_HELD: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _HELD:
        _HELD[path] = Encoder(path)
    return _HELD[path]


class Windows:
    """At most `most` open windows of one task; each holds its number, its used length and its rows."""

    def __init__(self, size: int, most: int, base: int):
        self.size, self.most, self.next = size, most, base
        self.free: list[tuple[int, int]] = []  # (free ids, number), ascending
        self.rows: dict[int, list[tuple]] = {}
        self.out: list[tuple] = []

    def place(self, length: int, rows: list[tuple]) -> None:
        """Rows end with their offset in the item; an item of the full length is closed at once."""
        i = bisect_left(self.free, (length, -1))
        if i < len(self.free):
            free, number = self.free.pop(i)
        else:
            if len(self.free) >= self.most:
                self.close(self.free.pop(0)[1])
            free, number = self.size, self.next
            self.next += 1
            self.rows[number] = []
        at = self.size - free
        self.rows[number] += [(*r[:-1], number, at + r[-1]) for r in rows]
        if free == length:
            self.close(number)
        else:
            insort(self.free, (free - length, number))

    def close(self, number: int, still_open: bool = False) -> None:
        self.out += [(*r, still_open) for r in self.rows.pop(number)]

    def drained(self) -> pa.RecordBatch:
        columns, self.out = list(zip(*self.out, strict=True)), []
        types = [pa.int64()] * 7 + [pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns or [()] * 8, types, strict=True)], NAMES)


def _first(path: str, size: int, most: int, end_id: int):
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, windows = _encoder(path), Windows(size, most, TaskContext.get().partitionId() << 32)
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                for doc, packed in zip(docs[a:b], encoder.batch(texts[a:b]), strict=True):
                    packed += end
                    total = len(packed) // 4
                    for start in range(0, total, size):
                        part = packed[4 * start : 4 * (start + size)]
                        windows.place(len(part) // 4, [(doc, start, len(part) // 4, zlib.crc32(part), total, 0)])
                yield windows.drained()
        for _, number in windows.free:
            windows.close(number, True)
        yield windows.drained()

    return run


def _merge(size: int, most: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(size, most, level << 56 | TaskContext.get().partitionId() << 32)
        now, rows = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns[:7]), strict=True):
                if row[5] != now and rows:
                    windows.place(rows[-1][-1] + rows[-1][2], rows)
                    rows = []
                now = row[5]
                rows.append((*row[:5], row[6]))
            yield windows.drained()
        if rows:
            windows.place(rows[-1][-1] + rows[-1][2], rows)
        for _, number in windows.free:
            windows.close(number, True)
        yield windows.drained()

    return run


def pack(docs: DataFrame, path: str, size: int = 2048, open_windows: int = 64, end_id: int = 1, fan_in: int = 8) -> DataFrame:
    """One row per piece: where it starts in its document, its window and its place there."""
    text = docs.select("doc_id", text_or_empty().alias("text"))
    pieces = saved(text.mapInArrow(_first(path, size, open_windows, end_id), SHAPE))
    done, left = pieces.where("not open"), pieces.where("open")
    tasks = -(-left.where("offset = 0").count() // (open_windows * fan_in))  # one piece of each window has offset 0
    level = 0
    while tasks:
        level += 1
        dealt = left.repartition(tasks, F.pmod(F.xxhash64("sequence_id"), F.lit(tasks)))
        pieces = saved(dealt.sortWithinPartitions("sequence_id", "offset").mapInArrow(_merge(size, open_windows, level), SHAPE))
        done, left = done.unionByName(pieces.where("not open")), pieces.where("open")
        tasks = -(-tasks // fan_in) if tasks > 1 else 0
    return done.unionByName(left).select(*NAMES[:-1])

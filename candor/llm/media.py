"""Media columns: baseline JPEG, read down to the DC-only luminance thumbnail (one sample for each 8 x 8 block).

`read` takes any baseline JPEG (Huffman coding, 8 bits, sampled components, restarts): it parses the markers,
decodes the scan and gives the luminance thumbnail and the dimensions. The scans of many images are decoded in
step, each restart segment on its own. `write` stores bytes without loss: byte b is a flat grey block of level b,
which the block's DC coefficient holds exactly; a row of blocks is 24 wide (576 for long payloads), and payloads
too tall for one image go on in further ones.

Null text counts as empty and is stored as 576 bytes of 255. Equal texts give equal media. Corrupt media raise.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from candor.llm.bpe import slices
from candor.llm.common import text_or_empty

UNIT, NARROW, WIDE, TALLEST, SEGMENT = 576, 24, 576, 8190, 144

# The standard's luminance DC table (lengths of codes, symbols); the AC table has the end of a block only.
DC_LENGTHS, DC_SYMBOLS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], list(range(12))
AC_LENGTHS, AC_SYMBOLS = [1] + [0] * 15, [0]


def codes(lengths: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """(code, its length) of each symbol."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(lengths, 1):
        for symbol in symbols[at : at + n]:
            out[symbol] = (code, length)
            code += 1
        code, at = code << 1, at + n
    return out


def lookup(lengths: list[int], symbols: list[int]) -> np.ndarray:
    """length << 8 | symbol by the next 16 bits; 0 where no code fits."""
    table = np.zeros(1 << 16, np.uint16)
    for symbol, (code, length) in codes(lengths, symbols).items():
        first = code << (16 - length)
        table[first : first + (1 << (16 - length))] = length << 8 | symbol
    return table


def _bits_of_differences() -> tuple[np.ndarray, np.ndarray]:
    """Bits (DC code, its extra bits, end of block) and their number for each difference from -255 to 255."""
    dc, (end, end_length) = codes(DC_LENGTHS, DC_SYMBOLS), codes(AC_LENGTHS, AC_SYMBOLS)[0]
    bits, sizes = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, length = dc[size]
        bits[d + 255] = ((code << size | (d if d >= 0 else d + (1 << size) - 1)) << end_length) | end
        sizes[d + 255] = length + size + end_length
    return bits, sizes


BITS, SIZES = _bits_of_differences()


def _segment(kind: int, body: bytes) -> bytes:
    return bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body


def _image(samples: np.ndarray, width: int) -> bytes:
    """One greyscale image of flat blocks, `width` blocks wide."""
    levels = samples.astype(np.int64)
    starts = np.arange(0, len(levels), SEGMENT)
    change = np.diff(levels, prepend=0)
    change[starts] = levels[starts] - 128
    sizes, bits = SIZES[change + 255], BITS[change + 255]
    lengths = np.add.reduceat(sizes, starts)
    whole = (lengths + 7) // 8
    first = np.cumsum(whole) - whole
    before = np.cumsum(sizes) - sizes
    counts = np.diff(np.append(starts, len(levels)))
    place = before + np.repeat(8 * first - before[starts], counts)
    spread = bits << (24 - (place & 7) - sizes)
    at, total = place >> 3, int(whole.sum())
    raw = sum(np.bincount(at + k, (spread >> (16 - 8 * k)) & 255, minlength=total + 2) for k in range(3)).astype(np.int64)[:total]
    raw[first + whole - 1] |= (1 << (8 * whole - lengths)) - 1
    stuffed = np.flatnonzero(raw == 0xFF) + 1
    cuts = first[1:]
    where = np.concatenate([stuffed, cuts, cuts])
    what = np.concatenate([np.zeros(len(stuffed), np.int64), np.full(len(cuts), 0xFF), 0xD0 + np.arange(len(cuts)) % 8])
    order = np.argsort(where, kind="stable")
    scan = np.insert(raw, where[order], what[order]).astype(np.uint8).tobytes()
    height = len(levels) // width
    return b"".join(
        (
            b"\xff\xd8",
            _segment(0xDB, bytes([0, 8] + [1] * 63)),
            _segment(0xC0, bytes([8]) + (8 * height).to_bytes(2, "big") + (8 * width).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])),
            _segment(0xC4, bytes([0x00, *DC_LENGTHS, *DC_SYMBOLS])),
            _segment(0xC4, bytes([0x10, *AC_LENGTHS, *AC_SYMBOLS])),
            _segment(0xDD, SEGMENT.to_bytes(2, "big")),
            _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
            scan,
            b"\xff\xd9",
        )
    )


def payload(data: bytes) -> bytes:
    """The bytes, filled with 255 up to a positive multiple of the unit."""
    return data + b"\xff" * (-len(data) % UNIT or (0 if data else UNIT))


def write(data: bytes) -> bytes:
    """A payload as JPEG images, one after the other."""
    samples = np.frombuffer(data, np.uint8)
    width = NARROW if len(samples) <= NARROW * TALLEST else WIDE
    return b"".join(_image(samples[a : a + width * TALLEST], width) for a in range(0, len(samples), width * TALLEST))


@dataclass
class Image:
    """What the markers say of one image."""

    width: int = 0
    height: int = 0
    quant: dict = field(default_factory=dict)
    tables: dict = field(default_factory=dict)
    parts: list = field(default_factory=list)  # (id, horizontal, vertical, quantisation table)
    scan: list = field(default_factory=list)  # (id, DC table, AC table)
    restart: int = 0
    data: bytes = b""


def parse(media: bytes) -> list[Image]:
    """The images in media; a scan ends at the first marker that is no restart."""
    out, at = [], 0
    while at < len(media):
        if media[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        image, at = Image(), at + 2
        while True:
            if at + 4 > len(media) or media[at] != 0xFF:
                raise ValueError("marker expected")
            kind, size = media[at + 1], int.from_bytes(media[at + 2 : at + 4], "big")
            if kind == 0xFF:
                at += 1
                continue
            body, at = media[at + 4 : at + 2 + size], at + 2 + size
            if kind == 0xDB:
                while body:
                    wide = body[0] >> 4
                    image.quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                    body = body[1 + 64 * (wide + 1) :]
            elif kind == 0xC0 or kind == 0xC1:
                image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                image.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            elif 0xC2 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not a baseline image")
            elif kind == 0xC4:
                while body:
                    lengths = list(body[1:17])
                    image.tables[body[0]] = (tuple(lengths), bytes(body[17 : 17 + sum(lengths)]))
                    body = body[17 + sum(lengths) :]
            elif kind == 0xDD:
                image.restart = int.from_bytes(body[:2], "big")
            elif kind == 0xDA:
                image.scan = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
                break
        end = at
        while True:
            end = media.find(b"\xff", end)
            if end < 0 or end + 1 >= len(media):
                raise ValueError("scan without an end")
            if media[end + 1] == 0 or 0xD0 <= media[end + 1] <= 0xD7:
                end += 2
                continue
            break
        image.data = media[at:end]
        out.append(image)
        if media[end : end + 2] != b"\xff\xd9":
            raise ValueError("only one scan is read")
        at = end + 2
    return out


def _segments(data: bytes) -> list[bytes]:
    """Entropy-coded bytes between restarts, stuffing removed."""
    raw = np.frombuffer(data, np.uint8)
    marks = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[marks + 1]
    cuts = marks[(after >= 0xD0) & (after <= 0xD7)]
    bounds = [0, *(cuts + 2).tolist()]
    ends = [*cuts.tolist(), len(raw)]
    return [data[a:b].replace(b"\xff\x00", b"\xff") for a, b in zip(bounds, ends, strict=True)]


def _decode(parts: list[bytes], blocks: np.ndarray, pattern: list[tuple[int, int, int]], tables: np.ndarray) -> np.ndarray:
    """DC values of the blocks of each segment, all segments decoded in step.

    pattern: (component, DC row, AC row of tables) of each block of an MCU; blocks: how many a segment has.
    """
    sizes = np.array([len(p) for p in parts], np.int64)
    data = np.frombuffer(b"".join(p + b"\xff" * 8 for p in parts), np.uint8).astype(np.uint64)
    n = len(data) - 5
    words = data[:n] << np.uint64(32)
    for i in range(1, 5):
        words |= data[i : n + i] << np.uint64(32 - 8 * i)
    words = words.astype(np.int64)
    starts = 8 * (np.cumsum(sizes + 8) - sizes - 8)
    last = starts + 8 * sizes
    out = np.zeros((len(parts), int(blocks.max(initial=0))), np.int32)
    comp, dc_row, ac_row = (np.array(x) for x in zip(*pattern, strict=True))
    flat = tables.astype(np.int64).ravel()
    row = np.flatnonzero(blocks > 0)
    place, total = starts[row], blocks[row]
    k, done, last_dc = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64), np.zeros((len(row), int(comp.max()) + 1), np.int64)
    while len(row):
        turn = done % len(pattern)
        first = k == 0
        word, shift = words[place >> 3], place & 7
        entry = flat[(np.where(first, dc_row[turn], ac_row[turn]) << 16) + ((word >> (24 - shift)) & 0xFFFF)]
        length, symbol = entry >> 8, entry & 255
        size = np.where(first, symbol, symbol & 15)
        extra = (word >> (40 - shift - length - size)) & ((1 << size) - 1)
        if not length.all():
            raise ValueError("no such code in the scan")
        value = np.where(extra < (1 << size) >> 1, extra - (1 << size) + 1, extra)
        at = np.flatnonzero(first)
        if len(at):
            last_dc[at, comp[turn[at]]] += value[at]
            out[row[at], done[at]] = last_dc[at, comp[turn[at]]]
        k = np.where(first, 1, np.where(size > 0, k + (symbol >> 4) + 1, np.where(symbol == 0xF0, k + 16, 64)))
        place = place + length + size
        over = k >= 64
        done += over
        k[over] = 0
        left = done < total
        if not left.all():
            if (place[~left] > last[row[~left]]).any():
                raise ValueError("a scan ends early")
            row, place, total, k, done, last_dc = row[left], place[left], total[left], k[left], done[left], last_dc[left]
    return out


def read(medias: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """For each media value its images: width, height and luminance thumbnail (uint8)."""
    images = [(i, image) for i, media in enumerate(medias) for image in parse(media)]
    alike: dict[tuple, list[int]] = {}
    plans = []
    for at, (_, image) in enumerate(images):
        ids = {p[0]: p for p in image.parts}
        chosen = [ids[s[0]] for s in image.scan]
        alone = len(chosen) == 1
        pattern = tuple((c, d, 16 + a) for c, ((_, d, a), p) in enumerate(zip(image.scan, chosen, strict=True)) for _ in range(1 if alone else p[1] * p[2]))
        most_h, most_v = max(p[1] for p in image.parts), max(p[2] for p in image.parts)
        own = chosen[0]
        if alone:
            across = -(-(-(-image.width * own[1] // most_h)) // 8)
            down = -(-(-(-image.height * own[2] // most_v)) // 8)
        else:
            across, down = -(-image.width // (8 * most_h)), -(-image.height // (8 * most_v))
        plans.append((pattern, across, down, own, alone))
        alike.setdefault((pattern, tuple(sorted(image.tables.items()))), []).append(at)
    thumbs: list = [None] * len(images)
    for (pattern, tables), members in alike.items():
        known = dict(tables)
        rows = sorted({r for _, d, a in pattern for r in (d, a)})
        stack = np.stack([lookup(list(known[r][0]), list(known[r][1])) for r in rows])
        local = [(c, rows.index(d), rows.index(a)) for c, d, a in pattern]
        parts, blocks, owner = [], [], []
        for at in members:
            image, (_, across, down, _, _) = images[at][1], plans[at]
            found, mcus = _segments(image.data), across * down
            step = image.restart or mcus
            if len(found) != -(-mcus // step):
                raise ValueError("restarts are missing")
            parts += found
            blocks += [min(step, mcus - s * step) * len(pattern) for s in range(len(found))]
            owner += [at] * len(found)
        dc = _decode(parts, np.array(blocks, np.int64), local, stack)
        first = 0
        for at in members:
            image, (_, across, down, own, alone) = images[at][1], plans[at]
            n = 0
            while first + n < len(owner) and owner[first + n] == at:
                n += 1
            values = np.concatenate([dc[s, : blocks[s]] for s in range(first, first + n)])
            first += n
            if not alone:
                h, v = own[1], own[2]
                values = values.reshape(down, across, len(pattern))[:, :, : h * v].reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
            else:
                values = values.reshape(down, across)
            grey = values * image.quant[own[3]] // 8 + 128
            thumbs[at] = (image.width, image.height, np.clip(grey, 0, 255).astype(np.uint8))
    out: list[list] = [[] for _ in medias]
    for (i, _), thumb in zip(images, thumbs, strict=True):
        out[i].append(thumb)
    return out


def thumbnail_hash(thumb: np.ndarray) -> str:
    """Difference hash: 64 bits of whether the mean brightness falls from cell to cell of an 8 x 9 grid."""
    rows = np.linspace(0, thumb.shape[0], 9).astype(int)[:-1]
    columns = np.linspace(0, thumb.shape[1], 10).astype(int)[:-1]
    cells = np.add.reduceat(np.add.reduceat(thumb.astype(np.int64), rows, axis=0), columns, axis=1)
    high = np.diff(np.append(rows, thumb.shape[0])).clip(1)[:, None] * np.diff(np.append(columns, thumb.shape[1])).clip(1)[None, :]
    mean = cells / high
    return np.packbits(mean[:, :-1] > mean[:, 1:]).tobytes().hex()


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (binary): the texts as media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                data = [t.encode("utf-8", "replace") for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(x) for x in data], pa.int64()), pa.array([write(payload(x)) for x in data], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes and what the stored media say: payload digests, dimensions and thumbnail hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stored = batch.column(2).to_pylist()
            for a in range(0, len(stored), 1000):
                some = stored[a : a + 1000]
                rows = []
                for media_bytes, images in zip(some, read(some), strict=True):
                    data = b"".join(t.tobytes() for _, _, t in images)
                    feature = ";".join(f"{w}x{h}:{thumbnail_hash(t)}" for w, h, t in images)
                    rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(media_bytes), hashlib.sha256(media_bytes).hexdigest(), feature))
                types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(some)), batch.column(1).slice(a, len(some)), *columns], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")

"""Hashed byte n-grams of whole texts, many documents at a time."""

from __future__ import annotations

import numpy as np

_KEEP = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def letters_only(text: str) -> bytes:
    """Lower case; ASCII other than letters becomes a blank."""
    return text.lower().encode("utf-8", "replace").translate(_KEEP)


def hashed(texts: list[bytes], order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids (below 2**bits) of the n-grams of each text between two pads of blanks, and the number of each text's.

    Texts follow one another in the first array. No n-gram reaches into another text.
    """
    pad = b" " * (order - 2)
    sizes = np.array([len(t) + 2 * len(pad) for t in texts], np.int64)
    data = np.frombuffer(b"".join(pad + t + pad for t in texts) + b" " * order, np.uint8).astype(np.uint64)
    total = int(sizes.sum())
    code = data[:total].copy()
    for i in range(1, order):
        code |= data[i : total + i] << np.uint64(8 * i)
    code *= np.uint64(0x9E3779B97F4A7C15)
    ids = (code >> np.uint64(64 - bits)).astype(np.uint32)
    counts = np.maximum(sizes - order + 1, 0)
    whole = np.ones(total, bool)
    ends = np.cumsum(sizes)
    for i in range(1, order):
        at = ends - i
        whole[at[sizes >= i]] = False
    return ids[whole], counts


def characters(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the n-grams of code points of each text between two single blanks, and the number of each text's.

    Texts follow one another in the first array. No n-gram reaches into another text.
    """
    sizes = np.array([len(t) + 2 for t in texts], np.int64)
    data = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    counts = np.maximum(sizes - order + 1, 0)
    total = int(sizes.sum()) - order + 1
    if total <= 0:
        return np.zeros(0, np.uint64), counts
    code = np.zeros(total, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(order):
            code = (code + data[i : total + i]) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(29)
        code *= np.uint64(0xBF58476D1CE4E5B9)
    whole = np.ones(total, bool)
    ends = np.cumsum(sizes)
    for i in range(1, order):
        at = ends - i
        at = at[(sizes >= i) & (at < total)]
        whole[at] = False
    return code[whole], counts

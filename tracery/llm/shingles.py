"""Word and shingle fingerprints of many texts at once, in numpy.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D after lower-casing A-Z. A word's
fingerprint is a 64-bit sum of per-byte codes times powers of an odd base; a shingle's mixes those
of its words in order. Equal texts give equal fingerprints in every process and at every size.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_GOLD = np.uint64(0xBF58476D1CE4E5B9)
_LEAF = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit moves about half of the output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * _GOLD
    x = x ^ (x >> np.uint64(27))
    x = x * _LEAF
    return x ^ (x >> np.uint64(31))


_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * _BASE)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POWERS = np.cumprod(np.full(1 << 16, _BASE | np.uint64(1), dtype=np.uint64))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    while len(_POWERS) < n:
        _POWERS = np.concatenate([_POWERS, _POWERS * _POWERS[-1]])
    return _POWERS


def join_texts(texts) -> tuple[np.ndarray, np.ndarray]:
    """All texts as UTF-8 bytes, each followed by a newline, and where each one starts."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
    lengths = np.fromiter((len(p) + 1 for p in parts), dtype=np.int64, count=len(parts))
    return data, np.concatenate([[0], np.cumsum(lengths)])


def word_hashes(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per word of all texts: fingerprint, first byte, byte length; per text: number of words; bytes."""
    data, starts = join_texts(texts)
    data = LOWER[data]
    blank = SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).view(np.int8)))
    begin, end = edge[0::2], edge[1::2]
    if not len(begin):
        return np.zeros(0, np.uint64), begin, begin, np.zeros(len(texts), np.int64), data
    size = end - begin
    # position of each byte in its word: bytes of blanks get a weight of zero
    at = np.arange(len(data)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(data)]])))if begin[0] == 0 else np.arange(len(data)) - np.concatenate([np.zeros(begin[0], np.int64), np.repeat(begin, np.diff(np.concatenate([begin, [len(data)]])))])
    weighed = np.where(blank, np.uint64(0), _CODES[data] * _powers(int(at.max()) + 1)[at])
    hashes = mix64(np.add.reduceat(weighed, begin) + size.astype(np.uint64))
    counts = np.diff(np.searchsorted(begin, starts))
    return hashes, begin, size, counts, data


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all runs of ``size`` words and the text of each; a text with fewer words gives one run."""
    n = len(words)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(n) - np.repeat(first, counts)
    left = np.repeat(counts, counts) - place
    total = np.zeros(n, np.uint64)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    for k in range(size):
        total = total * _BASE + np.where(left > k, padded[k : n + k] + np.uint64(k + 1), np.uint64(0))
    keep = (left >= size) | (place == 0)
    return mix64(total[keep]), text[keep]


def distinct_per_text(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, fingerprint) rows, ordered by text and then fingerprint."""
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    if len(h):
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])])
        h, t = h[new], t[new]
    return h, t

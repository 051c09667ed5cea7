"""Vectorised text helpers for Arrow batches: words, shingles and their 64-bit hashes.

Texts of a batch are handled as one UTF-8 buffer, in slices of whole documents of about
``SLICE_BYTES`` each, so that memory does not depend on the batch. Hashes are polynomials
modulo 2^64 that a finalizer mixes; they depend on the bytes of the words alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
_R = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_R_INV = pow(_R, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _byte_class(spaces: bytes) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[list(spaces)] = False
    return table


#: ``[^\x20\x09-\x0D]+``
BLANK_SEPARATED = _byte_class(b" \t\n\x0b\x0c\r")
#: ASCII letters and digits, and every byte of a character beyond ASCII
ALPHANUMERIC = np.array([chr(b).isalnum() or b >= 128 for b in range(256)], dtype=bool)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer with full avalanche, on uint64."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power(base: int, n: int) -> np.ndarray:
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        p = np.full(max(n, SLICE_BYTES + (1 << 16)), base, dtype=np.uint64)
        p[0] = 1
        _powers[key] = np.multiply.accumulate(p)
    return _powers[key]


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets in the bytes) for runs of rows; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, off, data = texts.buffers()
    off = np.frombuffer(off, dtype=kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE_BYTES, side="right")) - 1)
        j = min(j, n)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_bounds(raw: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (exclusive) and document of every word."""
    if not len(raw):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = is_word[raw]
    cut = np.zeros(len(raw) + 1, dtype=bool)
    cut[off] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last[:-1] &= ~inside[1:] | cut[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def prefix_hashes(raw: np.ndarray) -> Callable[[np.ndarray, np.ndarray | int], np.ndarray]:
    """Function of starts and lengths to the 64-bit hashes of these spans of ``raw``, which has what they need summed once."""
    n = len(raw)
    total = np.zeros(n + 1, dtype=np.uint64)
    body = raw.astype(np.uint64)
    body += np.uint64(1)
    body *= _power(_R, n)[:n]
    np.cumsum(body, out=total[1:])
    inverse = _power(_R_INV, n + 1)

    def hashes(start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        h = total[start + length] - total[start]
        h *= inverse[start]
        h += np.asarray(length, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return mix(h)

    return hashes


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of byte spans."""
    return prefix_hashes(LOWER[raw] if lower else raw)(start, end - start)


def word_hashes(raw: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every lower-cased (ASCII) word."""
    start, end, doc = word_bounds(raw, off, is_word)
    return span_hashes(raw, start, end), doc


_STEP = [pow(0xA24BAED4963EE407, i + 1, 1 << 64) for i in range(64)]


def shingle_hashes(words: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every run of ``k`` words; a document of fewer words has its whole sequence as one."""
    m = len(words)
    h = np.zeros(max(m - k + 1, 0), dtype=np.uint64)
    for i in range(k):
        h += words[i : i + len(h)] * np.uint64(_STEP[i])
    ok = doc[: len(h)] == doc[k - 1 :][: len(h)]
    h, d = mix(h)[ok], doc[: len(h)][ok]
    count = np.bincount(doc, minlength=n_docs)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        begin = np.searchsorted(doc, short)
        extra = np.zeros(len(short), dtype=np.uint64)
        for i in range(k - 1):
            has = count[short] > i
            extra[has] += words[begin[has] + i] * np.uint64(_STEP[i])
        extra += count[short].astype(np.uint64)
        h, d = np.concatenate([h, mix(extra)]), np.concatenate([d, short])
        order = np.argsort(d, kind="stable")
        h, d = h[order], d[order]
    return h, d


def distinct_by_doc(h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each document, ascending within it."""
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], d[new]


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from concatenated values and the length of each row's list."""
    off = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, type=kind))

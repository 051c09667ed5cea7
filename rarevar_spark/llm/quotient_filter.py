"""Counting quotient filters of packed keys: lossless compact counters, sorted, so that filters of many shards merge in order.

A key is two uint64 halves, or one (then the lower half is 0). It is permuted by an invertible mixing; the top bits of the result are the
quotient, all the other bits the remainder, so that nothing of the key is lost. A filter keeps how many keys each quotient has and, in
order, the bytes of the remainders and the counts.
"""

from __future__ import annotations

import zlib

import numpy as np

_ROUNDS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xDB4F0B9175AE2165)
_A, _B = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_BACK = [np.uint64(pow(x, -1, 1 << 64)) for x in (_A, _B)]
_A, _B = np.uint64(_A), np.uint64(_B)


def _stir(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key)) * _A
    x ^= x >> np.uint64(29)
    x *= _B
    return x ^ (x >> np.uint64(32))


def permute(hi: np.ndarray, lo: np.ndarray, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """A permutation of all pairs of uint64, by rounds that add a mixture of one half to the other; or of single uint64 ``hi``."""
    if not wide:
        return _stir(hi, _ROUNDS[0]), lo
    for k in _ROUNDS:
        hi, lo = lo, hi ^ _stir(lo, k)
    return hi, lo


def restore(hi: np.ndarray, lo: np.ndarray, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """The keys that :func:`permute` made these of."""
    if not wide:
        hi = (hi ^ (hi >> np.uint64(32))) * _BACK[1]
        hi = hi ^ (hi >> np.uint64(29)) ^ (hi >> np.uint64(58))
        return hi * _BACK[0] - np.uint64(_ROUNDS[0]), lo
    for k in reversed(_ROUNDS):
        hi, lo = lo ^ _stir(hi, k), hi
    return hi, lo


def combine(hi: np.ndarray, lo: np.ndarray, count: np.ndarray | None, wide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts (int64; none: one each)."""
    if wide or count is not None:
        order = np.lexsort((lo, hi)) if wide else np.argsort(hi, kind="stable")
        hi, lo = hi[order], lo[order]
        count = count[order] if count is not None else None
    else:
        hi = np.sort(hi)
    new = np.ones(len(hi), dtype=bool)
    new[1:] = hi[1:] != hi[:-1]
    if wide:
        new[1:] |= lo[1:] != lo[:-1]
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(hi))) if count is None else np.add.reduceat(count, at) if len(at) else count
    return hi[at], lo[at], count


def _counts_to_bytes(count: np.ndarray) -> bytes:
    """A byte for each count below 255; larger ones follow in full."""
    large = count >= 255
    return np.where(large, 255, count).astype(np.uint8).tobytes() + count[large].astype("<i8").tobytes()


def pack(hi: np.ndarray, lo: np.ndarray, count: np.ndarray, shard_bits: int, wide: bool) -> bytes:
    """A filter of sorted, distinct, permuted keys that share their top ``shard_bits`` bits.

    The quotient takes as many more bits as give about one key each.
    """
    n = len(hi)
    bits = min(max(int(n).bit_length() - 1, 0), 24, 63 - shard_bits)
    quotient = ((hi << np.uint64(shard_bits)) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(n, np.int64)
    run = np.bincount(quotient, minlength=1 << bits)
    width = -(-(64 - shard_bits - bits) // 8)  # bytes of the upper half that the quotient doesn't say
    upper = hi.astype(">u8").view(np.uint8).reshape(n, 8)[:, 8 - width :].copy()
    if width * 8 > 64 - shard_bits - bits:  # the first byte keeps remainder bits alone
        upper[:, 0] &= np.uint8((1 << (64 - shard_bits - bits - 8 * (width - 1))) - 1)
    head = np.array([n, shard_bits, bits], dtype="<i4").tobytes()
    runs, counts = _counts_to_bytes(run), _counts_to_bytes(count)
    plain = zlib.compress(runs + counts, 1)
    return head + np.array([len(plain), len(runs)], dtype="<i4").tobytes() + plain + upper.tobytes() + (lo.astype(">u8").tobytes() if wide else b"")


def _counts_from_bytes(raw: bytes, n: int) -> np.ndarray:
    count = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    large = count == 255
    count[large] = np.frombuffer(raw, "<i8", int(large.sum()), n)
    return count


def unpack(data: bytes, shard: int, wide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted permuted keys and the counts of a filter, whose keys all begin with the bits of ``shard``."""
    n, shard_bits, bits = (int(x) for x in np.frombuffer(data, "<i4", 3))
    size, runs = (int(x) for x in np.frombuffer(data, "<i4", 2, 12))
    plain = zlib.decompress(data[20 : 20 + size])
    run, count = _counts_from_bytes(plain[:runs], 1 << bits), _counts_from_bytes(plain[runs:], n)
    quotient = np.repeat(np.arange(1 << bits), run)
    width = -(-(64 - shard_bits - bits) // 8)
    upper = np.zeros((n, 8), np.uint8)
    upper[:, 8 - width :] = np.frombuffer(data, np.uint8, n * width, 20 + size).reshape(n, width)
    hi = upper.reshape(-1).view(">u8").astype(np.uint64)
    top = (quotient + (shard << bits)).astype(np.uint64)
    if shard_bits + bits:
        hi |= top << np.uint64(64 - shard_bits - bits)
    lo = np.frombuffer(data, ">u8", n, 20 + size + n * width).astype(np.uint64) if wide else np.zeros(n, np.uint64)
    return hi, lo, count


def split(hi: np.ndarray, lo: np.ndarray, count: np.ndarray | None, shard_bits: int, wide: bool) -> list[tuple[int, bytes]]:
    """(shard, filter) of each shard that has keys, out of permuted keys in any order with repeats."""
    hi, lo, count = combine(hi, lo, count, wide)
    if not len(hi):
        return []
    shard = (hi >> np.uint64(64 - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(hi), np.int64)
    cut = np.flatnonzero(np.diff(shard)) + 1
    bounds = [0, *cut.tolist(), len(hi)]
    return [(int(shard[a]), pack(hi[a:b], lo[a:b], count[a:b], shard_bits, wide)) for a, b in zip(bounds, bounds[1:])]


def merge(filters: list[tuple[int, bytes]], wide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted permuted keys and summed counts of filters of one shard.

    Some at a time, so that each key is moved a few times however many filters there are.
    """
    parts = [unpack(data, shard, wide) for shard, data in filters]
    while len(parts) > 1:
        parts = [combine(*(np.concatenate(x) for x in zip(*parts[i : i + 16])), wide) for i in range(0, len(parts), 16)]
    return parts[0] if parts else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))

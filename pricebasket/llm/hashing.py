"""Hashes of substrings and words, many at a time, over the joined bytes of a batch of texts (numpy, inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

#: Bytes of texts that are hashed together; a longer text goes alone.
TOGETHER = 1 << 20
#: Bytes of a span that are mixed in eight at a time.
LONG = 512
#: Positions that are hashed together, so that what is between stays in a processor's cache.
CACHED = 1 << 15
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over 64 bits."""
    y = x >> _U(30)
    y ^= x
    y *= _U(0xBF58476D1CE4E5B9)
    y ^= y >> _U(27)
    y *= _U(0x94D049BB133111EB)
    y ^= y >> _U(31)
    return y


def _blocks(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position, as one number; past the end there are zeros."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _U(0x9E3779B97F4A7C15) + b)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from each start to its end: equal for equal bytes, wherever they stand.

    Blocks of eight bytes are mixed in one after the other, so no arithmetic relation of texts carries over (as it would
    in a sum of powers). What is left of spans of more than LONG bytes goes through a library's hash at once."""
    blocks, left = _blocks(data), (end - start).astype(np.int64)
    out, live, at = mix(left.astype(_U)), np.flatnonzero(left > 0), start.astype(np.int64)
    for _ in range(LONG // 8):
        if not len(live):
            return out
        x, short = blocks[at[live]].astype(_U), left[live] < 8
        x[short] &= (_U(1) << (left[live[short]] * 8).astype(_U)) - _U(1)
        out[live] = _joined(out[live], x)
        left[live] -= 8
        at[live] += 8
        live = live[left[live] > 0]
    for k in live.tolist():
        out[k] = mix(out[k : k + 1] ^ _U(xxhash.xxh3_64_intdigest(data[at[k] : end[k]].tobytes())))[0]
    return out


def gram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """The hash of the q bytes from every position that has so many after it; halves are mixed into wholes, level by level."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, _U)
    if n > CACHED:
        return np.concatenate([gram_hashes(data[k : k + CACHED + q - 1], q) for k in range(0, n, CACHED)])
    blocks, out, used, width = _blocks(data), np.full(n, q, _U), 0, 8
    level = mix(blocks[: max(0, len(data) - 7)].astype(_U))
    eights = q // 8
    while eights:
        if eights & 1:
            out = _joined(out, level[used : used + n])
            used += width
        eights >>= 1
        if eights:
            level = _joined(level[:-width], level[width:])
            width *= 2
    if q % 8:
        out = _joined(out, blocks[used : used + n].astype(_U) & _U((1 << 8 * (q % 8)) - 1))
    return out


def together(texts: list[bytes], most: int = TOGETHER) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, bytes, offsets) of runs of texts that hold about so many bytes."""
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) <= most):
            size += len(texts[last])
            last += 1
        offsets = np.zeros(last - first + 1, np.int64)
        np.cumsum([len(t) for t in texts[first:last]], out=offsets[1:])
        yield first, last, np.frombuffer(b"".join(texts[first:last]), np.uint8), offsets
        first = last


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)

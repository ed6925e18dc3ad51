"""Words and hashes of whole texts, computed on Arrow buffers without a loop over rows or characters.

A text column arrives as one byte buffer with offsets. ``blocks`` cuts it into blocks of whole texts of a bounded size
(one longer text is a block of its own); everything else works on the arrays of a block. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BLOCK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (the finalizer of splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_CODE = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers["up"]) <= n:
        size = max(n + 1, BLOCK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            p = np.full(size, base, U)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def blocks(texts: pa.Array, max_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for consecutive rows; at most ``max_bytes`` unless one row is longer,
    and at most 16,384 rows."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(pc.cast(texts, pa.large_string()), "")
    n = len(texts)
    if n == 0:
        return
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + max_bytes, "right")) - 1
        hi = min(max(hi, lo + 1), n, lo + 16_384)
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return _LOWER[data]


def tokens(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes marked ``inside``; runs end at the end of their text."""
    n = len(inside)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+``: start, end and row."""
    return tokens(~_SPACE[data], offs)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums, from which ``span_hash`` takes the hash of any span."""
    up, _ = _power(len(data))
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_CODE[data] * up[: len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span, wherever it stands."""
    _, down = _power(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


def text_hash(value: str | bytes) -> int:
    """The hash ``span_hash`` gives to the same bytes."""
    data = np.frombuffer(value.encode() if isinstance(value, str) else value, np.uint8)
    return int(span_hash(prefix_sums(data), np.array([0]), np.array([len(data)]))[0])


def grams(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of n tokens within a row, and the place of its first token."""
    if len(hashes) < n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    at = np.flatnonzero(rows[n - 1 :] == rows[: len(rows) - n + 1])
    out = np.full(len(at), n, U)
    for j in range(n):
        out = out * U(0xA24BAED4963EE407) + hashes[at + j]
    return mix(out), at


def held_out_ids(column: str, modulus: int, remainder: int):
    """Column: does crc32 of the id as text leave this remainder? A null id counts as empty text."""
    from pyspark.sql import functions as F

    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus == remainder

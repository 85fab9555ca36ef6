"""Word hashes, shingles and sliding minima over Arrow batches, in NumPy."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash

#: Texts of about so many bytes are taken at a time; a longer text is taken alone.
SLICE_BYTES = 3_000_000
#: Bytes whose words are hashed at once.
BLOCK_BYTES = 1 << 19
#: Longer words are hashed one by one.
LONG_WORD = 32

U64 = np.uint64
_MULTIPLIER = U64(0x9E3779B97F4A7C15)


def small_batches(spark) -> None:
    """Arrow batches of some megabytes for whole texts, unless the session has set sizes of its own.

    With Spark's default of 10,000 rows, a batch of long texts takes its size several times over in the executor's
    memory and in the worker's.
    """
    for key, default, value in (("maxRecordsPerBatch", "10000", "4096"), ("maxBytesPerBatch", "67108864b", "16m")):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", default) == default:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", value)


def tidy(task):
    """A task of Arrow batches that gives the memory it held back to the system when it ends; workers live on, idle, for later stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
            if trim:
                trim(0)

    return run


def column(batch: pa.RecordBatch, k: int = 0) -> list[bytes | None]:
    """A string column as bytes."""
    return batch.column(k).cast(pa.large_binary() if pa.types.is_large_string(batch.column(k).type) else pa.binary()).to_pylist()


def by_bytes(texts: list[bytes | None], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes each."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


@cache
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A value for each byte, the powers of an odd base, those of its inverse, and which bytes are white space."""
    base = 0xD6E8FEB86659FD93
    powers = [np.multiply.accumulate(np.concatenate([[U64(1)], np.full(BLOCK_BYTES, x, U64)])) for x in (base, pow(base, -1, 1 << 64))]
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    return mixed(np.arange(1, 257, dtype=U64) * _MULTIPLIER), *powers, space


def hashed(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """All words' hashes in a row, and where each text's words begin (and the last one's end).

    Words are runs of bytes other than space, tab, LF, VT, FF and CR. A word's hash is the polynomial of
    its bytes' values, read off running sums over a block; longer words are hashed by xxhash.
    """
    values, powers, inverse, space = _powers()
    joined = b" ".join([t or b"" for t in texts]) + b" "
    data = np.frombuffer(joined, np.uint8)
    edge = np.flatnonzero(np.diff(~space[data], prepend=False, append=False))
    start, stop = edge[::2], edge[1::2]
    out = np.empty(len(start), U64)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(stop, start[lo] + BLOCK_BYTES, "right")))
        first, n = start[lo], int(stop[hi - 1] - start[lo])
        if n <= BLOCK_BYTES:  # else it is one long word
            sums = np.zeros(n + 1, U64)
            np.cumsum(values[data[first : first + n]] * powers[:n], out=sums[1:])
            at, to = start[lo:hi] - first, stop[lo:hi] - first
            out[lo:hi] = mixed((sums[to] - sums[at]) * inverse[at] + (to - at).astype(U64) * _MULTIPLIER)
        lo = hi
    for i in np.flatnonzero(stop - start > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(joined[start[i] : stop[i]])
    ends = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
    return out, np.searchsorted(start, ends)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def grams(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of the k words from each place on (the last k - 1 places have none)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    g = np.full(n, seed, U64)
    for j in range(k):
        g *= _MULTIPLIER
        g += h[j : j + n]
    return mixed(g)


def sliding(x: np.ndarray, t: int, f=np.minimum) -> np.ndarray:
    """``f`` over each t neighbouring values."""
    if len(x) < t:
        return np.empty(0, x.dtype)
    have, out = 1, x
    while have < t:
        step = min(have, t - have)
        out = f(out[:-step], out[step:])
        have += step
    return out


def places(ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of k words begin that lie in one text, and the text's number of each."""
    lengths = np.diff(ends)
    counts = np.maximum(lengths - k + 1, 0)
    text = np.repeat(np.arange(len(lengths)), counts)
    first = np.cumsum(counts) - counts
    return np.arange(counts.sum()) - np.repeat(first, counts) + np.repeat(ends[:-1], counts), text


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return x.view(U64)

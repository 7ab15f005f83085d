"""Words and hashes of whole texts, used inside tasks."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from xxhash import xxh3_64_intdigest

#: Lower-cases A-Z, keeps 0-9, a-z and every byte from 0x80 on, and blanks the rest.
ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)

_MULTIPLIER = 0x9E3779B97F4A7C15
_SECOND = 0xD6E8FEB86659FD93
_powers = {}


def slices(batches, *columns, most=1 << 22):
    """The rows of Arrow batches in slices whose texts in ``columns`` have about ``most`` bytes.

    What a task computes from a slice is then bounded, however many rows a batch has; a single
    longer text is a slice of its own.
    """
    for batch in batches:
        size = np.full(batch.num_rows, 64, np.int64)
        for at in columns:
            lengths = pc.fill_null(pc.binary_length(batch.column(at)), 0)
            size += lengths.to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        start = 0
        while start < batch.num_rows:
            reached = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, reached + most, side="right")))
            yield batch.slice(start, end - start)
            start = end


def texts(column):
    """The texts of an Arrow column as UTF-8 bytes; null counts as empty."""
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


def hashes(words):
    """A 64-bit hash of each word."""
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x):
    """Spread 64-bit values evenly; one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n, base):
    """``base`` to the powers 0..n-1 and their inverses, modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            factors = np.full(size, b, np.uint64)
            factors[0] = 1
            both.append(np.multiply.accumulate(factors))
        have = _powers[base] = tuple(both)
    return have[0][:n], have[1][:n]


def sums(h, base=_MULTIPLIER):
    """Running sums from which ``stretch`` takes the hash of any run of words."""
    out = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(len(h), base)[0], out=out[1:])
    return out


def stretch(running, start, end, base=_MULTIPLIER):
    """Hashes of the runs of words ``start``..``end`` (exclusive), equal for equal runs."""
    inverse = powers(len(running), base)[1]
    return mix((running[end] - running[start]) * inverse[start] + np.uint64(1) * (end - start).astype(np.uint64))


def windows(h, k, base=_MULTIPLIER):
    """Hashes of all runs of ``k`` words."""
    start = np.arange(max(0, len(h) - k + 1))
    return stretch(sums(h, base), start, start + k, base)


def window_pairs(h, k):
    """Two independent hashes of all runs of ``k`` words: 128 bits together."""
    return windows(h, k), windows(h, k, _SECOND)


def shingles(h, k):
    """The sorted distinct hashes of runs of ``k`` words; fewer words count as one run."""
    return np.unique(windows(h, min(k, len(h)))) if len(h) else np.zeros(0, np.uint64)


def signed(x):
    return np.ascontiguousarray(x).view(np.int64)

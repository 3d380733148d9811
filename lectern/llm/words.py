"""Words and hashes of whole Arrow batches of texts, computed with numpy on their UTF-8 bytes.

All separators are ASCII, so bytes of longer code points are always word bytes and a
byte table decides what a word is. Words never reach across texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer single text is handled whole.
CHUNK_BYTES = 2 << 20

_SEED = np.random.default_rng(20240229)
# Fixed random values per byte; A-Z share the values of a-z, which lower-cases.
_BYTE_VALUE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_VALUE[65:91] = _BYTE_VALUE[97:123]
_STEP = int(_SEED.integers(1, 2**62)) * 4 + 1
_STEP_INVERSE = pow(_STEP, -1, 2**64)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_PLACE = _SEED.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of word bytes: True outside the given inclusive byte ranges."""
    table = np.ones(256, bool)
    for low, high in ranges:
        table[low : high + 1] = False
    return table


SPACED = separators((0x20, 0x20), (0x09, 0x0D))
ALPHANUMERIC = separators((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


class _Powers:
    """Powers of the step and of its inverse, kept up to the longest chunk seen."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            size = max(n, CHUNK_BYTES)
            for name, base in (("up", _STEP), ("down", _STEP_INVERSE)):
                values = np.full(size, base, np.uint64)
                values[0] = 1
                setattr(cls, name, np.multiply.accumulate(values))
        return cls.up[:n], cls.down[:n]


def mix(values: np.ndarray) -> np.ndarray:
    """Finish a hash so that every bit depends on every input bit."""
    values = values ^ (values >> np.uint64(30))
    values = values * _MIX[0]
    values = values ^ (values >> np.uint64(27))
    values = values * _MIX[1]
    return values ^ (values >> np.uint64(31))


def chunks(texts: pa.Array, size: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string array into runs of texts of about ``size`` bytes.

    Yields first row, row count, the run's bytes and the rows' offsets into them. Nulls are empty texts.
    """
    size = size or CHUNK_BYTES
    if pa.types.is_dictionary(texts.type) or texts.type != pa.large_string():
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and offsets[-1] else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        last = min(last, n)
        yield first, last - first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def find_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a run of texts, and the number of words before each text."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = table[data]
    starts = word[1:-1] & ~word[:-2]
    ends = word[1:-1] & ~word[2:]
    cuts = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    starts[cuts] = word[1:-1][cuts]
    ends[cuts - 1] = word[1:-1][cuts - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes (after lower-casing A-Z if ``fold``)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _Powers.to(len(data))
    table = _BYTE_VALUE if fold else _EXACT_VALUE
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


_EXACT_VALUE = _BYTE_VALUE.copy()
_EXACT_VALUE[65:91] = _SEED.integers(1, 2**63, 26, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(hashes: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words per text; a shorter text is one shingle.

    ``firsts`` has the number of words before each text. Returns the shingles and the
    number of shingles before each text (not yet distinct).
    """
    counts = np.diff(firsts)
    kept = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    before = np.concatenate(([0], np.cumsum(kept)))
    owner = np.repeat(np.arange(len(counts)), kept)
    at = np.arange(before[-1]) - before[:-1][owner] + firsts[:-1][owner]
    length = np.minimum(counts, width)[owner]
    total = np.zeros(len(at), np.uint64)
    for k in range(width):
        inside = length > k
        if inside.all():
            total += hashes[at + k] * _PLACE[k]
        else:
            total[inside] += hashes[at[inside] + k] * _PLACE[k]
    return mix(total ^ _PLACE[63 - width] * length.astype(np.uint64)), before


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every ``size`` consecutive words, across texts too."""
    n = max(0, len(hashes) - size + 1)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += hashes[k : k + n] * _PLACE[k]
    return mix(total)

"""Words and their hashes over whole Arrow batches, in numpy.

Texts stay the UTF-8 bytes of the Arrow column; words are byte ranges of it. Nothing here keeps more than the batch.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of white space in the text contracts.
SPACE_BYTES = np.zeros(256, bool)
SPACE_BYTES[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z in lower case, every other byte as it is.
LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[65:91] += 32
#: Bytes of text whose hashes are worked out at a time; bounds the memory for long texts too.
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its texts; missing texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]: offsets[-1]], offsets - offsets[0]


def parts(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about this many bytes, one row at least."""
    offsets = text_bytes(column)[1]
    begin = 0
    while begin < len(column):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + size, "right")) - 1)
        yield begin, end
        begin = end


def word_ranges(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = SPACE_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the number of words before it (one more entry than texts)."""
    inside = ~outside[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    at = offsets[:-1][full]
    begin[at] = inside[at]
    at = offsets[1:][full] - 1
    end[at] = inside[at]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    base, back = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    base[:1] = back[:1] = 1
    return np.multiply.accumulate(base), np.multiply.accumulate(back), mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range. Ranges must be in order of their starts."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, low + BLOCK // 2, "left")))
        high = int(ends[i:j].max())
        n = 1 << max(BLOCK.bit_length() - 1, (high - low).bit_length())
        up, down, letter = _powers(n)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(letter[data[low:high]] * up[: high - low], out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        i = j
    return out


def gram_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of `width` words that start at each place where so many follow, over all texts."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    out = mixed(words[: len(words) - width + 1] + np.uint64(width))
    for k in range(1, width):
        out = mixed(out * np.uint64(_BASE) + words[k: len(words) - width + 1 + k])
    return out


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; A-Z count as a-z. A text of fewer words than the
    width, but not none, has its whole sequence as the one shingle."""
    data, offsets = text_bytes(column)
    data = LOWER_BYTES[data]
    starts, ends, before = word_ranges(data, offsets)
    words = range_hashes(data, starts, ends)
    grams = gram_hashes(words, width)
    out = []
    for low, high in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if high - low >= width:
            out.append(np.unique(grams[low: high - width + 1]))
        elif high > low:
            out.append(gram_hashes(words[low:high], high - low))
        else:
            out.append(np.zeros(0, np.uint64))
    return out

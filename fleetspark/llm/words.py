"""Words of whole texts as numpy arrays, one Arrow batch at a time."""

import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# The functions below travel to the executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bytes of text that are worked on at once; a longer text is taken alone.
SLICE_BYTES = 1 << 20

_PHASE = 0x9E3779B97F4A7C15


class Words(NamedTuple):
    """Words of several texts: a hash each, the text that each is in, and the first word of each text (one more at the end)."""

    hash: np.ndarray
    text: np.ndarray
    first: np.ndarray
    begin: np.ndarray
    end: np.ndarray


def mixed(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit values, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def randoms(n: int, seed: int) -> np.ndarray:
    """Fixed random 64-bit values."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_PHASE) + np.uint64(seed))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold at most so many bytes, or one text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part, begin, total = [], 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > begin and total + size > most:
            part.append((begin, i))
            begin, total = i, 0
        total += size
    if batch.num_rows:
        part.append((begin, batch.num_rows))
    for begin, end in part:
        yield batch.slice(begin, end - begin)
    # What Arrow holds for later batches adds up over the workers of an executor.
    pa.default_memory_pool().release_unused()


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and where each begins (one more at the end). A null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def words_of(texts: pa.Array, seed: int = 0, at_spaces: bool = False) -> Words:
    """The words of the texts, hashed as the sum of a value for each byte times one for its place in the word.

    With `at_spaces` only the space separates words, and other white space belongs to them.
    """
    raw, at = text_bytes(texts)
    inside = raw != 32
    if not at_spaces:
        inside &= (raw < 9) | (raw > 13)
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    cuts = at[:-1][at[:-1] < at[1:]]
    opens[cuts] = inside[cuts]
    begin = np.flatnonzero(opens)
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | opens[1:]
    end = np.flatnonzero(closes) + 1
    if len(begin) == 0:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, np.zeros(len(at), np.int64), none, none)
    where = np.flatnonzero(inside)
    lengths = end - begin
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(where)) - np.repeat(starts, lengths)
    values = randoms(256, seed + 1).take(raw.take(where))
    values *= (randoms(int(lengths.max()), seed + 2) | np.uint64(1)).take(place)
    hashed = mixed(np.add.reduceat(values, starts))
    text = np.searchsorted(at, begin, "right") - 1
    return Words(hashed, text, np.searchsorted(begin, at), begin, end)


def shingles_of(words: Words, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words from each word on, and whether all n are in one text."""
    total = len(words.hash)
    if total < n:
        return np.zeros(total, np.uint64), np.zeros(total, bool)
    factor = int(randoms(1, seed + 3)[0]) | 1
    ahead = np.full(total, factor, np.uint64)
    ahead[0] = 1
    ahead = np.cumprod(ahead)
    back = np.full(total, pow(factor, -1, 1 << 64), np.uint64)
    back[0] = 1
    back = np.cumprod(back)
    sums = np.zeros(total + 1, np.uint64)
    np.cumsum(words.hash * ahead, out=sums[1:])
    hashed, whole = np.zeros(total, np.uint64), np.zeros(total, bool)
    last = total - n + 1
    hashed[:last] = mixed((sums[n:] - sums[:last]) * back[:last] + np.uint64(n))
    whole[:last] = words.text[:last] == words.text[n - 1 :]
    return hashed, whole

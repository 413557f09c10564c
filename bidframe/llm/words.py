"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a maximal run of bytes other than space and ``\\t \\n \\v \\f \\r``. Words never cross from one text into
the next. Hashes are polynomial in the bytes modulo 2**64 and then mixed, so equal words have equal hashes in every
task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text handled at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20

_tables: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _tables.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * BLOCK_BYTES:
            _tables[base] = have
    return have[:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spread 64-bit values so that every bit depends on all bits."""
    x = x + np.uint64((salt * BASE + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive rows; a null text is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def portions(texts: list[str], chars: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about ``chars`` characters."""
    first = held = 0
    for k, text in enumerate(texts):
        held += len(text)
        if held >= chars:
            yield first, k + 1
            first, held = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


@dataclass
class Words:
    """start, end: byte positions; hash: of the lower-cased bytes; first: index of each row's first word, and at the end the number of words."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def split_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The words of a block, their bytes compared with A-Z lower-cased."""
    inside = ~is_space(data)
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((ascii_lower(data).astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * powers(BASE_INVERSE, len(data) + 1)[start], 1)
    return Words(start, end, hashes, np.searchsorted(start, offsets))


def shingle_sets(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's distinct shingles, one row after the other, ascending in a row, and where each row's start. A row with fewer words has its whole sequence as one shingle; one without words has none."""
    n = len(words.hash)
    factor = mix(np.arange(1, width + 1, dtype=np.uint64), 7) | np.uint64(1)
    run = np.zeros(max(n - width + 1, 0), dtype=np.uint64)
    for k in range(width):
        run += words.hash[k : n - width + 1 + k] * factor[k] if len(run) else run
    run = mix(run, 2)
    out, starts = [], [0]
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= width:
            got = np.unique(run[a : b - width + 1])
        elif b > a:
            whole = (words.hash[a:b] * factor[: b - a]).sum(dtype=np.uint64, keepdims=True)
            got = mix(whole, 100 + b - a)
        else:
            got = run[:0]
        out.append(got)
        starts.append(starts[-1] + len(got))
    return (np.concatenate(out) if out else run[:0]), np.array(starts)

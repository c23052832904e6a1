"""Texts of Arrow batches as numpy byte blocks, with vectorised word and substring hashes.

A block joins the UTF-8 bytes of several documents; ``bounds[i]:bounds[i + 1]`` are those of document ``i``.
Blocks keep numpy temporaries to a few megabytes whatever the batch holds. A text longer than the limit is a block of
its own in ``text_blocks`` and comes in pieces from ``text_pieces``.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

BLOCK_BYTES = 1 << 20
#: White space that separates words: the space and tab to carriage return.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
MULTIPLIER = 0x9E3779B97F4A7C15


def give_back() -> None:
    """Returns freed memory to the system: Arrow's pool and, where the C library can, what numpy's arrays left in the heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable) -> Callable:
    """``run`` over the batches of a task, giving spare memory back at its end: a worker lives on and would hoard it while others work."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return one


class Block(NamedTuple):
    """Texts ``first`` to ``last`` of a column. A piece of a long text is alone in its block: it begins ``start`` bytes into the text
    and is not ``ended`` if more of the text follows."""

    first: int
    last: int
    buf: np.ndarray
    bounds: np.ndarray
    start: int = 0
    ended: bool = True


def _offsets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of all texts and the bytes they point into; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = pc.fill_null(column, b"" if binary else "")
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of about ``limit`` bytes over a string or binary column; a text is never cut."""
    offsets, data = _offsets(column)
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield Block(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def _next_space(data: np.ndarray, at: int, end: int) -> int:
    while at < end:
        found = np.flatnonzero(~_word_bytes()[data[at : min(at + 4096, end)]])
        if len(found):
            return at + int(found[0])
        at += 4096
    return end


def text_pieces(column: pa.Array, limit: int = BLOCK_BYTES, overlap: int | None = None) -> Iterator[Block]:
    """As ``text_blocks``, but a text longer than ``limit`` comes in pieces of about that size.

    With an ``overlap`` each piece but the last also has so many bytes of what follows. Without one, pieces end before
    white space, so no word is cut, and a word longer than ``limit`` makes a longer piece.
    """
    offsets, data = _offsets(column)
    for block in text_blocks(column, limit):
        if len(block.buf) <= limit:
            yield block
            continue
        at, end = int(offsets[block.first]), int(offsets[block.last])
        start = at
        while at < end:
            stop = _next_space(data, min(at + limit, end), end) if overlap is None else min(at + limit, end)
            reach = stop if overlap is None else min(stop + overlap, end)
            yield Block(block.first, block.last, data[at:reach], np.array([0, reach - at]), at - start, reach == end)
            at = stop if reach < end else end


def owners(bounds: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The document of each byte position."""
    return np.searchsorted(bounds, positions, "right") - 1


@lru_cache(1)
def _random_bytes() -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of an odd multiplier and of its inverse modulo 2**64, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        size = max((1 << 20) + 4096, int(n))
        made = []
        for base in (MULTIPLIER, pow(MULTIPLIER, -1, 2**64)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            made.append(np.cumprod(table, dtype=np.uint64))
        _powers[:] = made
    return _powers


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    out = x >> np.uint64(32)
    out ^= x
    out *= np.uint64(0xD6E8FEB86659FD93)
    half = out >> np.uint64(32)
    out ^= half
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= np.right_shift(out, np.uint64(32), out=half)
    return out


class SubstringHashes:
    """64-bit hashes of any substrings of a block, independent of where they stand."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        powers, self._inverse = _power_tables(n + 1)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_random_bytes()[buf] * powers[:n], out=self._sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self._sums[ends] - self._sums[starts]) * self._inverse[starts]
        return mix64(raw ^ ((ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))

    def windows(self, length: int) -> np.ndarray:
        """The hash of every substring of one length."""
        n = len(self._sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix64((self._sums[length:] - self._sums[:-length]) * self._inverse[:n])


@lru_cache(1)
def _word_bytes() -> np.ndarray:
    table = np.ones(256, bool)
    table[list(SPACES)] = False
    return table


def word_spans(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of all words, in order."""
    word = _word_bytes()[buf]
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, none
    before = np.zeros(len(buf), bool)
    before[1:] = word[:-1]
    before[bounds[:-1][bounds[:-1] < len(buf)]] = False
    after = np.zeros(len(buf), bool)
    after[:-1] = word[1:]
    after[bounds[1:][bounds[1:] > 0] - 1] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, owners(bounds, starts)


@lru_cache(1)
def lower_ascii() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def apart(docs: DataFrame, *needed: str) -> DataFrame:
    """``docs`` with all columns but the ``needed`` ones named by position, so that none clashes with a column that an operator makes."""
    return docs.toDF(*[c if c in needed else f"given_{i}" for i, c in enumerate(docs.columns)])

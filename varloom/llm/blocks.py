"""Vectorised work on blocks of texts inside a task: words, units and their distinct values.

A task's Arrow batches are gathered into blocks of bounded size; a single longer text is a block of
its own.  Texts are handled as one byte buffer with offsets, so no Python object exists per word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ASCII letters, and marks before which a letter run always ends in the tokenizers used here.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
MARK = np.zeros(256, bool)
MARK[[ord(c) for c in ".,;:!?"]] = True


def blocks(batches: Iterable[pa.RecordBatch], text: str, limit: int = 48 << 20, row: int = 64) -> Iterator[pa.Table]:
    """Tables of at most ``limit`` bytes of text, or one row, made of the task's batches; a row counts as
    ``row`` bytes more than its text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        at, n = 0, batch.num_rows
        if not n:
            continue
        ends = np.cumsum(_lengths(batch.column(batch.schema.get_field_index(text))) + row)
        while at < n:
            before = ends[at - 1] if at else 0
            to = int(np.searchsorted(ends, before + limit - size, "right"))
            if to <= at and held:
                yield pa.Table.from_batches(held)
                held, size = [], 0
                continue
            to = max(to, at + 1)
            held.append(batch.slice(at, to - at))
            size += int(ends[to - 1] - before)
            at = to
            if size >= limit or at < n:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _lengths(array: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64)


@dataclass
class Texts:
    """Texts in one buffer: text i is data[start[i]:start[i + 1]]."""

    data: np.ndarray
    start: np.ndarray

    @classmethod
    def of(cls, column: pa.ChunkedArray | pa.Array) -> Texts:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        column = column.cast(pa.large_binary()).fill_null(b"")
        raw = column.buffers()
        start = np.frombuffer(raw[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        data = np.frombuffer(raw[2], np.uint8)[start[0] : start[-1]] if raw[2] is not None and start[-1] > start[0] else np.zeros(0, np.uint8)
        return cls(data, start - start[0])

    def __len__(self) -> int:
        return len(self.start) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.start[i + 1]].tobytes()

    def count(self, mask: np.ndarray) -> np.ndarray:
        """For each text the number of its bytes where mask holds."""
        return np.diff(np.searchsorted(np.flatnonzero(mask), self.start))


@dataclass
class Tokens:
    """Byte strings of texts in order: those of text i are start[i]:start[i + 1]; each is distinct[code]."""

    code: np.ndarray
    start: np.ndarray
    distinct: pa.Array

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.start)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.start) - 1), self.counts)


def encoded(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Codes of the consecutive pieces data[bounds[i]:bounds[i + 1]], and the distinct pieces."""
    n = len(bounds) - 1
    if n <= 0:
        return np.zeros(0, np.int32), pa.array([], pa.binary())
    kind, width = (pa.binary(), np.int32) if len(data) < 2**31 - 1 else (pa.large_binary(), np.int64)
    array = pa.Array.from_buffers(kind, n, [None, pa.py_buffer(np.ascontiguousarray(bounds, width)), pa.py_buffer(np.ascontiguousarray(data))])
    out = array.dictionary_encode()
    return out.indices.to_numpy(zero_copy_only=False), out.dictionary


def words(texts: Texts, lower: bool, marks: bool = False) -> Tokens:
    """Maximal runs of bytes other than space and 9 to 13; A-Z made lower case if asked.

    With ``marks`` a run is cut before each mark that follows a letter.
    """
    data, start = texts.data, texts.start
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    if marks and len(data):
        edge[1:-1] = LETTER[data[:-1]] & MARK[data[1:]]
    edge[start] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    kept = data[solid]
    code, distinct = encoded(LOWER[kept] if lower else kept, np.concatenate([[0], np.cumsum(end - begin)]))
    return Tokens(code, np.searchsorted(begin, start), distinct)


def wide_space(data: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether the UTF-8 characters that end at ``last`` are white space beyond ASCII: U+0085, U+00A0, U+1680,
    U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F and U+3000."""
    c, b, a = data[last], data[np.maximum(last - 1, 0)], data[np.maximum(last - 2, 0)]
    two = (b == 0xC2) & ((c == 0x85) | (c == 0xA0))
    general = (b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    three = ((a == 0xE2) & (general | ((b == 0x81) & (c == 0x9F)))) | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    return two | three


def units(texts: Texts) -> Tokens:
    """Pieces that tokenizers never join: white space with the word after it, cut again before marks
    that follow a letter; white space is not cut within. Their concatenation is the text."""
    data, start = texts.data, texts.start
    cut = np.zeros(len(data) + 1, bool)
    if len(data):
        space = SPACE[data]
        cut[1:-1] = (~space[:-1] & space[1:]) | (LETTER[data[:-1]] & MARK[data[1:]])
        # A cut before a space comes after a byte beyond ASCII: that may be the end of white space too.
        beyond = 1 + np.flatnonzero((data[:-1] >= 0x80) & space[1:])
        cut[beyond[wide_space(data, beyond - 1)]] = False
    cut[start] = True
    bounds = np.flatnonzero(cut)
    code, distinct = encoded(data, bounds)
    return Tokens(code, np.searchsorted(bounds, start), distinct)


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indices start[i] .. start[i] + count[i] - 1, one range after another."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(total) - np.repeat(ends - count - start, count)

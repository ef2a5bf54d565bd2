"""Words of whole texts as 64-bit numbers, worked out in numpy straight on Arrow's UTF-8 buffers.

A word is a run of bytes other than `\\x20` and `\\x09-\\x0D`; those bytes never occur inside a multi-byte
UTF-8 character, so this equals the pattern `[^\\x20\\x09-\\x0D]+` on characters. A word's number is a
polynomial over its bytes modulo 2**64, mixed; equal words have equal numbers, and different words collide
with a probability of about 2**-64 per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 18  # text worked on at once: temporary arrays take about 100 bytes for each byte of it
PIECE_WORDS = 1 << 17  # and words of which windows are numbered at once
_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the information of every bit over all 64 bits, one to one."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # filled in each Python worker: one pair of tables per base


def _table(base: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """At least the first `count` powers of an odd base and of its inverse, modulo 2**64. A longer table takes the place of a shorter one."""
    if base not in _TABLES or len(_TABLES[base][0]) < count:
        size, out = 1 << max(12, int(count).bit_length()), []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[:1] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _TABLES[base] = tuple(out)
    return _TABLES[base]


def _bytes_table(lower: bool) -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    if lower:
        codes[65:91] += np.uint64(32)
    return mix(codes + np.uint64(0x1234567))


def _space_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
    return table


def _piece_words(data: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    space = _space_table()[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    forward, back = _table(_BASE, len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_bytes_table(lower)[data] * forward[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64)), starts, ends


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null has no bytes."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    if column.null_count:  # a null may still span bytes
        column = column.fill_null("")
        return text_buffers(column)
    return data, offsets


def word_runs(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For pieces of the column: the first row, the rows' word offsets and the numbers of all their words.

    Short rows share a piece of about PIECE_BYTES; a longer row is a piece of its own, hashed part by part.
    """
    data, offsets = text_buffers(column)
    rows, row = len(offsets) - 1, 0
    while row < rows:
        last = int(np.searchsorted(offsets, offsets[row] + PIECE_BYTES, "right")) - 1
        last = min(max(last, row + 1), rows)
        begin, end = int(offsets[row]), int(offsets[last])
        if end - begin <= PIECE_BYTES:
            # A space after each row keeps words of neighbouring rows apart.
            lengths = np.diff(offsets[row : last + 1])
            at = np.arange(begin, end) - begin + np.repeat(np.arange(last - row), lengths)
            padded = np.full(end - begin + (last - row), 0x20, np.uint8)
            padded[at] = data[begin:end]
            words, starts, _ = _piece_words(padded, lower)
            row_starts = offsets[row : last + 1] - begin + np.arange(last - row + 1)
            yield row, np.searchsorted(starts, row_starts), words
        else:
            words = np.concatenate([_piece_words(part, lower)[0] for part in parts_of(data[begin:end])])
            yield row, np.array([0, len(words)]), words
        row = last


def parts_of(data: np.ndarray) -> Iterator[np.ndarray]:
    """A text in parts of about PIECE_BYTES that end before white space."""
    begin = 0
    while begin < len(data):
        end, step = min(begin + PIECE_BYTES, len(data)), PIECE_BYTES
        while end < len(data) and not _space_table()[data[end]]:  # cut at the next space only
            ahead = np.flatnonzero(_space_table()[data[end : end + step]])
            end = end + int(ahead[0]) if len(ahead) else min(end + step, len(data))
        yield data[begin:end]
        begin = end


def joined_words(data: np.ndarray, stay: np.ndarray | None = None) -> Iterator[bytes]:
    """The words of a text joined by one space, part by part; with `stay` only those words that it marks."""
    at, between = 0, b""
    for part in parts_of(data):
        words = part.tobytes().split()  # bytes.split() cuts at \x20 and \x09-\x0D
        if stay is not None:
            at, words = at + len(words), [w for w, keep in zip(words, stay[at : at + len(words)]) if keep]
        if words:
            yield between + b" ".join(words)
            between = b" "


def sequence_number(words: np.ndarray) -> np.uint64:
    """A number of the whole sequence of words."""
    total, factor = len(words), 1
    forward, _ = _table(_WORD_BASE, min(len(words), PIECE_WORDS) + 1)
    for begin in range(0, len(words), PIECE_WORDS):
        own = words[begin : begin + PIECE_WORDS]
        total += int(np.sum(own * forward[: len(own)], dtype=np.uint64)) * factor
        factor = factor * pow(_WORD_BASE, PIECE_WORDS, 1 << 64) % (1 << 64)
    return mix(np.array([total % (1 << 64)], np.uint64))[0]


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """The number of the `size` words that begin at each word; empty if there are fewer."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    if size <= 8:
        total = np.zeros(len(words) - size + 1, np.uint64)
        for k in range(size):
            total = total * np.uint64(_WORD_BASE) + words[k : len(words) - size + 1 + k]
        return mix(total)
    out = np.empty(len(words) - size + 1, np.uint64)
    step = max(PIECE_WORDS, size)
    forward, back = _table(_WORD_BASE, min(len(words), step + size) + 1)
    for begin in range(0, len(out), step):
        own = words[begin : begin + step + size - 1]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(own * forward[: len(own)], dtype=np.uint64)))
        out[begin : begin + step] = mix((sums[size:] - sums[:-size]) * back[: len(own) - size + 1])
    return out

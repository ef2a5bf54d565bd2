"""Fill-in-middle training texts: two cuts at line ends, the parts in another order behind marker strings.

A text is a list of n lines `[^\\n]*\\n|[^\\n]+`. Both cuts are ranks among its n + 1 line borders, drawn from a hash of
the document's id, so that a recomputed task and any other run draw the same ones.

Method: an indexable skip list over the lines. A node of lane 0 is one line; a node of each higher lane, an express lane,
spans FAN nodes of the lane below. Each node carries its widths: how many lines, how many code points and how many bytes it
spans. A rank is reached from the top lane down: as long as the next node does not pass the rank, step over it and add up
its widths; then go down. At lane 0 the sum of lines is the rank, and the other two sums are the exact place of the
cut in code points and in bytes. That takes at most FAN - 1 steps a lane, whatever the length of the text, and no line
becomes an object of its own: lanes are numpy arrays worked out from the UTF-8 bytes.

Forms: `plain` (the text itself) if the text is empty, contains one of the markers or is not drawn; else `psm`
(prefix, suffix, middle) or `spm` (suffix, prefix, middle), each part behind its marker. As no text with a marker is
transformed, the first places of the markers in an output are the real ones, and `restore` gives the exact text back.

Rows: a null text is an empty one; a null id is drawn as an empty one; equal rows give equal results; an empty table gives an
empty result; other columns are not looked at. Everything is one pass over the rows without a shuffle. A very long text takes
about 25 bytes for each byte of a piece of PIECE bytes, and its lanes about 30 bytes for each line.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fleetpulse.llm.tables import columns

MARKERS = (b"<P>", b"<S>", b"<M>")  # fixed values of the output format
SEED = 7
FIM_PERCENT = 100
SPM_PERCENT = 50
FAN = 16
PIECE = 1 << 20
OUTPUT_BYTES = 8 << 20

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, restored string"


def line_widths(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """How many code points and how many bytes each line of the text has."""
    view, points, ends, carried = np.frombuffer(data, np.uint8), [], [], 0
    for begin in range(0, len(view), PIECE):
        piece = view[begin : begin + PIECE]
        leads = np.concatenate(([0], np.cumsum((piece & 0xC0) != 0x80)))
        breaks = np.flatnonzero(piece == 10) + 1
        ends.append(breaks + begin)
        points.append(leads[breaks] + carried)
        carried += int(leads[-1])
    last = int(ends[-1][-1]) if ends and len(ends[-1]) else max((int(e[-1]) for e in ends if len(e)), default=0)
    if last < len(view):
        ends.append(np.array([len(view)]))
        points.append(np.array([carried]))
    if not ends:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.diff(np.concatenate(points), prepend=0), np.diff(np.concatenate(ends), prepend=0)


class SkipList:
    """Lanes of nodes with their widths in lines, code points and bytes; the last lane has at most FAN nodes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, fan: int = FAN):
        self.fan = fan
        self.lanes = [(np.ones(len(points), np.int64), points, sizes)]
        while len(self.lanes[-1][0]) > fan:
            starts = np.arange(0, len(self.lanes[-1][0]), fan)
            self.lanes.append(tuple(np.add.reduceat(width, starts) for width in self.lanes[-1]))

    def place(self, rank: int) -> tuple[int, int]:
        """Code points and bytes of the first `rank` lines."""
        lines = points = sizes = node = 0
        for units, chars, octets in reversed(self.lanes):
            while node < len(units) and lines + units[node] <= rank:
                lines += int(units[node])
                points += int(chars[node])
                sizes += int(octets[node])
                node += 1
            node *= self.fan
        return points, sizes


@dataclass
class Draw:
    """The four numbers that decide about a document."""

    h1: int
    h2: int
    h3: int
    h4: int

    @classmethod
    def of(cls, doc_id: int | None, seed: int) -> Draw:
        digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        return cls(*(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)))


def transform(data: bytes, draw: Draw, fim_percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, bytes]:
    """Lines, form, code points of prefix and of middle, and the output."""
    points, sizes = line_widths(data)
    n = len(points)
    if not data or draw.h3 % 100 >= fim_percent or any(m in data for m in MARKERS):
        return n, "plain", None, None, data
    first, second = sorted((draw.h1 % (n + 1), draw.h2 % (n + 1)))
    lanes = SkipList(points, sizes)
    (chars, cut), (chars2, cut2) = lanes.place(first), lanes.place(second)
    prefix, middle, suffix = data[:cut], data[cut:cut2], data[cut2:]
    p, s, m = MARKERS
    if draw.h4 % 100 < spm_percent:
        return n, "spm", chars, chars2 - chars, b"".join((s, suffix, p, prefix, m, middle))
    return n, "psm", chars, chars2 - chars, b"".join((p, prefix, s, suffix, m, middle))


def restore(output: bytes, form: str) -> bytes:
    """The text that an output was made from."""
    if form == "plain":
        return output
    p, s, m = MARKERS
    one, two = (p, s) if form == "psm" else (s, p)
    split = output.index(two, len(one))
    last = output.index(m, split + len(two))
    parts = {one: output[len(one) : split], two: output[split + len(two) : last]}
    return parts[p] + output[last + len(m) :] + parts[s]


def rearrange(
    docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT
) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output and the text `restored` from it, for every document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64())]
            + [("middle_chars", pa.int64()), ("output", pa.string()), ("restored", pa.string())]
        )
        rows, size = [], 0
        for batch in batches:
            for doc_id, data in zip(batch.column("doc_id"), batch.column("text").cast(pa.large_binary())):
                own, text = doc_id.as_py(), data.as_py() or b""
                n, form, prefix, middle, output = transform(text, Draw.of(own, seed), fim_percent, spm_percent)
                rows.append((own, n, form, prefix, middle, output, restore(output, form)))
                size += 2 * len(text) + 64
                if size >= OUTPUT_BYTES:
                    yield _batch(rows, schema)
                    rows, size = [], 0
        if rows:
            yield _batch(rows, schema)

    return columns(docs, doc_id="long", text="string").mapInArrow(work, SCHEMA)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    arrays = [
        pa.array(values, pa.binary()).cast(pa.string()) if field.type == pa.string() and field.name != "form" else pa.array(values, field.type)
        for values, field in zip(zip(*rows), schema)
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)

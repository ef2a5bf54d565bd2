"""Token ids of a corpus in a compressed binary format, written and read by Spark.

Writing: documents lie in ranges of rising doc_id, each sorted. A task tokenizes its range, appends the end id to every document
and cuts the stream of ids in blocks of 1,024, whatever document they belong to; `mixing_coder` compresses them, many at a
time. A data set is a folder of Parquet files with one row per block, so that tasks which are run again replace their output and any
store that Spark writes to will do. A row has `shard` (the range) and `block`, `first` (ids of the shard before it), `n_ids`, `first_doc`
(how many documents of the shard end before it), for each document with ids in the block `doc_ids` and `lengths`, and `payload`,
the coded block, which can be checked and decoded alone.

Reading: blocks are decoded wherever their rows are read; a document that lies in several blocks comes as several fragments. Where each
document starts in the whole corpus follows from the numbers of ids per shard, which are added up in two levels.

Tokens: `Tokens` gives what the tokenizer gives for a whole text. Texts are cut, as bytes and many at a time, at places where the
pre-tokenizer parts them in any case (`_cuts`); Arrow numbers the distinct pieces, and only those that a task has not seen go to the tokenizer:
words of letters to its model, others joined by line breaks, whose id parts them again. That holds for byte-level tokenizers that cut by the
usual pattern, without prefix space or normalizer; for others, and around special tokens, whole texts (or the parts between) are given to the tokenizer.

Rows: a null text is empty and has the end id only; a null doc_id comes first; rows that share an id are put in order by a hash of their texts,
and equal rows give equal ids; an empty table gives an empty data set; other columns are not looked at. A very long text is tokenized in
parts of about PART bytes, cut at spaces between visible ASCII characters. A corrupt block raises an error.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.llm.mixing_coder import BLOCK, decode_blocks, encode_blocks
from fleetpulse.llm.tables import columns
from fleetpulse.plans.totals import running_totals
from fleetpulse.session import pinned

END = 0
AT_ONCE = 4096  # blocks that are coded together
READ_AT_ONCE = 5000  # about so many are decoded together; fewer cost more an id
PART = 1 << 23
KEPT = 600_000  # pieces that a task remembers
JOINED = 500
ROWS_PER_RANGE = 40_000  # every range meets the words of the corpus anew
LEAST_RANGES = 8

BLOCKS = (
    "shard int, block long, first long, n_ids int, first_doc long, doc_ids array<long>, lengths array<int>, payload binary"
)
FRAGMENTS = "shard int, doc long, doc_id long, first long, n_ids int, crc32 long, ids binary"

_SPACE = "\t-\r \x85\xa0  -     　"
_LINE = re.compile(f" ?[^{_SPACE}]+")  # without white space but one space before it: can stand between line breaks
_CUT = re.compile(rb"(?<=[!-~]) (?=[!-~])")

# Kinds of bytes, and what follows from a byte's and its next one's kind: to cut between them, or to look closer.
_BLANK, _BREAK, _LETTER, _OTHER, _HIGH = range(5)  # space, other white space, ASCII letter, other ASCII, part of a longer character
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[128:] = _HIGH
_KIND[[c for c in range(128) if chr(c).isalpha()]] = _LETTER
_KIND[[9, 10, 11, 12, 13]] = _BREAK
_KIND[32] = _BLANK
_ALWAYS, _IN_SPACE, _AFTER_BREAK, _AFTER_HIGH = 1, 2, 3, 4
_PAIR = np.zeros(64, np.uint8)
for _left, _right, _what in (
    (_LETTER, _BLANK, _ALWAYS),
    (_LETTER, _BREAK, _ALWAYS),
    (_OTHER, _BLANK, _ALWAYS),
    (_OTHER, _BREAK, _ALWAYS),
    (_LETTER, _OTHER, _ALWAYS),
    (_BLANK, _BLANK, _IN_SPACE),
    (_BLANK, _BREAK, _IN_SPACE),
    (_BREAK, _BLANK, _IN_SPACE),
    (_BREAK, _BREAK, _IN_SPACE),
    (_BREAK, _LETTER, _AFTER_BREAK),
    (_BREAK, _OTHER, _AFTER_BREAK),
    (_HIGH, _BLANK, _AFTER_HIGH),
    (_HIGH, _BREAK, _AFTER_HIGH),
    (_HIGH, _OTHER, _AFTER_HIGH),
):
    _PAIR[_left << 3 | _right] = _what


def _two_byte(low: int, high: int, but: tuple[int, ...] = ()) -> np.ndarray:
    """Which two-byte UTF-8 sequences, as numbers, are the code points from `low` to `high`."""
    out = np.zeros(1 << 16, np.bool_)
    for point in set(range(low, high + 1)).difference(but):
        first, second = chr(point).encode()
        out[first << 8 | second] = True
    return out


# Latin, Greek and Cyrillic letters, without code points among them that are none.
_LETTERS = _two_byte(0xC0, 0x24F, (0xD7, 0xF7)) | _two_byte(0x3B1, 0x3C9) | _two_byte(0x391, 0x3A9, (0x3A2,)) | _two_byte(0x400, 0x481)


def _byte_characters() -> str:
    """The characters that stand for bytes in the vocabulary of a byte-level tokenizer."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return "".join(chr(b) if b in shown else chr(next(hidden)) for b in range(256))


_CHARACTERS = _byte_characters()


def _cuts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where to cut UTF-8 texts, put together and each ending at one of `bounds`, so that the pieces have the tokens of the whole: rising
    places, the bounds and the begin among them.

    The usual pattern parts a letter from any ASCII character that is none, anything visible from white space after it, and the last of
    several white-space characters before something visible from those before, and if it is no space, from what follows.
    """
    size = len(data)
    kind = _KIND.take(data)
    pair = _PAIR.take(kind[:-1] << 3 | kind[1:])  # pair k is about a cut at k + 1
    cut = np.zeros(size + 1, np.bool_)
    cut[1:size] = pair == _ALWAYS
    at = np.flatnonzero(pair == _IN_SPACE) + 1
    if len(at):
        end = np.zeros(size + 1, np.bool_)
        end[bounds] = True
        at = at[at + 1 < size]
        follows = kind.take(at + 1)
        cut[at[((follows == _LETTER) | (follows == _OTHER)) & ~end.take(at + 1)]] = True
    at = np.flatnonzero(pair == _AFTER_BREAK) + 1
    cut[at[kind.take(np.maximum(at - 2, 0)) != _HIGH]] = True
    at = np.flatnonzero(pair == _AFTER_HIGH) + 1
    if len(at):
        last, mid, lead = (data.take(np.maximum(at - k, 0)).astype(np.int32) for k in (1, 2, 3))
        short = mid >= 0xC2  # the character before has two bytes
        letter = _LETTERS.take(mid << 8 | last)
        blank = np.where(
            short,
            (mid == 0xC2) & ((last == 0x85) | (last == 0xA0)),
            ((lead == 0xE1) & ((mid == 0x9A) | (mid == 0xA0)))
            | ((lead == 0xE2) & ((mid == 0x80) | (mid == 0x81)))
            | ((lead == 0xE3) & (mid == 0x80)),
        )
        cut[at[letter | ~blank & (kind.take(at) != _OTHER)]] = True
    cut[0] = True
    cut[bounds] = True
    return np.flatnonzero(cut)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Tokens:
    """Ids of whole texts; made in each task from the tokenizer's JSON."""

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        form = json.loads(source)
        cutter = form.get("pre_tokenizer") or {}
        plain = [not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in form["added_tokens"]]
        self.cuts = (
            cutter.get("type") == "ByteLevel"
            and cutter.get("use_regex", True)
            and not cutter.get("add_prefix_space")
            and not any(form.get(k) for k in ("normalizer", "truncation", "padding"))
            and all(plain)
        )
        self.special = {t["content"]: t["id"] for t in form["added_tokens"]}
        self.split = re.compile("(" + "|".join(re.escape(s) for s in self.special) + ")") if self.special else None
        self.marks = [s.encode() for s in self.special]
        self.forget()
        self.line = self._encode(["\n"])[0] if self.cuts else np.empty(0, np.uint32)
        self.cuts = self.cuts and len(self.line) == 1

    def forget(self) -> None:
        """Pieces are numbered as they come. The ids of piece k are the `sizes[k]` ones in `store` from `begins[k]` on."""
        self.known = pa.array([], pa.binary())
        self.begins, self.sizes = np.empty(0, np.int64), np.empty(0, np.int64)
        self.store = np.empty(0, np.uint32)
        self.again = np.empty(0, np.bool_)  # whether a piece has come again since it was learned or kept

    def _thin(self) -> None:
        """Forget the pieces that have not come again, most of them rare ones; all if that leaves more than half of KEPT."""
        keep = np.flatnonzero(self.again)
        sizes = self.sizes.take(keep)
        ends = np.cumsum(sizes)
        if 2 * len(keep) > KEPT or len(keep) and ends[-1] > 4 * KEPT:
            self.forget()
            return
        self.store = self.store.take(np.repeat(self.begins.take(keep) - ends + sizes, sizes) + np.arange(sizes.sum()))
        self.known, self.begins, self.sizes = self.known.take(pa.array(keep)), ends - sizes, sizes
        self.again = np.zeros(len(keep), np.bool_)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: pa.BinaryArray) -> None:
        count = len(pieces)
        pieces = pa.concat_arrays([pieces])  # without an offset
        ends = np.frombuffer(pieces.buffers()[1], np.int32)[: count + 1]
        data = np.frombuffer(pieces.buffers()[2], np.uint8)[: ends[-1]]
        # Words of letters alone, with or without a space before, are one token of the pre-tokenizer: they go to the model as they are.
        letter = _KIND.take(data) == _LETTER
        two = np.flatnonzero(_LETTERS.take(data[:-1].astype(np.int32) << 8 | data[1:]))
        letter[two] = letter[two + 1] = True
        spaced = data.take(ends[:-1]) == 32
        letters = np.append(0, np.cumsum(letter)).take(ends)
        plain = (np.diff(letters) == np.diff(ends) - spaced) & (np.diff(ends) > spaced)
        text, model = data.tobytes().decode("latin-1").translate(_CHARACTERS), self.tokenizer.model
        ids, sizes = [], np.zeros(count, np.int64)
        order = [np.flatnonzero(plain)]
        tokenize, places = model.tokenize, ends.tolist()
        found = [[t.id for t in tokenize(text[places[k] : places[k + 1]])] for k in order[0].tolist()]
        sizes[order[0]] = np.fromiter(map(len, found), np.int64, len(found))
        ids.append(np.fromiter(chain.from_iterable(found), np.uint32))
        raw, lines, alone = data.tobytes(), [], []
        for k in np.flatnonzero(~plain).tolist():
            own = raw[places[k] : places[k + 1]].decode()
            (lines if _LINE.fullmatch(own) else alone).append((k, own))
        for at in range(0, len(lines), JOINED):
            which, own = zip(*lines[at : at + JOINED])
            several = self._encode(["\n".join(own)])[0]
            between = several == self.line[0]
            stops = np.append(np.flatnonzero(between), len(several))
            if len(stops) != len(own):
                raise ValueError("the tokenizer does not part lines as a byte-level tokenizer does")
            order.append(np.array(which))
            sizes[order[-1]] = np.diff(stops, prepend=-1) - 1
            ids.append(several[~between])
        for (k, _), own in zip(alone, self._encode([own for _, own in alone])):
            order.append(np.array([k]))
            sizes[k] = len(own)
            ids.append(own)
        order = np.concatenate(order)
        begins = np.empty(count, np.int64)
        begins[order] = len(self.store) + np.cumsum(sizes[order]) - sizes[order]
        self.known = pa.concat_arrays([self.known, pieces])
        self.begins, self.sizes = np.append(self.begins, begins), np.append(self.sizes, sizes)
        self.again = np.append(self.again, np.zeros(count, np.bool_))
        self.store = np.concatenate((self.store, *ids))

    def _numbers(self, pieces: pa.BinaryArray) -> np.ndarray:
        found = pc.index_in(pieces, value_set=self.known)
        if len(self.known) and found.null_count and (len(self.known) + found.null_count > KEPT or len(self.store) > 8 * KEPT):
            self._thin()
            found = pc.index_in(pieces, value_set=self.known)
        if not found.null_count:
            numbers = found.to_numpy()
            self.again[numbers] = True
            return numbers
        fresh = found.is_null()
        count, numbers = len(self.known), found.fill_null(0).to_numpy().copy()
        new = fresh.to_numpy(zero_copy_only=False)
        self.again[numbers[~new]] = True
        self._learn(pieces.filter(fresh))
        numbers[new] = np.arange(count, len(self.known))
        return numbers

    def _cut(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts put together, which end at `bounds`, and how many each has. No special tokens."""
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(bounds), np.int64)
        cuts = _cuts(data, bounds)
        buffers = [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)]
        pieces = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, buffers).dictionary_encode()
        which = self._numbers(pieces.dictionary).take(pieces.indices.to_numpy())
        begins, sizes = self.begins.take(which), self.sizes.take(which)
        ends = np.cumsum(sizes)
        ids = self.store.take(np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1]))
        before = np.append(0, ends).take(np.searchsorted(cuts, bounds))
        return ids, np.diff(before, prepend=0)

    def _whole(self, text: bytes) -> np.ndarray:
        """The ids of one text, around special tokens and in parts if it is long."""
        if any(m in text for m in self.marks):
            out = []
            for part in self.split.split(text.decode()):
                if part in self.special:
                    out.append(np.array([self.special[part]], np.uint32))
                else:
                    out.append(self._whole(part.encode()))
            return np.concatenate(out)
        data, out, begin = np.frombuffer(text, np.uint8), [], 0
        while begin < len(text):
            cut = _CUT.search(text, begin + PART)
            end = cut.start() if cut else len(text)
            out.append(self._cut(data[begin:end], np.array([end - begin]))[0])
            begin = end
        return np.concatenate(out) if out else np.empty(0, np.uint32)

    def encoded(self, texts: pa.StringArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of all texts in turn and how many each has, for texts of about PART bytes at once. A null text is empty."""
        if not self.cuts:
            for at in range(0, len(texts), 64):  # texts become Python's a few at a time
                own = self._encode([t or "" for t in texts.slice(at, 64).to_pylist()])
                yield np.concatenate(own), np.array([len(ids) for ids in own], np.int64)
            return
        plain = texts.cast(pa.large_string()).fill_null("")
        _, places, data = plain.buffers()
        ends = np.frombuffer(places, np.int64)[plain.offset : plain.offset + len(plain) + 1]
        data = np.frombuffer(data, np.uint8) if data and ends[-1] else np.empty(0, np.uint8)
        at = 0
        while at < len(plain):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + PART, "right")) - 1)
            own = data[ends[at] : ends[to]]
            text = own.tobytes() if to == at + 1 or self.marks else b""
            if to == at + 1:
                ids = self._whole(text)
                yield ids, np.array([len(ids)], np.int64)
            elif any(m in text for m in self.marks):
                several = [self._whole(data[ends[k] : ends[k + 1]].tobytes()) for k in range(at, to)]
                yield np.concatenate(several), np.array([len(ids) for ids in several], np.int64)
            else:
                yield self._cut(own, ends[at + 1 : to + 1] - ends[at])
            at = to

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, as unsigned 32-bit numbers."""
        for ids, counts in self.encoded(pa.array(texts, pa.string())):
            for own in np.split(ids, np.cumsum(counts)[:-1]):
                yield own.tobytes()


class _Stream:
    """Blocks of one shard, filled with documents."""

    def __init__(self, shard: int, end: int):
        self.shard, self.end, self.block, self.first, self.docs = shard, end, 0, 0, 0
        # What no block has yet: ids, and doc_ids and numbers of ids of documents (`docs` documents have ended before).
        self.ids: list[np.ndarray] = []
        self.doc_ids: list[pa.Array] = []
        self.lengths: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        """Documents with their ids, to which the end id is added."""
        ends = np.cumsum(counts + 1)
        whole = np.full(int(ends[-1]), self.end, np.uint32)
        inside = np.ones(len(whole), np.bool_)
        inside[ends - 1] = False
        whole[inside] = ids
        self.ids.append(whole)
        self.doc_ids.append(doc_ids)
        self.lengths.append(counts + 1)
        self.size += len(whole)

    def rows(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        """Rows of AT_ONCE blocks each, as long as there are enough ids, and in the end of all that is left."""
        if not self.size or not last and self.size < AT_ONCE * BLOCK:
            return
        ids, ends = np.concatenate(self.ids), np.cumsum(np.concatenate(self.lengths))
        doc_ids = pa.concat_arrays(self.doc_ids)
        done, passed = 0, 0
        while len(ids) - done >= AT_ONCE * BLOCK or last and done < len(ids):
            used = min(done + AT_ONCE * BLOCK, len(ids))
            begins = np.arange(done, used, BLOCK)
            to = int(np.searchsorted(ends, used))
            cuts = np.union1d(begins, ends[passed:to])
            which = np.searchsorted(ends, cuts, "right")
            parts = np.append(np.searchsorted(cuts, begins), len(cuts)).astype(np.int32)
            columns_ = [
                pa.array(np.full(len(begins), self.shard, np.int32)),
                pa.array(self.block + np.arange(len(begins))),
                pa.array(self.first + begins),
                pa.array(np.diff(np.append(begins, used)).astype(np.int32)),
                pa.array(self.docs + which.take(parts[:-1])),
                pa.ListArray.from_arrays(pa.array(parts), doc_ids.take(pa.array(which))),
                pa.ListArray.from_arrays(pa.array(parts), pa.array(np.diff(np.append(cuts, used)).astype(np.int32))),
                pa.array(encode_blocks([ids[b : min(b + BLOCK, used)] for b in begins.tolist()]), pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns_, names=[f.split()[0] for f in BLOCKS.split(", ")])
            self.block += len(begins)
            done, passed = used, int(np.searchsorted(ends, used, "right"))
        self.first += done
        self.docs += passed
        self.ids, self.size = [ids[done:]], len(ids) - done
        self.doc_ids = [doc_ids.slice(passed)]
        self.lengths = [np.diff(ends[passed:], prepend=done)]


def coded_blocks(docs: DataFrame, source: str, end: int = END) -> DataFrame:
    """The rows of a data set: the ids of all documents, in rising order of doc_id, in coded blocks."""
    rows = columns(docs, doc_id="long", text="string")
    ranges = LEAST_RANGES + rows.count() // ROWS_PER_RANGE
    # The last key only parts rows that are equal so far, so that even these can lie in several ranges.
    keyed = rows.withColumn("tie", F.xxhash64("text")).withColumn("apart", F.monotonically_increasing_id())
    keys = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("apart")]
    ranged = keyed.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).select("doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, stream = Tokens(source), _Stream(TaskContext.get().partitionId(), end)
        for batch in batches:
            at = 0
            for ids, counts in tokens.encoded(batch.column("text")):
                stream.add(batch.column("doc_id").slice(at, len(counts)), ids, counts)
                at += len(counts)
                yield from stream.rows()
        yield from stream.rows(last=True)

    return ranged.mapInArrow(work, BLOCKS)


def write(docs: DataFrame, path: str, tokenizer: str, end: int = END) -> None:
    """Write the data set of all documents to the folder `path`. `tokenizer` is the path of a tokenizer's JSON file."""
    with open(tokenizer, encoding="utf-8") as file:
        source = file.read()
    coded_blocks(docs, source, end).write.mode("overwrite").parquet(path)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `rows`, at most half as many again."""
    waiting: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        waiting.append(batch)
        count += batch.num_rows
        while count >= 2 * rows:
            whole = pa.concat_batches(waiting)
            yield whole.slice(0, rows)
            waiting, count = [whole.slice(rows)], count - rows
    if count:
        whole, parts = pa.concat_batches(waiting), max(1, round(count / rows))
        for begin, end in pairwise(count * k // parts for k in range(parts + 1)):
            yield whole.slice(begin, end - begin)


def read_fragments(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Parts of documents, one row for each block that a document has ids in: place of the document in the shard (`doc`), doc_id,
    place of the first id in the shard, number and CRC-32 of the ids, and the ids as unsigned 32-bit numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _gathered(batches, READ_AT_ONCE):
            decoded = decode_blocks(part.column("payload").to_pylist())
            data = np.concatenate(decoded).astype("<u4", copy=False)
            lists, lengths = part.column("doc_ids"), part.column("lengths").flatten().to_numpy()
            counts = part.column("lengths").value_lengths().to_numpy()
            row = np.repeat(np.arange(part.num_rows), counts)
            ends = np.cumsum(lengths, dtype=np.int64)
            begins = ends - lengths
            heads = np.cumsum(counts) - counts  # the first fragment of each block
            view = memoryview(data).cast("B")
            sums = [zlib.crc32(view[b:e]) for b, e in zip((4 * begins).tolist(), (4 * ends).tolist())]
            if with_ids:
                places = pa.py_buffer(np.append(0, 4 * ends).astype(np.int32))
                ids = pa.Array.from_buffers(pa.binary(), len(row), [None, places, pa.py_buffer(data)])
            else:
                ids = pa.nulls(len(row), pa.binary())
            arrays = [
                part.column("shard").take(pa.array(row)),
                pa.array(part.column("first_doc").to_numpy()[row] + np.arange(len(row)) - heads[row]),
                lists.flatten(),
                pa.array(part.column("first").to_numpy()[row] + begins - begins[heads][row]),
                pa.array(lengths.astype(np.int32)),
                pa.array(sums, pa.int64()),
                ids,
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in FRAGMENTS.split(", ")])

    blocks = spark.read.schema(BLOCKS).parquet(path)
    return blocks.mapInArrow(work, FRAGMENTS)


def _shard_starts(spark: SparkSession, path: str) -> DataFrame:
    sizes = spark.read.schema(BLOCKS).parquet(path).groupBy("shard").agg(F.sum("n_ids").alias("n"))
    totals = running_totals(pinned(sizes), "shard", ["n"], buckets=1)
    return totals.select("shard", (F.col("cum_n") - F.col("n")).alias("shift"))


def _zero_shifts() -> np.ndarray:
    """Row k: what each of the 32 bits of a CRC becomes when 2**k zero bytes follow."""
    one = np.empty(32, np.uint32)
    for bit in range(32):  # one zero byte: eight steps of the reflected polynomial
        value = 1 << bit
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        one[bit] = value
    rows = [one]
    for _ in range(63):
        rows.append(_apply(rows[-1], rows[-1]))
    return np.stack(rows)


def _apply(matrix: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros_like(values)
    for bit in range(32):
        out ^= np.where(values >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


def joined_crcs(crcs: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The CRC-32 of each whole from the CRC-32 and the sizes in bytes of its parts, all in order. The parts of the wholes, at least one
    each, begin at `starts`. As the CRC of a whole is that of each part, shifted by the bytes that follow it, added up, all are worked on at once."""
    values, ends = crcs.astype(np.uint32), np.cumsum(sizes)
    counts = np.diff(np.append(starts, len(values)))
    after = np.repeat(ends[starts + counts - 1], counts) - ends
    for k in range(int(after.max(initial=0)).bit_length()):
        moved = np.flatnonzero(after >> k & 1)
        values[moved] = _apply(_SHIFTS[k], values[moved])
    return np.bitwise_xor.reduceat(values, starts) if len(starts) else values


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """The CRC-32 of parts put together, from the CRC-32 and the length in bytes of each."""
    crcs, sizes = zip(*parts)
    return int(joined_crcs(np.array(crcs), np.array(sizes, np.int64), np.zeros(1, np.int64))[0])


_SHIFTS = _zero_shifts()


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens (the end id included), and the CRC-32 of the ids of each document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("parts")
            counts = lists.value_lengths().to_numpy().astype(np.int64)
            _, n_ids, crcs = (c.to_numpy() for c in lists.flatten().flatten())
            sums = joined_crcs(crcs, 4 * n_ids.astype(np.int64), np.cumsum(counts) - counts).astype(np.int64)
            arrays = [batch.column(c) for c in ("doc_id", "start", "n_tokens")] + [pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    whole = read_fragments(spark, path, with_ids=False).groupBy("shard", "doc").agg(
        F.max("doc_id").alias("doc_id"),
        F.min("first").alias("first"),
        F.sum("n_ids").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("first", "n_ids", "crc32"))).alias("parts"),
    )
    placed = whole.join(_shard_starts(spark, path), "shard")
    return placed.select("doc_id", (F.col("first") + F.col("shift")).alias("start"), "n_tokens", "parts").mapInArrow(
        work, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )

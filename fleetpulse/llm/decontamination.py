"""Documents that contain a benchmark item, give or take some words: CGK embedding, bit-sampling LSH, exact check.

A document is contaminated by an item of n words if n consecutive words of it are within an edit distance (insert,
delete, replace a word) of floor(n * EDITS) of the item. Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased.

1. Gate, which loses nothing: a window so close to an item keeps at least n - e of its words and n - 1 - 2e of its
   word pairs, so windows with fewer words or pairs that occur in any item cannot match one of that length. The words
   and pairs of the items are a table of bits, and a window's count is a difference of running sums.
2. CGK (Chakraborty, Goldenberg, Koucky, 2016): random walks copy the words of a window, as long as the item, to a string of
   2n places; at each step a bit that depends on step and word says whether the walk moves on. Strings of texts at a small
   edit distance agree in many places.
3. Bit sampling: each walk's string is read at some random places, and equal readings make a window and an item of that
   length a candidate pair. How many walks are taken, and how many places are read, follows from the length: `sampling`
   measures on random texts with the allowed number of edits in how many places two strings agree, and takes as many walks as
   bring the chance to meet to RECALL. Long items, whose strings agree less, are read at fewer places by more walks.
4. Candidates are checked by their exact edit distance, so only candidates can be missed, never wrong ones reported.

Items are read in blocks of some ITEM_WORDS words by the hash of their ids; each block's tables are broadcast (bounded
by that number) and each block is one pass over the documents, without any shuffle but that of the findings.

Rows: null texts and ids take no part, nor does an item without words; items with one id are separate texts under one
name; equal rows give one finding; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.tables import arrow_map, columns
from fleetpulse.llm.words import mix, windows, word_runs
from fleetpulse.session import pinned

EDITS = 0.15
RECALL = 0.995  # chance to find a text at the allowed number of edits
WALKS = 96  # more than so many walks are taken only where reading a single place needs them
TRIALS, TRIED = 64, 16  # texts and walks by which agreement is measured
ITEM_WORDS = 500_000
BITS = 22
HELD = 16384  # windows of one length that a task looks up at once


@dataclass(frozen=True)
class Sampling:
    """Of texts of n words: for each walk an odd multiplier per step, whose top bit moves the walk on, and the steps that are read."""

    salts: np.ndarray
    read: np.ndarray


def _salts(n: int, walks: int) -> np.ndarray:
    """Multipliers of the first walks; more walks only add to them."""
    rng = [np.random.default_rng((20160619, n, walk)) for walk in range(walks)]
    return np.stack([r.integers(0, 1 << 63, 2 * n, np.uint64) for r in rng]) * np.uint64(2) + np.uint64(1)


def cgk_strings(texts: np.ndarray, salts: np.ndarray) -> Iterator[np.ndarray]:
    """Step by step the words that the walks stand on: walks x rows of `texts`. A walk that has left its text stands on 0."""
    rows, n = texts.shape
    ended = np.concatenate((texts, np.zeros((rows, n), np.uint64)), axis=1).ravel()  # a walk stays within 2n places
    base, at = np.arange(rows) * 2 * n, np.zeros((len(salts), rows), np.int64)
    for step in range(2 * n):
        word = ended[base + at]
        yield word
        at += ((word * salts[:, step, None]) >> np.uint64(63)).astype(np.int64)


def _edited(text: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """The text after so many edits, as long as before."""
    words, fresh = text.tolist(), rng.integers(1, 1 << 62, 2 * len(text) + edits + 1).tolist()
    for _ in range(edits):
        at = int(rng.integers(len(words))) if words else 0
        words[at : at + 1] = [[], [fresh.pop()], [*words[at : at + 1], fresh.pop()]][int(rng.integers(3))]
    return np.array((words + fresh)[: len(text)], np.uint64)


@cache
def agreement(n: int, edits: int) -> np.ndarray:
    """The share of places in which the strings of a random text and of its edited form agree: trials x walks."""
    rng = np.random.default_rng((n, edits))
    texts = rng.integers(1, 1 << 62, (TRIALS, n)).astype(np.uint64)
    others = np.stack([_edited(t, edits, rng) for t in texts])
    salts = _salts(n, TRIED)
    same = sum((x == y).astype(np.int32) for x, y in zip(cgk_strings(texts, salts), cgk_strings(others, salts)))
    return same.T / (2 * n)


def sampling(n: int, edits: int, items: int) -> Sampling:
    """How to read texts of n words so that, of those at the allowed number of edits, the share RECALL meets its item.

    Reading more places parts unrelated texts better, which matters where many `items` have that length, and takes more walks.
    """
    agree = agreement(n, edits)
    places, walks = len(str(max(1, items))) + 1, 1
    while places:
        met = np.maximum((agree**places).mean(axis=1), 1e-6)  # the chance of each trial to meet in a walk
        walks = 1
        while (1 - (1 - met) ** walks).mean() < RECALL and walks < 4096:
            walks += 1 + walks // 16
        if walks <= WALKS or places == 1:
            break
        places -= 1
    read = np.zeros((walks, 2 * n), bool)
    for walk, own in enumerate(read):
        own[np.random.default_rng((17, n, walk)).choice(2 * n, min(places, 2 * n), replace=False)] = True
    return Sampling(_salts(n, walks), read)


def cgk_readings(texts: np.ndarray, how: Sampling) -> np.ndarray:
    """The number that each walk reads of each row of `texts`: walks x rows."""
    reading = np.zeros((len(how.salts), len(texts)), np.uint64)
    last = int(how.read.any(axis=0).nonzero()[0].max())
    for step, word in enumerate(cgk_strings(texts, how.salts)):
        own = np.flatnonzero(how.read[:, step])
        if len(own):
            reading[own] = mix(reading[own] * np.uint64(0x9E3779B97F4A7C15) + word[own])
        if step == last:
            break
    return reading


def edit_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edit distances of the rows of `a` and `b`."""
    rows, n = a.shape
    before = np.tile(np.arange(b.shape[1] + 1), (rows, 1))
    for i in range(n):
        now = np.empty_like(before)
        now[:, 0] = i + 1
        swap = before[:, :-1] + (a[:, i : i + 1] != b)
        open_ = np.minimum(swap, before[:, 1:] + 1)
        # now[j] = min(open[j], now[j - 1] + 1), solved as a running minimum of open[j] - j
        steps = np.arange(1, b.shape[1] + 1)
        now[:, 1:] = np.minimum(np.minimum.accumulate(open_ - steps, axis=1), i + 1) + steps
        before = now
    return before[:, -1]


def _bit(numbers: np.ndarray) -> np.ndarray:
    return (numbers >> np.uint64(64 - BITS)).astype(np.int64)


def _sorted(readings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Readings of the items by one walk, in order, and whose they are."""
    order = np.argsort(readings, kind="stable")
    return readings[order], order


def item_tables(ids: list[int], texts: list[str], edits: float = EDITS) -> dict:
    """Of one block of items: bits of words and word pairs; by length the ids, words, sampling and sorted readings."""
    some_words, some_pairs = np.zeros(1 << BITS, bool), np.zeros(1 << BITS, bool)
    grouped: dict[int, tuple[list[int], list[np.ndarray]]] = {}
    for row, offsets, numbers in word_runs(pa.array(texts, pa.string()), lower=True):
        for k in range(len(offsets) - 1):
            own = numbers[offsets[k] : offsets[k + 1]]
            if len(own):
                some_words[_bit(own)] = True
                some_pairs[_bit(windows(own, 2))] = True
                group = grouped.setdefault(len(own), ([], []))
                group[0].append(ids[row + k])
                group[1].append(own)
    by_length = {}
    for n, (names, rows) in sorted(grouped.items()):
        table, how = np.stack(rows), sampling(n, int(n * edits), len(rows))
        by_length[n] = (np.array(names, np.int64), table, how, [_sorted(r) for r in cgk_readings(table, how)])
    return {"edits": edits, "words": some_words, "pairs": some_pairs, "by_length": by_length}


def gated(items: dict, words: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each item length: text, first word and words of the windows that pass the gate.

    `words` are the words of several texts, one after the other; `offsets` says where each begins.
    """
    known = np.concatenate(([0], np.cumsum(items["words"][_bit(words)], dtype=np.int32)))
    paired = np.concatenate(([0], np.cumsum(items["pairs"][_bit(windows(words, 2))], dtype=np.int32)))
    for n in items["by_length"]:
        if len(words) < n:
            break
        slack = int(n * items["edits"])
        enough = known[n:] - known[:-n] >= n - slack
        if n > 1:
            enough &= paired[n - 1 :] - paired[: len(paired) - n + 1] >= n - 1 - 2 * slack
        starts = np.flatnonzero(enough)
        text = np.searchsorted(offsets, starts, "right") - 1
        inside = starts + n <= offsets[text + 1]
        starts, text = starts[inside], text[inside]
        for at in range(0, len(starts), 4096):
            own = starts[at : at + 4096]
            yield n, text[at : at + 4096], own - offsets[text[at : at + 4096]], words[own[:, None] + np.arange(n)]


def matched(items: dict, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, item and edit distance of the windows (rows of n words) that match an item."""
    n = texts.shape[1]
    names, table, how, readings = items["by_length"][n]
    edits = int(n * items["edits"])
    step = max(1, (1 << 19) // (n * max(1, len(readings) // 8)))
    # Windows with equal words are looked up once.
    whole = mix(texts * np.arange(1, 2 * n, 2, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    _, first, which = np.unique(whole, return_index=True, return_inverse=True)
    found = [np.empty((3, 0), np.int64)]
    for part in range(0, len(first), step):
        own = texts[first[part : part + step]]
        met = [np.empty(0, np.int64)]
        for (numbers, order), reading in zip(readings, cgk_readings(own, how)):
            low, high = np.searchsorted(numbers, reading, "left"), np.searchsorted(numbers, reading, "right")
            # Runs of windows that meet some 2**20 items together.
            ends = np.cumsum(high - low)
            cuts = np.searchsorted(ends, np.arange(1 << 20, int(ends[-1]) if len(ends) else 0, 1 << 20), "left")
            for run in np.split(np.arange(len(own)), np.unique(cuts)):
                many = high[run] - low[run]
                hit = np.repeat(low[run], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                met.append(np.unique(np.repeat(run, many) * len(names) + order[hit]))
        pairs = np.unique(np.concatenate(met))
        for begin in range(0, len(pairs), 4096):
            w, item = pairs[begin : begin + 4096] // len(names), pairs[begin : begin + 4096] % len(names)
            far = edit_distances(own[w], table[item])
            near = far <= edits
            found.append(np.stack((w[near] + part, item[near], far[near])))
    window, item, far = np.concatenate(found, axis=1)
    order = np.argsort(which, kind="stable")
    low, high = np.searchsorted(which[order], window, "left"), np.searchsorted(which[order], window, "right")
    of = np.repeat(np.arange(len(window)), high - low)
    rows = order[np.repeat(low, high - low) + np.arange(len(of)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)]
    return rows, names[item[of]], far[of]


def contaminations(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """doc_id, item_id, distance, first_word, n_words: for each pair the closest window (ties: the first, shortest)."""
    spark = docs.sparkSession
    texts = columns(docs, doc_id="long", text="string").where("doc_id is not null and text is not null")
    items = columns(benchmark, item_id="long", text="string").where("item_id is not null and text is not null")
    items = pinned(items.distinct())
    total = items.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0  # no text has more words
    blocks = max(1, -(-int(total) // ITEM_WORDS))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    schema = "doc_id long, item_id long, distance long, first_word long, n_words long"
    names = ["doc_id", "item_id", "distance", "first_word", "n_words"]
    found = None
    for k in range(blocks):
        own = items.where(block == k).orderBy("item_id", "text").collect()  # some ITEM_WORDS words
        sent = spark.sparkContext.broadcast(item_tables([r["item_id"] for r in own], [r["text"] for r in own], edits))

        def work(batch: pa.RecordBatch, sent=sent) -> Iterator[pa.RecordBatch]:
            ids = batch.column("doc_id").to_numpy()
            held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

            def looked_up(n: int) -> pa.RecordBatch:
                row, start, texts_ = (np.concatenate(x) for x in zip(*held.pop(n)))
                window, item, far = matched(sent.value, texts_)
                parts = [ids[row[window]], item, far, start[window], np.full(len(window), n)]
                return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in parts], names=names)

            for row, offsets, numbers in word_runs(batch.column("text"), lower=True):
                for n, text, start, texts_ in gated(sent.value, numbers, offsets):
                    held.setdefault(n, []).append((text + row, start, texts_))
                    if sum(len(x[0]) for x in held[n]) > HELD:
                        yield looked_up(n)
            for n in list(held):
                yield looked_up(n)

        part = arrow_map(texts, work, schema)
        found = part if found is None else found.unionByName(part)
    least = F.min(F.struct("distance", "first_word", "n_words")).alias("m")
    return found.groupBy("doc_id", "item_id").agg(least).select("doc_id", "item_id", "m.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the rows that contain an item, each judged by its own text; rows without an id stay. Items without
    an id are searched too."""
    number = F.xxhash64(F.col("text").cast("string"))
    own = F.when(F.col("doc_id").isNotNull() & F.col("text").isNotNull(), number)
    items = columns(benchmark, item_id="long", text="string").withColumn("item_id", F.coalesce("item_id", number))
    bad = pinned(contaminations(docs.select(own.alias("doc_id"), "text"), items).select(F.col("doc_id").alias("__bad")).distinct())
    return docs.withColumn("__own", own).join(bad, F.col("__own") == F.col("__bad"), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])

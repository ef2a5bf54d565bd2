"""Removal of passages that repeat across documents, by windows that grow twofold.

A window is `window` consecutive words of one document. A word goes if a window that covers it also starts in
a document with a smaller id; windows are judged on the input, not on what is left.

Method, level by level, from half the length to the whole:

1. Whole documents with equal words form a group; only the one with the smallest id goes on, since each window
   of the others also starts there.
2. Half-length windows. Of the half-length windows inside each full window the one with the smallest number is
   its anchor, so equal full windows have equal anchors, and neighbouring windows mostly share theirs (about
   one word in 13 starts an anchor at 50 words). Anchors that occur in documents with different words survive.
3. Only full windows with a surviving anchor are worked out, in the few documents that have such an anchor, and
   compared by number. The smallest document id with a window owns it.

At full length the search ends: a longer repeated passage consists of repeated windows of this length. Windows
are compared by 64-bit numbers (two documents as wholes by 128 bits).

Nothing is gathered by passage: all groupings are sums or minima that combine before the shuffle, or joins of
stored tables that adaptive execution splits. Texts move once, and only documents with a surviving anchor are kept.
Tables between the steps are written to the shared folder.

Rows: a null text has no words; a null id can neither own nor lose a window; rows with one id do not take from
one another, and rows that are equal give equal results. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.tables import arrow_map, columns, list_array, longs
from fleetpulse.llm.words import joined_words, mix, sequence_number, text_buffers, windows, word_runs
from fleetpulse.session import pinned, short_lived, unpinned

WINDOW = 50

_PRINTS = "doc_id long, n_words long, s1 long, s2 long, sha string, anchors array<long>"


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """The smallest of each `span` consecutive values."""
    out, size = values, 1
    while size < span:
        step = min(size, span - size)
        out = np.minimum(out[: len(out) - step], out[step:])
        size += step
    return out


def _anchors(words: np.ndarray, window: int) -> np.ndarray:
    """The anchor of the window at each word; empty if the text is shorter than a window."""
    half = max(1, window // 2)
    return _least(windows(words, half), window - half + 1) if len(words) >= window else np.empty(0, np.uint64)


def _sha(data: np.ndarray, stay: np.ndarray | None = None) -> str:
    """SHA-256 of the words (those that stay) joined by a space."""
    digest = hashlib.sha256()
    for part in joined_words(data, stay):
        digest.update(part)
    return digest.hexdigest()


def _whole(words: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Two numbers that tell a sequence of words."""
    return sequence_number(words), sequence_number(mix(words))


def fingerprints(docs: DataFrame, window: int) -> DataFrame:
    """For each document its number of words, two numbers and the SHA-256 of its words, and its anchors."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, at = text_buffers(batch.column("text"))
        for row, offsets, words in word_runs(batch.column("text")):
            counts, wholes, shas, anchors = [], [], [], []
            for k in range(len(offsets) - 1):
                own = words[offsets[k] : offsets[k + 1]]
                counts.append(len(own))
                wholes.append(_whole(own))
                shas.append(_sha(data[at[row + k] : at[row + k + 1]]))
                anchors.append(np.unique(_anchors(own, window)))
            first, second = np.array(wholes, np.uint64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(row, len(counts)),
                    pa.array(counts, pa.int64()),
                    longs(np.ascontiguousarray(first)),
                    longs(np.ascontiguousarray(second)),
                    pa.array(shas, pa.string()),
                    list_array(anchors, pa.int64()),
                ],
                names=["doc_id", "n_words", "s1", "s2", "sha", "anchors"],
            )

    return arrow_map(docs, work, _PRINTS)


def _candidates(texts: DataFrame, window: int) -> DataFrame:
    """Numbers of the full windows whose anchor is in the row's `anchors`, each once per document."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known, ids = batch.column("anchors"), batch.column("doc_id").to_numpy(zero_copy_only=False)
        for row, offsets, words in word_runs(batch.column("text")):
            found, owner = [], []
            for k in range(len(offsets) - 1):
                own = words[offsets[k] : offsets[k + 1]]
                live = known[row + k].values.to_numpy(zero_copy_only=False).view(np.uint64)
                full = windows(own, window)[np.isin(_anchors(own, window), live)] if len(own) >= window else own[:0]
                found.append(np.unique(full))
                owner.append(np.full(len(found[-1]), ids[row + k], np.int64))
            yield pa.RecordBatch.from_arrays(
                [longs(np.concatenate(found)), longs(np.concatenate(owner))], names=["h", "doc_id"]
            )

    return arrow_map(texts, work, "h long, doc_id long")


class Repeats:
    """What the search found, as stored tables.

    `prints`: one row per document; `leads`: the smallest id for each sequence of words; `texts`: id and text of
    the documents that may lose words; `lost`: for each id the numbers of windows that a smaller id owns.
    """

    def __init__(self, docs: DataFrame, window: int = WINDOW):
        self.window = window
        with short_lived(docs.sparkSession) as keep:
            self._search(columns(docs, doc_id="long", text="string"), keep)

    def _search(self, texts: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> None:
        window = self.window
        self.prints = keep(pinned(fingerprints(texts, window)))
        named = self.prints.where(F.col("doc_id").isNotNull())
        self.leads = keep(pinned(named.groupBy("s1", "s2").agg(F.min("doc_id").alias("lead"))))

        anchors = named.select("doc_id", "s1", F.explode("anchors").alias("h"))
        shared = pinned(
            anchors.groupBy("h").agg(F.min("s1").alias("a"), F.max("s1").alias("b")).where("a < b").select("h")
        )
        leaders = self.leads.select(F.col("lead").alias("doc_id"))
        live = (
            anchors.select("h", "doc_id")
            .join(shared, "h", "left_semi")
            .join(leaders, "doc_id", "left_semi")
            .groupBy("doc_id")
            .agg(F.collect_set("h").alias("anchors"))
        )
        live = pinned(live)
        unpinned(shared)
        self.texts = keep(pinned(texts.join(live, "doc_id")))
        unpinned(live)

        found = pinned(_candidates(self.texts, window))
        owners = pinned(
            found.groupBy("h").agg(F.min("doc_id").alias("own"), F.max("doc_id").alias("last")).where("own < last")
        )
        lost = found.join(owners.select("h", "own"), "h").where(F.col("doc_id") > F.col("own"))
        self.lost = keep(pinned(lost.groupBy("doc_id").agg(F.collect_set("h").alias("gone"))))


def _kept(words: np.ndarray, gone: np.ndarray, window: int) -> np.ndarray:
    """Which words no window in `gone` covers."""
    starts = np.flatnonzero(np.isin(windows(words, window), gone))
    steps = np.zeros(len(words) + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + window, -1)
    return np.cumsum(steps[:-1]) == 0


def _cut(batch: pa.RecordBatch, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row, bytes and a mark for each word that stays, for the rows that lose words."""
    data, at = text_buffers(batch.column("text"))
    gone = batch.column("gone")
    for row, offsets, words in word_runs(batch.column("text")):
        for k in range(row, row + len(offsets) - 1):
            if gone[k].is_valid:
                own = words[offsets[k - row] : offsets[k - row + 1]]
                mask = _kept(own, gone[k].values.to_numpy(zero_copy_only=False).view(np.uint64), window)
                if not mask.all():
                    yield k, data[at[k] : at[k + 1]], mask


def report(found: Repeats) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed and the SHA-256 of the words that stay, joined by a space."""
    window = found.window

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = [
            (batch.column("doc_id")[k].as_py(), _sha(data), int((~stay).sum()), _sha(data, stay)) for k, data, stay in _cut(batch, window)
        ]
        ids, shas, counts, kept = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(shas, pa.string()), pa.array(counts, pa.int64()), pa.array(kept, pa.string())],
            names=["doc_id", "sha", "n_cut", "sha_cut"],
        )

    cut = arrow_map(
        found.texts.select("doc_id", "text").join(found.lost, "doc_id"),
        work,
        "doc_id long, sha string, n_cut long, sha_cut string",
    )
    cut = pinned(cut.distinct())
    nothing = hashlib.sha256(b"").hexdigest()
    # Copies of one text share s1: adaptive execution splits them, as both sides are stored tables.
    led = pinned(
        found.prints.select("doc_id", "n_words", "s1", "s2", "sha")
        .join(found.leads, ["s1", "s2"], "left")
        .select("doc_id", "n_words", "sha", (F.col("doc_id") > F.col("lead")).alias("copy"))
    )
    whole = F.coalesce("copy", F.lit(False)) & (F.col("n_words") >= window)
    return led.join(cut, ["doc_id", "sha"], "left").select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_cut", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(nothing)).otherwise(F.coalesce("sha_cut", "sha")).alias("kept_sha256"),
    )


def _losses(found: Repeats) -> DataFrame:
    """For each id the numbers of its texts that are copies of a smaller id's, and of its windows that a smaller id owns."""
    copies = (
        found.prints.select("doc_id", "n_words", "s1", "s2")
        .join(found.leads, ["s1", "s2"])
        .where((F.col("doc_id") > F.col("lead")) & (F.col("n_words") >= found.window))
        .select("doc_id", F.struct("s1", "s2").alias("copy"), F.lit(None).cast("array<long>").alias("gone"))
    )
    # An id may belong to several rows with different words, so both kinds of loss are judged row by row later.
    return (
        copies.unionByName(found.lost.select("doc_id", F.lit(None).cast("struct<s1:long,s2:long>").alias("copy"), "gone"))
        .groupBy("doc_id")
        .agg(F.collect_set("copy").alias("copies"), F.max("gone").alias("gone"))
    )


def drop_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` with repeated passages cut out of `text`; its other columns and all its rows stay.

    A text that loses words becomes the words that stay, joined by a space (possibly none); other texts stay as
    they are. `n_chars`, if there is such a column, follows the text.
    """
    with short_lived(docs.sparkSession) as keep:
        losses = keep(pinned(_losses(Repeats(docs, window))))
    names = docs.columns
    schema = docs.schema
    place = names.index("text")
    marks = columns(docs, doc_id="long", text="string")
    if marks.isEmpty():
        return docs
    joined = docs.alias("d").join(losses.alias("l"), F.col("d.doc_id") == F.col("l.doc_id"), "left")
    touched = F.col("l.doc_id").isNotNull()
    # Only rows with losses go through Python; the rest pass unchanged.
    both = joined.select(
        *[F.col(f"d.`{n}`") for n in names], F.col("l.copies").alias("__copies"), F.col("l.gone").alias("__gone"), touched.alias("__touched")
    )

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        plain = pa.RecordBatch.from_arrays(
            [batch.column(place), batch.column(len(names) + 1)], names=["text", "gone"]
        )
        texts = batch.column(place).to_pylist()
        copies = batch.column(len(names)).to_pylist()
        for k, data, stay in _cut(plain, window):
            texts[k] = b"".join(joined_words(data, stay)).decode("utf-8")
        for row, offsets, words in word_runs(plain.column("text")):
            for k in range(row, row + len(offsets) - 1):
                if copies[k]:
                    s1, s2 = longs(np.array(_whole(words[offsets[k - row] : offsets[k - row + 1]]), np.uint64)).to_pylist()
                    if {"s1": s1, "s2": s2} in copies[k]:
                        texts[k] = ""
        out = [batch.column(i) for i in range(len(names))]
        out[place] = pa.array(texts, batch.column(place).type)
        yield pa.RecordBatch.from_arrays(out, names=names)

    rewritten = arrow_map(both.where("__touched"), work, schema)
    if "n_chars" in names:
        rewritten = rewritten.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType))
    return rewritten.select(*[F.col(f"`{n}`") for n in names]).unionByName(both.where("NOT __touched").select(*[F.col(f"`{n}`") for n in names]))

"""Language identification: multinomial naive Bayes over hashed character n-grams.

Learning counts the n-grams (1 to 3 letters, runs of other characters as one space) of a sample of labelled texts,
SAMPLE documents of each language on average, chosen by a hash of the id; whole texts. Counts are summed per
task, then by (language, bucket), so the driver gets one row for each at most. The log-probability matrix
(buckets x languages) is broadcast; its size is the parameters' alone. Scoring multiplies the n-gram counts of a
whole text, in sparse form, with that matrix.

Rows: a text that is null or has no letter is `und` with score 0, as is any text when nothing could be learned; null
labels are not learned from; equal rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.grams import gram_numbers, letter_pieces
from fleetpulse.llm.tables import arrow_map, columns

SIZES = (1, 2, 3)
BITS = 15
SAMPLE = 4000  # documents of each language to learn from, on average
SMOOTHING = 0.5


def held_out() -> Column:
    """Documents that are never learned from: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _counts(text: str | None) -> np.ndarray:
    total = np.zeros(1 << BITS, np.int64)
    for size in SIZES:
        for codes in letter_pieces(text, size - 1):
            total += np.bincount(gram_numbers(codes, size, BITS), minlength=1 << BITS)
    return total


def learn(labelled: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log-probabilities (bucket x language) and log-priors from `text`, `lang` and `doc_id`."""
    rows = labelled.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((1 << BITS, 0), np.float32), np.zeros(0, np.float32)
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, SAMPLE / sizes[k])))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("learn")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    chosen = rows.where(draw < F.try_element_at(share, F.col("lang"))).select("text", "lang")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist()):
                sums.setdefault(lang, np.zeros(1 << BITS, np.int64))
                sums[lang] += _counts(text.as_py())
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(total[at], pa.int64())],
                names=["lang", "bucket", "n"],
            )

    summed = chosen.mapInArrow(work, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full((1 << BITS, len(langs)), SMOOTHING)
    column = {k: i for i, k in enumerate(langs)}
    counts[summed["bucket"].to_numpy(), summed["lang"].map(column).to_numpy()] += summed["n"].to_numpy()
    prior = np.log(np.array([sizes[k] for k in langs], float) / sum(sizes.values()))
    return langs, np.log(counts / counts.sum(axis=0)).astype(np.float32), prior.astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, held_out, lang_pred and score (its posterior probability) of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        langs, table, prior = sent.value
        found, scores = [], []
        for text in batch.column("text"):
            total = _counts(text.as_py())
            at = np.flatnonzero(total)
            lettered = any((codes != 32).any() for codes in letter_pieces(text.as_py(), 0)) if len(at) < 4 else True
            if not lettered or not langs:
                found.append("und")
                scores.append(0.0)
                continue
            odds = prior + total[at].astype(np.float64) @ table[at].astype(np.float64)
            odds = np.exp(odds - odds.max())
            found.append(langs[int(odds.argmax())])
            scores.append(float(odds.max() / odds.sum()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(found, pa.string()), pa.array(scores, pa.float64())],
            names=["doc_id", "held_out", "lang_pred", "score"],
        )

    rows = columns(docs, doc_id="long", text="string").withColumn("held_out", held_out())
    return arrow_map(rows, work, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out and predict all of them."""
    rows = columns(docs, doc_id="long", text="string", lang="string")
    return predict(rows, learn(rows.where(~held_out())))

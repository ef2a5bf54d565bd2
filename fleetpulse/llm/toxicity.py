"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017) on hashed pieces of words.

Learned from are confirmed toxic documents (P) and documents as they come (U); a label 0 is used for nothing but the
class prior, the share of toxic ones among labelled rows. Features are buckets of the 4- to 6-letter pieces of
words, the space before a word included; a text has a feature or not. The FEATURES pieces that mark P most clearly
against U (log-ratio of their shares in units of its standard error, above CLEAR) enter a linear model. It minimises

    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)])

with the logistic loss, so that its output is a probability; where the second term falls below zero its gradient is
turned round, which keeps the model from calling all of P's features negative.

P and U are samples of POSITIVES and UNLABELLED documents on average, chosen by a hash of the id, with whole texts. The
driver gets sums per bucket and, for the sample, the chosen features of each text. All documents are scored
by whole texts with a broadcast table of 2**BITS weights.

Rows: a null or empty text has no features and gets the model's score for that; null ids and null labels are not learned
from; equal rows get equal scores; without any confirmed example every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.grams import gram_numbers, letter_pieces
from fleetpulse.llm.tables import arrow_map, columns
from fleetpulse.session import pinned

SIZES = (4, 5, 6)
BITS = 18
FEATURES = 512
CLEAR = 4.5  # standard errors by which a feature must mark P against U
POSITIVES = 4000
UNLABELLED = 8000
THRESHOLD = 0.7


def held_out() -> Column:
    """Documents whose labels are never learned: crc32 of the id as text is 1 modulo 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _features(text: str | None) -> np.ndarray:
    """Buckets of the text's pieces of words, each once."""
    found = [np.empty(0, np.uint32)]
    for size in SIZES:
        for codes in letter_pieces(text, size - 1):
            numbers = gram_numbers(codes, size, BITS)
            inside = np.ones(len(numbers), bool)
            for k in range(1, size):
                inside &= codes[k : k + len(numbers)] != 32
            found.append(numbers[inside])
    return np.unique(np.concatenate(found))


def nnpu(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear model; `p` and `u` are 0/1 matrices, one row per document."""
    weight, bias = np.zeros(p.shape[1]), float(np.log(prior / (1 - prior)))
    mean, square = np.zeros(len(weight) + 1), np.zeros(len(weight) + 1)
    squash = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    for step in range(1, steps + 1):
        gp, gu = p @ weight + bias, u @ weight + bias
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        # Derivatives of the losses by the output: logistic loss of + is -(1 - s), of - is s.
        dp_plus, dp_minus, du = -(1 - squash(gp)) / len(p), squash(gp) / len(p), squash(gu) / len(u)
        if negative >= 0:
            dp, dw = prior * (dp_plus - dp_minus), du
        else:
            dp, dw = prior * dp_minus, -du
        slope = np.append(dp @ p + dw @ u + decay * weight, dp.sum() + dw.sum())
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        move = rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
        weight, bias = weight - move[:-1], bias - move[-1]
    return weight, float(bias)


def learn(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """A weight for each bucket and the bias. Neither table may hold rows that are held out."""
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known, toxic = marked.agg(F.count(F.lit(1)), F.sum((F.col("toxic") == 1).cast("long"))).first()
    rows = docs.where("doc_id is not null")
    count = rows.count()
    if not toxic or not count:
        return np.zeros(1 << BITS, np.float32), -50.0
    prior = min(0.9, max(0.001, toxic / known))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("learn")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    ids = marked.where((F.col("toxic") == 1) & (draw < POSITIVES / toxic)).select("doc_id", F.lit(1).alias("p"))
    # Some POSITIVES ids, whatever the size of the tables.
    drawn = rows.join(F.broadcast(ids), "doc_id", "left").withColumn("u", (draw < UNLABELLED / count).cast("int"))
    drawn = drawn.where("u = 1 or p = 1").select("text", F.coalesce("p", F.lit(0)).alias("p"), "u")

    def featured(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i in range(batch.num_rows):
            found = _features(batch.column("text")[i].as_py()).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([found], pa.list_(pa.int32())), batch.column("p").slice(i, 1), batch.column("u").slice(i, 1)], names=["f", "p", "u"]
            )

    sample = pinned(arrow_map(drawn, featured, "f array<int>, p int, u int"))
    n_p, n_u = sample.agg(F.sum("p"), F.sum("u")).first()
    if not n_p or not n_u:
        return np.zeros(1 << BITS, np.float32), -50.0
    sums = sample.select(F.explode("f").alias("f"), "p", "u").groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).toPandas()
    a, b = (sums["p"] + 0.5) / (n_p + 1), (sums["u"] + 0.5) / (n_u + 1)
    clear = np.log(a / b) / np.sqrt(1 / (sums["p"] + 0.5) + 1 / (sums["u"] + 0.5))
    best = sums.assign(clear=clear)[clear > CLEAR].sort_values(["clear", "f"], ascending=[False, True]).head(FEATURES)
    chosen = np.sort(best["f"].to_numpy())
    if not len(chosen):
        return np.zeros(1 << BITS, np.float32), float(np.log(prior / (1 - prior)))
    wanted = sample.select(F.array_intersect("f", F.array(*map(F.lit, chosen.tolist()))).alias("f"), "p", "u").toPandas()
    table = np.zeros((len(wanted), len(chosen)), np.float32)
    for i, found in enumerate(wanted["f"]):
        table[i, np.searchsorted(chosen, np.asarray(found, np.int64))] = 1
    weight, bias = nnpu(table[wanted["p"].to_numpy() == 1], table[wanted["u"].to_numpy() == 1], prior)
    out = np.zeros(1 << BITS, np.float32)
    out[chosen] = weight
    return out, bias


def _scores(texts: pa.Array, model: tuple[np.ndarray, float]) -> np.ndarray:
    weight, bias = model
    raw = np.array([bias + float(weight[_features(t.as_py())].sum()) for t in texts])
    return 1 / (1 + np.exp(-np.clip(raw, -60, 60)))


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        scores = _scores(batch.column("text"), sent.value)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))],
            names=["doc_id", "held_out", "score", "predicted"],
        )

    rows = columns(docs, doc_id="long", text="string").withColumn("held_out", held_out())
    return arrow_map(rows, work, "doc_id long, held_out boolean, score double, predicted int")


def _learned(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """The model of what is not held out."""
    rows = columns(docs, doc_id="long", text="string")
    known = columns(labels, doc_id="long", toxic="int")
    return learn(rows.where(~held_out()), known.where(~held_out()))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from what is not held out and score all documents."""
    return score(docs, _learned(docs, labels))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without the rows that are predicted toxic, each judged by its own text, with or without an id."""
    sent = docs.sparkSession.sparkContext.broadcast(_learned(docs, labels))
    place = docs.columns.index("text")

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield batch.filter(pa.array(_scores(batch.column(place), sent.value) < THRESHOLD))

    return arrow_map(docs, work, docs.schema)

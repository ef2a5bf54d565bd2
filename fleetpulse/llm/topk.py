"""Exact top-k by inner product with columnar branch and bound.

Vectors become whole numbers floor(scale * x). Candidates are packed into blocks of BLOCK vectors in vertical layout
(one row of numbers per dimension), queries into blocks as well, and every block of queries meets every block
of candidates once. For a query the dimensions are taken in the order of its largest components, a few at a time; after
each step the partial score plus or minus |rest of query| * |rest of candidate| bounds the full score
(Cauchy-Schwarz). Candidates whose upper bound is below the k-th best lower bound go, and the remaining columns are
compacted. Scores of the last survivors are exact whole numbers. Each pair of blocks gives k rows per query at
most; a window merges them.

Work is queries times vectors by nature; blocks of bounded size go over tasks, no block is broadcast and nothing is
collected. The rows of one vector id that repeats are one vector, the smallest.

Rows: a vector that is null, empty or holds a null, NaN or infinite component takes no part, nor does a
null id. Vectors meet only vectors of their own length. Scores beyond a long are cut to its range. A query gets
fewer than k rows if there are fewer other vectors; without candidates it gets none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.llm.tables import arrow_map
from fleetpulse.session import pinned

BLOCK = 2048
STEP = 8  # dimensions taken at once


def _vectors(df: DataFrame, scale: int) -> DataFrame:
    raw = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    odd = F.exists(raw, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(raw, lambda x: F.floor(x * F.lit(float(scale))))
    return (
        df.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~odd)
        .groupBy(F.col("vec_id").cast("long").alias("vec_id"))
        .agg(F.min(whole).alias("v"))
        .withColumn("dims", F.size("v").cast("long"))
    )


def _packed(vectors: DataFrame, block: str) -> DataFrame:
    """One row per `block`: ids and the numbers of its vectors. A block has some BLOCK vectors."""
    both = F.sort_array(F.collect_list(F.struct("vec_id", "v")))
    return vectors.groupBy("dims", block).agg(both.alias("m")).select(
        "dims", block, F.col("m.vec_id").alias("ids"), F.flatten(F.col("m.v")).alias("numbers")
    )


def _exact(numbers: np.ndarray, terms: int) -> np.ndarray:
    """int64 if sums of `terms` products cannot leave it, else Python's whole numbers."""
    most = float(np.abs(numbers.astype(np.float64)).max(initial=0))
    return numbers if most * most * terms < 2.0**62 else numbers.astype(object)


def best(query: np.ndarray, columns: np.ndarray, k: int, banned: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of every candidate that may be among the k best; `columns` is dimension by candidate."""
    order = np.argsort(-np.abs(query.astype(np.float64)), kind="stable")
    live = np.arange(columns.shape[1])
    live = live[live != banned]
    score = np.zeros(len(live), columns.dtype)
    rest = (columns.astype(np.float64) ** 2).sum(axis=0)[live]
    own = float((query.astype(np.float64) ** 2).sum())
    for at in range(0, len(order), STEP):
        dims = order[at : at + STEP]
        part = columns[np.ix_(dims, live)]
        score = score + query[dims] @ part
        rest = np.maximum(rest - (part.astype(np.float64) ** 2).sum(axis=0), 0)
        own = max(own - float((query[dims].astype(np.float64) ** 2).sum()), 0)
        if len(live) > k:
            near = score.astype(np.float64)
            slack = np.sqrt(own * rest) * (1 + 1e-9) + 1e-6 * (1 + np.abs(near))
            floor = np.partition(near - slack, len(near) - k)[len(near) - k]
            stay = near + slack >= floor
            if not stay.all():
                live, score, rest = live[stay], score[stay], rest[stay]
    return live, score


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best vectors for each query; ties go to the smaller vec_id.

    Both tables have `vec_id` and `embedding`; a query's own id is not among its results.
    """
    kept = pinned(_vectors(vectors, scale))
    asked = pinned(_vectors(queries, scale))
    blocks = kept.groupBy("dims").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    asks = asked.groupBy("dims").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("asks"))
    sized = kept.join(blocks, "dims").join(asks, "dims")
    candidates = _packed(
        sized.withColumn("block", F.struct(F.pmod(F.xxhash64("vec_id"), "blocks").alias("b"), F.col("asks"))), "block"
    ).select("dims", "ids", "numbers", F.col("block.b").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("block.asks") - 1)).alias("ask"))
    wanted = _packed(
        asked.join(blocks, "dims").join(asks, "dims").withColumn("ask", F.struct(F.pmod(F.xxhash64("vec_id"), "asks").alias("q"), F.col("blocks"))), "ask"
    ).select("dims", F.col("ids").alias("q_ids"), F.col("numbers").alias("q_numbers"), F.col("ask.q").alias("ask"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("ask.blocks") - 1)).alias("block"))
    met = candidates.join(wanted, ["dims", "block", "ask"])

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        column = lambda name, row: batch.column(name)[row].values.to_numpy(zero_copy_only=False)
        for row in range(batch.num_rows):
            ids, q_ids, dims = column("ids", row), column("q_ids", row), batch.column("dims")[row].as_py()
            numbers, asked_numbers = column("numbers", row), column("q_numbers", row)
            both = _exact(np.concatenate((numbers, asked_numbers)), dims)
            table = np.ascontiguousarray(both[: len(numbers)].reshape(-1, dims).T)
            places = {int(v): i for i, v in enumerate(ids)}
            found = []
            for q, query in zip(q_ids, both[len(numbers) :].reshape(-1, dims)):
                live, score = best(query, table, k, places.get(int(q), -1))
                first = np.lexsort((ids[live], -score.astype(np.float64) if score.dtype == object else -score))[: max(k, 0)]
                if score.dtype == object:
                    first = sorted(range(len(live)), key=lambda i: (-score[i], ids[live[i]]))[:k]
                found += [(int(q), int(ids[live[i]]), int(min(max(score[i], -(2**63)), 2**63 - 1))) for i in first]
            parts = list(zip(*found)) if found else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()) for p in parts], names=["query_id", "vec_id", "score"])

    some = arrow_map(met.select("dims", "ids", "numbers", "q_ids", "q_numbers"), work, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return some.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

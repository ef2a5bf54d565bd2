"""Isolation Forest (Liu, Ting and Zhou, 2008) on Spark.

Spark draws the samples, spreads the trees over tasks and spreads the rows to score; numpy grows one
tree from at most `max_samples` rows and walks a batch of rows through the trees.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Callable, Sequence
from functools import lru_cache, reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from fleetpulse.functions.hashing import HASH_RANGE, hash_number, hash_value
from fleetpulse.plans.joins import salted_join
from fleetpulse.plans.ranks import exact_percentile, percentiles
from fleetpulse.schema import FOREST_SCHEMA
from fleetpulse.session import pinned

EULER_GAMMA = 0.5772156649015329
PATH_UNIT = 2.0**-32  # path lengths are whole multiples of it, so that their sum does not depend on its order
WALK_ROWS = 4096  # rows that walk together, column by column; few enough to stay in a core's cache
NODE_COLUMNS = ["tree_id", "node_id", "feature", "threshold", "left", "right", "size", "depth"]


def average_path(size: int | float) -> float:
    """Expected path length of an unsuccessful search among `size` points."""
    if size <= 1:
        return 0.0
    if size == 2:
        return 1.0
    return 2.0 * (math.log(size - 1.0) + EULER_GAMMA) - 2.0 * (size - 1.0) / size


def _draws(n_trees: int, share: float) -> list[int]:
    """Hash values at which a row is drawn by one tree more: the inverse of the binomial law of `n_trees` and `share`."""
    total, out = 0.0, []
    for k in range(n_trees):
        total += math.comb(n_trees, k) * share**k * (1.0 - share) ** (n_trees - k)
        out.append(min(HASH_RANGE, math.floor(total * HASH_RANGE)))
    return out


def forest_sample(rows: DataFrame, n_trees: int = 100, max_samples: int = 256, seed: int = 42) -> DataFrame:
    """Which rows each tree is grown from: `tree_id, rank, sample_id`, without replacement per tree.

    A tree takes the rows with its smallest keys (all rows, if there are fewer). Rows are thinned first: a tree looks at a row
    with a chance that leaves it about four times as many as it wants. How many trees look at a row is binomial, and one
    hash gives that number; most rows of a large table get 0 and are done. Two more hashes tell which trees (equal steps
    around the circle of trees, from a drawn start and by a drawn step), and one more for each of them is its key.
    """
    total = rows.count()
    # Steps that have no divisor in common with the number of trees reach different trees.
    steps = [b for b in range(1, n_trees + 1) if math.gcd(b, n_trees) == 1]
    own = F.col("sample_id")
    wanted = 4 * max_samples
    while True:
        share = min(1.0, wanted / max(1, total))
        draws = _draws(n_trees, share)
        # The hash is an element of an array, not a column, so that the comparisons do not work it out again and again.
        reached = [d for d in draws if d < HASH_RANGE] or [0] * n_trees
        number = lambda h: reduce(add, [(h >= F.lit(d)).cast("int") for d in reached])  # noqa: E731, B023
        looked = (
            rows.select("sample_id")
            .where(hash_number(seed, own) >= F.lit(draws[0]))
            .select(
                "sample_id",
                F.explode(F.sequence(F.lit(0), F.get(F.transform(F.array(hash_number(seed, own)), number), 0) - 1)).alias("turn"),
            )
        )
        start, step = hash_number(seed, "start", own) % n_trees, hash_number(seed, "step", own) % len(steps)
        tree = (start + F.col("turn") * F.get(F.array(*map(F.lit, steps)), step.cast("int"))) % n_trees
        near = pinned(looked.select("sample_id", tree.cast("int").alias("tree_id")))
        if share >= 1.0:
            break
        full = F.count_if(F.col("count") >= max_samples)
        if near.groupBy("tree_id").count().agg(full).first()[0] == n_trees:
            break
        wanted *= 4  # a chance of less than e**-200
    order = Window.partitionBy("tree_id").orderBy("key", "sample_id")
    ranked = near.withColumn("key", hash_number(seed, "key", F.col("tree_id"), own)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max_samples)
    return ranked.select("tree_id", "rank", "sample_id")


def _grow(points: np.ndarray, tree_id: int, seed: int, height: int) -> pd.DataFrame:
    """Isolate `points` by random cuts; node `i` has the children `2i + 1` and `2i + 2`.

    Seed, tree and node decide a cut, so the order in which nodes are grown does not matter.
    """
    nodes = []
    pending = [(0, 0, points)]
    while pending:
        node, depth, members = pending.pop()
        low, high = (members.min(axis=0), members.max(axis=0)) if len(members) > 1 else (None, None)
        varying = np.flatnonzero(high > low) if len(members) > 1 and depth < height else []
        if not len(varying):
            nodes.append((tree_id, node, None, None, None, None, len(members), depth))
            continue
        drawn, share = (hash_value(seed, what, tree_id, node) / HASH_RANGE for what in ("feature", "cut"))
        feature = int(varying[int(drawn * len(varying))])
        cut = float(low[feature] + share * (high[feature] - low[feature]))
        if cut >= high[feature]:  # rounding may reach the upper end, which would leave a side empty
            cut = float(low[feature])
        goes_left = members[:, feature] <= cut
        left, right = 2 * node + 1, 2 * node + 2
        nodes.append((tree_id, node, feature, cut, left, right, len(members), depth))
        pending.append((right, depth + 1, members[~goes_left]))
        pending.append((left, depth + 1, members[goes_left]))
    frame = pd.DataFrame(nodes, columns=NODE_COLUMNS)
    return frame.astype({c: "Int32" for c in ("feature", "left", "right")})


def grow_trees(drawn: DataFrame, max_samples: int = 256, seed: int = 42) -> DataFrame:
    """Node table of trees grown in parallel from `tree_id, sample_id, point`, one group per tree.

    A group has at most `max_samples` rows. They are sorted by `sample_id` first, so that partitioning
    cannot change the result.
    """
    height = math.ceil(math.log2(max(2, max_samples)))

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        points = np.stack(group.sort_values("sample_id")["point"])
        return _grow(points, int(group["tree_id"].iloc[0]), seed, height)

    return drawn.groupBy("tree_id").applyInPandas(grow, FOREST_SCHEMA)


def quantum_digits(name: str) -> int:
    """Decimals of a feature that the forest looks at: bytes per second are large, all else is a percentage or a ratio."""
    return 2 if "_bps" in name and not name.endswith("_burst") else 6


def whole_points(names: Sequence[str]) -> list[Column]:
    """Features as whole numbers of their smallest steps, for growing and scoring alike.

    Two engines differ in the last bits of a feature, and a cut between two such values would part what another engine keeps
    together. Whole numbers are equal on every engine (the break point is just off the half, where ties are common), and
    isolation does not care for the unit, nor for mean and scale of a feature.
    """
    return [F.expr(f"cast(floor(`{n}` * {float(10 ** quantum_digits(n))!r}D + 0.4999D) as double)").alias(n) for n in names]


def fit_forest(
    features: DataFrame,
    names: Sequence[str],
    n_trees: int = 100,
    max_samples: int = 256,
    seed: int = 42,
    whole: bool = False,
) -> DataFrame:
    """Fit on a table with `sample_id` and the columns `names`, as they are or (`whole`) as whole numbers of their smallest steps.

    The drawn sample (two integers per row, `n_trees * max_samples` rows) is broadcast.
    """
    sample = forest_sample(features.select("sample_id"), n_trees, max_samples, seed)
    points = features.select("sample_id", F.array(*(whole_points(names) if whole else names)).alias("point"))
    return grow_trees(points.join(F.broadcast(sample), "sample_id"), max_samples, seed)


@lru_cache(maxsize=4)
def _unpacked(data: bytes) -> dict:
    return pickle.loads(zlib.decompress(data))


class _Packed:
    """A forest that travels with the function itself."""

    def __init__(self, forest: dict):
        self.data = zlib.compress(pickle.dumps(forest), 9)

    @property
    def value(self) -> dict:
        return _unpacked(self.data)


class ForestScorer:
    """Column expression for the anomaly score of a fitted forest.

    `nodes` are the collected rows of a node table: `n_trees * 511` at the usual settings, so their
    size depends on the model's parameters and never on the data. `drawn` is the number of rows each
    tree was grown from.
    """

    def __init__(self, spark: SparkSession, nodes: Sequence[Row], drawn: int):
        if not nodes:
            raise RuntimeError("Model not fitted")
        table = pd.DataFrame.from_records([tuple(n) for n in nodes], columns=NODE_COLUMNS)
        table = table.sort_values(["tree_id", "node_id"], ignore_index=True)
        position = pd.Series(table.index, index=pd.MultiIndex.from_frame(table[["tree_id", "node_id"]]))
        leaf = table["feature"].isna().to_numpy()

        def child(side: str) -> np.ndarray:
            """Position of the child; a leaf leads to itself, so that all rows can walk equally far."""
            inner = table[~leaf]
            found = np.arange(len(table), dtype=np.intp)
            found[~leaf] = position.loc[list(zip(inner["tree_id"], inner[side].astype(int)))].to_numpy()
            return found

        trees = table.groupby("tree_id")["depth"].max()
        forest = {
            "feature": table["feature"].fillna(0).astype(np.intp).to_numpy(),
            "cut": table["threshold"].astype(float).where(~leaf, np.inf).to_numpy(),
            # Of each node the child on the right and the child on the left, so that a comparison is the place.
            "children": np.column_stack((child("right"), child("left"))).ravel(),
            "path": np.floor((table["depth"].to_numpy() + table["size"].map(average_path).to_numpy()) / PATH_UNIT + 0.4999).astype(np.int64),
            "roots": [(int(position[tree, 0]), int(depth)) for tree, depth in trees.items()],
            "usual": average_path(drawn) or 1.0,
        }
        self._forest = spark.sparkContext.broadcast(forest)

    def walk(self, packed: bool = False) -> Callable[[np.ndarray], np.ndarray]:
        """A function from a batch of points to their scores, for use inside a task. `packed`: without a broadcast, which
        Spark does not give to stateful processors; the compressed forest has to stay below the size at which Spark broadcasts functions."""
        shared = _Packed(self._forest.value) if packed else self._forest

        def scores(points: np.ndarray) -> np.ndarray:
            forest = shared.value
            feature, cut, children, path = (forest[c] for c in ("feature", "cut", "children", "path"))
            total = np.zeros(len(points), np.int64)
            for begin in range(0, len(points), WALK_ROWS):
                block = np.ascontiguousarray(points[begin : begin + WALK_ROWS].T)
                n, flat = block.shape[1], block.ravel()
                own, column = np.arange(n), feature * n
                at, place, stays_left = np.empty(n, np.intp), np.empty(n, np.intp), np.empty(n, bool)
                value, limit = np.empty(n), np.empty(n)
                # All places are valid; "clip" only lets numpy write into the arrays that are there.
                for root, depth in forest["roots"]:
                    at.fill(root)
                    for _ in range(depth):
                        column.take(at, out=place, mode="clip")
                        place += own
                        flat.take(place, out=value, mode="clip")
                        cut.take(at, out=limit, mode="clip")
                        np.less_equal(value, limit, out=stays_left)
                        at += at
                        at += stays_left
                        children.take(at, out=place, mode="clip")
                        at, place = place, at
                    total[begin : begin + n] += path.take(at)
            return -np.exp2(-(total * PATH_UNIT) / len(forest["roots"]) / forest["usual"])

        return scores

    def score(self, features: Sequence[Column | str]) -> Column:
        """Score in [-1, 0): the more negative, the more anomalous. `features` (columns or SQL) in training order."""
        walk = self.walk()

        @F.pandas_udf("double")
        def scores(*columns: pd.Series) -> pd.Series:
            return pd.Series(walk(np.column_stack([c.to_numpy(dtype=float) for c in columns])))

        return scores(*[F.expr(f) if isinstance(f, str) else f for f in features])


def contamination_offset(scores: DataFrame, contamination: float = 0.05) -> float | None:
    """Score below which the given share of the training rows lies."""
    return exact_percentile(scores, "score", contamination)


def contamination_label(score: Column, offset: float) -> Column:
    """-1 for an anomaly, 1 for a normal row."""
    return F.when(score < F.lit(offset), -1).otherwise(1)


def calibrate_threshold(scores: DataFrame, target_fpr: float = 0.05, approximate: bool = False) -> float | None:
    """Threshold that flags the share `target_fpr` of rows assumed to be normal.

    `approximate`: one pass with a sketch, whose rank is off by a ten-thousandth of the rows at most, instead of a few passes.
    """
    if approximate:
        return scores.agg(F.percentile_approx("score", float(target_fpr), 10_000)).first()[0]
    return exact_percentile(scores, "score", target_fpr)


def calibrate_thresholds(scores: DataFrame, target_fpr: float = 0.05, by: Sequence[str] = ("host",)) -> DataFrame:
    """A threshold for each group, all found in the same passes; a group of any size is counted before the shuffle."""
    return percentiles(scores, "score", target_fpr, by).withColumnRenamed("value", "threshold")


def below_thresholds(scores: DataFrame, thresholds: DataFrame, by: Sequence[str] = ("host",)) -> DataFrame:
    """`scores` with `threshold` and `is_anomaly` by the threshold of their group; both are NULL for a group without one."""
    return salted_join(scores, thresholds, list(by)).withColumn("is_anomaly", F.col("score") < F.col("threshold"))


def below_threshold(score: Column, threshold: float | None) -> Column:
    """True for an anomaly; strict, so a score equal to the threshold is normal."""
    if threshold is None:
        raise RuntimeError("Threshold not calibrated")
    return score < F.lit(threshold)

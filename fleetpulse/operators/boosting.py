"""Gradient boosting of small regression trees on histograms, in whole numbers.

Features are dealt into `bins` equal parts of their range, and rows with the same parts of all features become one cell with
its number of rows and the sum of its labels; squared loss needs no more. A tree grows level by level: one aggregation gives, for each node, feature and
part, the number of rows and the sum of residuals, a table whose size is set by parameters, and the driver picks the cuts.

Labels and predictions are whole multiples of `unit`, so sums do not depend on their order, and the gain of a cut is the same few float
operations on any engine: two engines pick the same cuts. Ties go to the first feature and the lowest cut.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.session import pinned

TREES_PER_STORED_TABLE = 8


@dataclass(frozen=True)
class Split:
    """Rows whose feature lies in a part up to `part` go left. A node without a split is a leaf and has a value."""

    feature: int | None
    part: int | None
    value: int


Tree = dict[int, Split]  # node 1 is the root; node i has the children 2 i and 2 i + 1


@dataclass(frozen=True)
class BoostedTrees:
    features: Sequence[str]
    ranges: Sequence[tuple[float, float]]
    bins: int
    unit: float
    start: int
    trees: Sequence[Tree]

    def parts(self) -> list[Column]:
        return [part_of(F.col(f), low, high, self.bins) for f, (low, high) in zip(self.features, self.ranges)]

    def prediction(self) -> Column:
        """The prediction as a column expression on the features."""
        parts = self.parts()
        return (F.lit(self.start) + _sum([_walk(t, parts) for t in self.trees])) * F.lit(self.unit)


def part_of(value: Column, low: float, high: float, bins: int) -> Column:
    """In which of the equal parts of [low, high] a value lies; values outside count to the outer parts, nulls to the first."""
    if not high > low:
        return F.lit(0)
    place = F.floor((value - F.lit(low)) / F.lit(high - low) * F.lit(float(bins)))
    return F.when(value.isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(bins - 1), place))).cast("int")


def _sum(columns: Sequence[Column]) -> Column:
    total = F.lit(0).cast("long")
    for c in columns:
        total = total + c
    return total


def _walk(tree: Tree, parts: Sequence[Column], node: int = 1) -> Column:
    split = tree[node]
    if split.feature is None:
        return F.lit(split.value).cast("long")
    return F.when(parts[split.feature] <= split.part, _walk(tree, parts, 2 * node)).otherwise(_walk(tree, parts, 2 * node + 1))


def _node_of(tree: Tree, parts: Sequence[Column], node: int = 1) -> Column:
    """The open node that a cell lies in."""
    split = tree.get(node)
    if split is None or split.feature is None:
        return F.lit(node)
    return F.when(parts[split.feature] <= split.part, _node_of(tree, parts, 2 * node)).otherwise(_node_of(tree, parts, 2 * node + 1))


def _step(residuals: int, rows: int, rate: float) -> int:
    """What a leaf adds: its mean residual, times the learning rate, in whole units."""
    return math.floor(rate * residuals / rows + 0.5)


def _cut(hist: dict[tuple[int, int], tuple[int, int]], features: int, bins: int) -> tuple[int, int] | None:
    """The feature and part of the cut with the largest gain over no cut, None if no cut gains."""
    whole = [hist.get((0, b), (0, 0)) for b in range(bins)]
    rows, total = sum(n for n, _ in whole), sum(s for _, s in whole)
    best, found = float(total) * float(total) / rows, None
    for feature in range(features):
        n = s = 0
        for b in range(bins - 1):
            more = hist.get((feature, b), (0, 0))
            n, s = n + more[0], s + more[1]
            if n == 0 or n == rows:
                continue
            gain = float(s) * float(s) / n + float(total - s) * float(total - s) / (rows - n)
            if gain > best:
                best, found = gain, (feature, b)
    return found


def fit_boosted_trees(
    rows: DataFrame,
    features: Sequence[str],
    label: str,
    trees: int = 100,
    depth: int = 3,
    rate: float = 0.1,
    bins: int = 32,
    unit: float = 1.0 / 1024,
) -> BoostedTrees:
    """Fit `label` on `features`. Rows with a null take no part."""
    known = rows.select(*[F.col(c).cast("double").alias(c) for c in [*features, label]]).dropna()
    ends = known.agg(*[f(c).alias(f"{name}{i}") for i, c in enumerate(features) for name, f in (("lo", F.min), ("hi", F.max))]).first()
    if ends[0] is None:
        raise ValueError(f"No rows with {label} and all features")
    ranges = [(ends[f"lo{i}"], ends[f"hi{i}"]) for i in range(len(features))]
    model = BoostedTrees(list(features), ranges, bins, unit, 0, [])
    whole = F.floor(F.col(label) / F.lit(unit) + 0.5).cast("long")
    names = [f"p{i}" for i in range(len(features))]
    cells = known.select(*[p.alias(n) for p, n in zip(model.parts(), names)], whole.alias("y"))
    cells = pinned(cells.groupBy(*names).agg(F.count("*").alias("n"), F.sum("y").alias("s")))
    sums = cells.agg(F.sum("n"), F.sum("s")).first()
    start = _step(sums[1], sums[0], 1.0)
    # `s` is the sum of the residuals from here on.
    cells = cells.withColumn("s", F.col("s") - F.col("n") * F.lit(start))
    parts, grown = [F.col(n) for n in names], []
    told = F.array(*[F.struct(F.lit(i).alias("feature"), F.col(n).alias("part")) for i, n in enumerate(names)])
    pending: list[Tree] = []
    for turn in range(trees):
        tree: Tree = {}
        residual = F.col("s") - F.col("n") * _sum([_walk(t, parts) for t in pending])
        for level in range(depth):
            placed = cells.select("n", residual.alias("s"), _node_of(tree, parts).alias("node"), F.inline(told))
            table = placed.where(F.col("node") >= 2**level).groupBy("node", "feature", "part").agg(F.sum("n"), F.sum("s")).collect()
            hists: dict[int, dict[tuple[int, int], tuple[int, int]]] = {}
            for node, feature, part, n, s in table:
                hists.setdefault(node, {})[feature, part] = (n, s)
            for node, hist in sorted(hists.items()):
                cut = _cut(hist, len(features), bins)
                left = [hist.get((cut[0], b), (0, 0)) for b in range(cut[1] + 1)] if cut else []
                every = [hist.get((0, b), (0, 0)) for b in range(bins)]
                n, s = sum(x for x, _ in every), sum(x for _, x in every)
                if cut is None:
                    tree[node] = Split(None, None, _step(s, n, rate))
                    continue
                tree[node] = Split(*cut, 0)
                if level == depth - 1:
                    own = sum(x for x, _ in left), sum(x for _, x in left)
                    tree[2 * node] = Split(None, None, _step(own[1], own[0], rate))
                    tree[2 * node + 1] = Split(None, None, _step(s - own[1], n - own[0], rate))
        grown.append(tree)
        pending.append(tree)
        if len(pending) == TREES_PER_STORED_TABLE and turn + 1 < trees:
            done = F.col("s") - F.col("n") * _sum([_walk(t, parts) for t in pending])
            cells, pending = pinned(cells.withColumn("s", done)), []
    return BoostedTrees(list(features), ranges, bins, unit, start, grown)

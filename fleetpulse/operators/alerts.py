"""Alert rules as column predicates, and the cooldown between alerts of one rule on one host."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.functions.text import fixed_point

# Default thresholds and the cooldown in seconds.
DEFAULT_THRESHOLDS = {"cpu_high": ("cpu_pct", 90.0), "mem_high": ("mem_pct", 90.0), "swap_high": ("swap_pct", 80.0)}
COOLDOWN_SECONDS = 60
CHUNK_SECONDS = 86400
CHUNKS_PER_BLOCK = 512


@dataclass(frozen=True)
class Rule:
    """An alert is raised on every row where `message` is not NULL."""

    name: str
    severity: str
    message: Column


def threshold_rule(name: str, metric: str, threshold: float, severity: str = "warning") -> Rule:
    """Metric at or over a threshold; a missing value is silent."""
    value = F.col(metric)
    text = F.concat(
        F.lit(f"{metric} exceeded threshold: "), fixed_point(value, 1), F.lit(f" >= {float(threshold)}")
    )
    return Rule(name, severity, F.when(value >= threshold, text))


def anomaly_rule(name: str = "anomaly_detected") -> Rule:
    """A flagged row; a missing score shows as 0."""
    text = F.concat(
        F.lit("Anomaly detected (score="), fixed_point(F.coalesce("score", F.lit(0.0)), 3), F.lit(")")
    )
    return Rule(name, "critical", F.when(F.coalesce("is_anomaly", F.lit(False)), text))


def forecast_rule(name: str, metric: str, minutes: Column, horizon_hours: int = 24) -> Rule:
    """A forecast of the metric within the horizon; a missing forecast is silent."""
    hours = fixed_point(minutes / 60.0, 1)
    text = F.concat(F.lit(f"{metric} will reach threshold in "), hours, F.lit("h"))
    return Rule(name, "warning", F.when(minutes < horizon_hours * 60, text))


def sql_rule(name: str, predicate: str, message: str, severity: str = "warning") -> Rule:
    """A rule of one's own: SQL predicate and SQL expression for the message."""
    return Rule(name, severity, F.when(F.expr(predicate), F.expr(message)))


def default_rules(with_anomalies: bool = True) -> list[Rule]:
    rules = [threshold_rule(name, metric, limit) for name, (metric, limit) in DEFAULT_THRESHOLDS.items()]
    return [*rules, anomaly_rule()] if with_anomalies else rules


def raise_alerts(rows: DataFrame, rules: Sequence[Rule], keep: Sequence[str] = ()) -> DataFrame:
    """One row per sample and rule that fires: `sample_id, host, ts, <keep>, rule_order, rule, severity, message`.

    On a stream `keep` names the column of the watermark, which has to see rows without alerts, too: the test for alerts
    mentions it, so that Spark does not drop those rows before.
    """
    fired = F.array(
        *[
            F.struct(
                F.lit(order).alias("rule_order"),
                F.lit(rule.name).alias("rule"),
                F.lit(rule.severity).alias("severity"),
                rule.message.alias("message"),
            )
            for order, rule in enumerate(rules)
        ]
    )
    told = [F.col(c).isNotNull() for c in keep]
    hits = F.filter(fired, lambda alert: reduce(and_, told, alert["message"].isNotNull()))
    return rows.select("sample_id", "host", "ts", *keep, F.inline(hits))


def _follow(seconds: np.ndarray, start: int, cooldown: int) -> Iterator[int]:
    """Positions that fire when the first candidate is at `start`."""
    following = np.searchsorted(seconds, seconds + cooldown)
    at = start
    while at < len(seconds):
        yield at
        at = int(following[at])


def _exit_waits(seconds: np.ndarray, end: int, cooldown: int, heads: int) -> list[int]:
    """Wait left at `end` if the first alert that may fire is the one at position 0, 1, .. heads - 1."""
    seconds = np.asarray(seconds, dtype=np.int64)
    following = np.searchsorted(seconds, seconds + cooldown)
    left: dict[int, int] = {}
    for head in reversed(range(heads)):
        path, at = [head], int(following[head])
        while at < len(seconds) and at not in left:
            path.append(at)
            at = int(following[at])
        wait = left[at] if at in left else max(0, int(seconds[path[-1]]) + cooldown - end)
        left.update(dict.fromkeys(path, wait))
    return [left[head] for head in range(heads)]


def _passes(ready: Column, part: Column) -> Column:
    """The moment from which an alert may fire after a part of the time, if before it that moment is `ready`."""
    blocked = F.size(F.filter(part["heads"], lambda second: second < ready))
    return F.coalesce(F.get(part["outs"], blocked), ready)


def _then(first: Column, second: Column, cooldown: int) -> Column:
    """Two neighbouring parts as one. An alert that all of the first part's heads miss meets the second part's first head."""
    outs = F.transform(first["outs"], lambda ready: _passes(ready, second))
    enough = F.element_at(first["heads"], -1) > first["begin"] + cooldown
    more = [F.when(enough, first["heads"]).otherwise(F.array_append(first["heads"], F.get(second["heads"], 0)))]
    more += [F.when(enough, outs).otherwise(F.array_append(outs, F.get(second["outs"], 0)))]
    return F.struct(first["place"].alias("place"), first["begin"].alias("begin"), more[0].alias("heads"), more[1].alias("outs"))


def _entered(parts: Column, ready: Column) -> Column:
    """For each part, in order, its place and the moment from which an alert may fire when it begins."""
    nothing = F.array().cast("array<struct<place:bigint,ready:bigint>>")

    def step(state: Column, part: Column) -> Column:
        entry = F.struct(part["place"].alias("place"), state["ready"].alias("ready"))
        return F.struct(_passes(state["ready"], part).alias("ready"), F.array_append(state["entered"], entry).alias("entered"))

    return F.aggregate(parts, F.struct(ready.alias("ready"), nothing.alias("entered")), step)["entered"]


def apply_cooldown(
    alerts: DataFrame, cooldown: int = COOLDOWN_SECONDS, chunk_seconds: int = CHUNK_SECONDS, fan: int = CHUNKS_PER_BLOCK
) -> DataFrame:
    """Keep an alert, then drop those of the same host and rule until `cooldown` seconds have passed.

    Dropped alerts do not prolong the wait. The clock starts at 0, so nothing fires before `cooldown`.

    The choice is sequential, yet no task sees a whole (host, rule): alerts are reduced to one per
    second, then cut into days, each at most 86,400 entries. What a day does to the ones after it is a step function: from the
    moment at which an alert may fire when the day begins to that moment when it has ended. Only alerts within `cooldown` of
    its start and the one after them are steps, so it is a short list, and two neighbouring functions are one of the same kind and size.
    `fan` days are put together to a block, blocks are followed from the first to the last of a (host, rule), then each
    block's days from the moment it begins with, and every day is worked out on its own. No row holds more than `fan` such lists.
    """
    length = max(chunk_seconds, cooldown)
    payload = [c for c in alerts.columns if c not in ("host", "rule", "ts")]
    per_second = alerts.groupBy("host", "rule", "ts").agg(
        F.min_by(F.struct(*payload), F.struct("sample_id", "rule_order")).alias("alert")
    )
    chunks = (
        per_second.groupBy("host", "rule", F.floor(F.col("ts") / length).alias("chunk"))
        .agg(F.array_sort(F.collect_list(F.struct("ts", "alert"))).alias("hits"))
        .withColumn("seconds", F.col("hits.ts"))
    )

    @F.pandas_udf("array<bigint>")
    def exit_waits(seconds: pd.Series, chunk: pd.Series, heads: pd.Series) -> pd.Series:
        rows = zip(seconds, chunk, heads)
        return pd.Series([_exit_waits(s, (c + 1) * length, cooldown, h) for s, c, h in rows])

    @F.pandas_udf("array<int>")
    def firing(seconds: pd.Series, chunk: pd.Series, wait: pd.Series) -> pd.Series:
        def positions(s: np.ndarray, c: int, w: int) -> list[int]:
            s = np.asarray(s, dtype=np.int64)
            return list(_follow(s, int(np.searchsorted(s, c * length + w)), cooldown))

        return pd.Series([positions(*row) for row in zip(seconds, chunk, wait)])

    begin = F.col("chunk") * length
    early = F.size(F.filter("seconds", lambda second: second <= begin + cooldown))
    heads = F.least(early + 1, F.size("seconds"))
    ended = F.transform(exit_waits("seconds", "chunk", heads), lambda wait: wait + begin + length)
    days = chunks.select(
        "host",
        "rule",
        F.floor(F.col("chunk") / fan).alias("block"),
        F.struct(
            F.col("chunk").alias("place"), begin.alias("begin"), F.slice("seconds", F.lit(1), heads).alias("heads"), ended.alias("outs")
        ).alias("part"),
    )
    blocks = days.groupBy("host", "rule", "block").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    rest = F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0)))
    whole = F.aggregate(rest, F.get("parts", 0), lambda one, other: _then(one, other, cooldown))
    followed = (
        blocks.select("host", "rule", whole.withField("place", F.col("block")).alias("part"))
        .groupBy("host", "rule")
        .agg(F.array_sort(F.collect_list("part")).alias("parts"))
        .select("host", "rule", F.inline(_entered(F.col("parts"), F.lit(cooldown).cast("bigint"))))
        .select(F.col("host").alias("b_host"), F.col("rule").alias("b_rule"), F.col("place").alias("b_block"), "ready")
    )
    own = F.col("host").eqNullSafe(F.col("b_host")) & F.col("rule").eqNullSafe(F.col("b_rule")) & (F.col("block") == F.col("b_block"))
    waits = (
        blocks.join(followed, own, "left")
        .select("host", "rule", F.inline(_entered(F.col("parts"), F.col("ready"))))
        .select("host", "rule", F.col("place").alias("chunk"), F.greatest(F.col("ready") - F.col("place") * length, F.lit(0)).alias("wait"))
    )
    # A NULL host or rule is a key of its own. A left join, so that both uses of `chunks` stay the same plan and
    # share its shuffle.
    named = waits.select(F.col("host").alias("w_host"), F.col("rule").alias("w_rule"), F.col("chunk").alias("w_chunk"), "wait")
    same = F.col("host").eqNullSafe(F.col("w_host")) & F.col("rule").eqNullSafe(F.col("w_rule"))
    fired = chunks.join(named, same & (F.col("chunk") == F.col("w_chunk")), "left").withColumn(
        "fires", firing("seconds", "chunk", "wait")
    )
    kept = F.transform("fires", lambda i: F.get("hits", i))
    return (
        fired.select("host", "rule", F.inline(kept))
        .select("host", "rule", "ts", "alert.*")
        .select(*alerts.columns)
    )

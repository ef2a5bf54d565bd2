"""Live detection: features from per-host state, then the same scoring as in batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.operators.detection import AnomalyModel
from fleetpulse.operators.features import FeatureSettings, ema_suffix
from fleetpulse.operators.forest import below_threshold, quantum_digits
from fleetpulse.streaming.ordered import DELAY_SECONDS, KEEP_SECONDS, Rows, in_order, on_clock

BLOCK = 64


class RunningFeatures:
    """Features of one host, a chunk of rows at a time, from a ring of its last rows and its running averages.

    Every sum, maximum or slope over the last w rows is one reduction over a strided view of ring and chunk, without a copy of
    them, for all metrics at once. An exponential average is linear in the value before a block and the block's rows, so it is one
    product with a triangular matrix per BLOCK rows.
    """

    def __init__(self, settings: FeatureSettings):
        self.settings, self.metrics = settings, list(settings.metrics)
        self.depth = settings.depth()
        self.bursts = [self.metrics.index(m) for m in settings.burst_metrics()]
        k = np.arange(BLOCK)
        self.decay = [(1.0 - a) ** (k + 1.0) for a in settings.alphas]
        powers = np.maximum(k[:, None] - k[None, :], 0)
        self.weights = [np.tril(a * (1.0 - a) ** powers) for a in settings.alphas]

    def _last(self, ring: np.ndarray, rows: np.ndarray, size: int, fill: float) -> np.ndarray:
        """View of the last `size` rows at each new row (row, metric, place); `fill` stands for rows before the first."""
        known = ring[-(size - 1) :] if size > 1 else ring[:0]
        lead = np.full((size - 1 - len(known), rows.shape[1]), fill)
        return np.lib.stride_tricks.sliding_window_view(np.concatenate((lead, known, rows)), size, axis=0)

    def _average(self, rows: np.ndarray, start: np.ndarray, i: int) -> np.ndarray:
        out, value = np.empty_like(rows), start
        for at in range(0, len(rows), BLOCK):
            own = rows[at : at + BLOCK]
            n = len(own)
            out[at : at + n] = self.weights[i][:n, :n] @ own + self.decay[i][:n, None] * value
            value = out[at + n - 1]
        return out

    def features(self, rows: np.ndarray, ring: np.ndarray, averages: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features of the new rows (in the order of `feature_names`), and ring and averages after them."""
        s, n = self.settings, len(rows)
        seen = np.minimum(len(ring) + 1 + np.arange(n), np.iinfo(np.int32).max)[:, None]
        columns: dict[str, np.ndarray] = {}

        def name(values: np.ndarray, tag: str, which: Sequence[int] | None = None) -> None:
            for place, j in enumerate(range(len(self.metrics)) if which is None else which):
                columns[f"{self.metrics[j]}{tag}"] = values[:, place]

        name(rows, "")
        for k in s.lag_periods:
            name(self._last(ring, rows, k + 1, 0.0)[:, :, 0], f"_lag{k}")
        for tag, size in (("s", s.short_window), ("l", s.long_window)):
            count = np.minimum(seen, size)
            view = self._last(ring, rows, size, np.nan)
            mean = np.nansum(view, axis=2) / count
            spread = np.nansum((view - mean[:, :, None]) ** 2, axis=2)
            name(mean, f"_rmean_{tag}")
            name(np.sqrt(spread / np.maximum(count - 1, 1)), f"_rstd_{tag}")
        start = rows[0] if averages is None else None
        ends = np.empty((len(s.alphas), len(self.metrics)))
        for i, alpha in enumerate(s.alphas):
            average = self._average(rows, averages[i] if start is None else start, i)
            name(average, f"_{ema_suffix(alpha)}")
            ends[i] = average[-1]
        steps = np.arange(s.slope_window) - (s.slope_window - 1) / 2
        slope = self._last(ring, rows, s.slope_window, 0.0) @ (steps / (steps**2).sum())
        name(np.where(seen >= s.slope_window, slope, 0.0), "_slope")
        if self.bursts:
            view = self._last(ring, rows, s.burst_window, np.nan)[:, self.bursts]
            mean = np.nansum(view, axis=2) / np.minimum(seen, s.burst_window)
            name(np.nanmax(view, axis=2) / (mean + 1e-6), "_burst", self.bursts)
        after = np.concatenate((ring, rows))[-self.depth :] if self.depth else ring
        return np.column_stack([columns[c] for c in s.feature_names()]), after, ends


def _per_host(
    rows: DataFrame,
    settings: FeatureSettings,
    finish: Callable[[np.ndarray], np.ndarray],
    columns: Sequence[str],
    delay: int,
    keep: int,
) -> DataFrame:
    """Run each host's features through `finish`, which gives the double `columns`. A host remembers its last 29 rows and its averages."""
    metrics, columns = list(settings.metrics), list(columns)

    def step(chunk: Rows, before: tuple | None) -> tuple[pd.DataFrame, tuple]:
        running = RunningFeatures(settings)
        values = np.column_stack([chunk[m] for m in metrics])
        ring, averages = (np.reshape(x, (-1, len(metrics))) for x in before) if before else (values[:0], None)
        found, ring, averages = running.features(values, ring, averages)
        result = pd.DataFrame(finish(found), columns=columns)
        result.insert(0, "at", np.arange(len(result)))
        return result, (ring.ravel().tolist(), averages.ravel().tolist())

    result = in_order(
        on_clock(rows, delay, keep),
        ["host"],
        dict.fromkeys(metrics, "double"),
        step,
        dict.fromkeys(columns, "double"),
        "ring array<double>, averages array<double>",
    )
    return result.select("sample_id", "host", "ts", *columns, "late")


def feature_stream(
    rows: DataFrame, settings: FeatureSettings = FeatureSettings(), delay: int = DELAY_SECONDS, keep: int = KEEP_SECONDS
) -> DataFrame:
    """`sample_id, host, ts, <features>, late` of a sample stream, equal to `feature_table` on the same rows in whatever order they come."""
    return _per_host(rows, settings, lambda features: features, settings.feature_names(), delay, keep)


def detect_stream(
    rows: DataFrame, model: AnomalyModel, delay: int = DELAY_SECONDS, keep: int = KEEP_SECONDS
) -> DataFrame:
    """`sample_id, host, ts, <metrics>, score, is_anomaly, late`; late rows have neither score nor flag.

    Rows are scored where their features are computed, so the 88 features never leave the task.
    """
    if model.threshold is None:
        raise RuntimeError("Threshold not calibrated")
    settings = model.settings
    names, metrics = settings.feature_names(), list(settings.metrics)
    walk = model.scorer(rows.sparkSession).walk(packed=True)
    # A feature that the model knows and these settings do not give is 0.
    places = [names.index(s.feature) if s.feature in names else -1 for s in model.scaler]
    shown = [names.index(m) for m in metrics]
    units = np.array([10.0 ** quantum_digits(s.feature) for s in model.scaler])

    def finish(features: np.ndarray) -> np.ndarray:
        wide = np.column_stack((features, np.zeros(len(features))))
        return np.column_stack((features[:, shown], walk(np.floor(wide[:, places] * units + 0.4999))))

    scored = _per_host(rows, settings, finish, [*metrics, "score"], delay, keep)
    return scored.withColumn("is_anomaly", below_threshold(F.col("score"), model.threshold))


def late_rows(stream: DataFrame) -> DataFrame:
    """Rows that came too late to be placed, for a sink of their own."""
    return stream.filter("late")

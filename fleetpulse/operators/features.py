"""Ordered-window features of each host's metrics.

All frames count rows, not seconds, and follow `(ts, sample_id)` within a host. Every public function
takes samples and returns them with columns added; names that are not columns of the input are skipped.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from fleetpulse.plans.segments import SegmentPlan, core_rows, segmented
from fleetpulse.schema import IO_METRICS, METRICS, ROW_KEY

# Decay below which the past no longer changes a double.
NEGLIGIBLE = 1e-18
# Powers of the decay must stay representable inside one block.
SMALLEST_POWER = 1e-200
CODE_LIMIT = "spark.sql.codegen.hugeMethodLimit"


@dataclass(frozen=True)
class FeatureSettings:
    """What to compute; the defaults give 88 features of the 7 standard metrics."""

    metrics: Sequence[str] = tuple(METRICS)
    io_metrics: Sequence[str] = tuple(IO_METRICS)
    short_window: int = 5
    long_window: int = 30
    lag_periods: Sequence[int] = (1, 2, 3, 5)
    alphas: Sequence[float] = (0.1, 0.3)
    slope_window: int = 10
    burst_window: int = 10

    def __post_init__(self):
        names = [ema_suffix(a) for a in self.alphas]
        if len(set(names)) < len(names):
            raise ValueError(f"alphas {tuple(self.alphas)} give equal feature names {names}")

    def burst_metrics(self) -> list[str]:
        return [c for c in self.io_metrics if c in self.metrics]

    def feature_names(self) -> list[str]:
        """Feature names in the order in which models see them."""
        metrics = self.metrics
        return [
            *metrics,
            *[f"{c}_lag{k}" for c in metrics for k in self.lag_periods],
            *[f"{c}_{s}" for c in metrics for s in ("rmean_s", "rstd_s", "rmean_l", "rstd_l")],
            *[f"{c}_{ema_suffix(a)}" for c in metrics for a in self.alphas],
            *[f"{c}_slope" for c in metrics],
            *[f"{c}_burst" for c in self.burst_metrics()],
        ]

    def depth(self) -> int:
        """How many earlier rows the features other than the averages look at."""
        windows = (self.short_window, self.long_window, self.slope_window, self.burst_window)
        return max(max(windows) - 1, max(self.lag_periods, default=0))

    def rows_before(self) -> int:
        """How many earlier rows any feature of a row depends on."""
        return max(self.depth(), max((ema_memory(a) for a in self.alphas), default=0))


def ema_suffix(alpha: float) -> str:
    return f"ema{int(alpha * 10)}"


def ema_memory(alpha: float) -> int:
    """Rows after which an earlier value has decayed below double precision."""
    return 1 if alpha >= 1 else math.ceil(math.log(NEGLIGIBLE) / math.log(1 - alpha))


def _ema_block(alpha: float) -> int:
    return 1 if alpha >= 1 else max(1, math.floor(math.log(SMALLEST_POWER) / math.log(1 - alpha)))


def _over(keys: Sequence[str], order: str = "ts, sample_id", frame: str = "") -> str:
    """Window clause; the features are SQL text, since hundreds of them are slow to build call by call."""
    return f"over (partition by {', '.join(keys)} order by {order} {frame})"


def _back(column: str, rows: int) -> str:
    """The value `rows` rows earlier, as `_with_history` provides it."""
    return f"`{column}`" if rows == 0 else f"`__{column}_back{rows}`"


def _with_history(
    frame: DataFrame, columns: Sequence[str], depth: int, over: str, extra: Sequence[str] = ()
) -> DataFrame:
    """Add the last `depth` earlier values of each column, and `extra` expressions on the same window.

    Everything that looks back a few rows is arithmetic on these: a lag costs one step per row, while
    a sliding aggregate visits its whole frame again for each row (five times slower for 30 rows).
    """
    lags = [f"lag(`{c}`, {k}) {over} as {_back(c, k)}" for c in columns for k in range(1, depth + 1)]
    return frame.selectExpr("*", *lags, *extra)


def _with_deviation_sums(frame: DataFrame, windows: Mapping[str, Iterable[int]]) -> DataFrame:
    """Add, per column and window, the sum of differences between the last values and the current one,
    and the sum of their squares.

    The current value is the origin, so nothing cancels when they are subtracted later: it is one of the
    values itself, hence within a few deviations of their mean.
    """
    steps = {
        f"__step{k}_{c}": f"coalesce({_back(c, k)} - `{c}`, 0D)"
        for c, sizes in windows.items()
        for k in range(1, max(sizes, default=0))
    }
    sums = {}
    for c, sizes in windows.items():
        for rows in sorted(set(sizes)):
            terms = [f"`__step{k}_{c}`" for k in range(1, rows)]
            sums[f"__dev{rows}_{c}"] = " + ".join(terms) or "0D"
            sums[f"__sq{rows}_{c}"] = " + ".join(f"{t} * {t}" for t in terms) or "0D"
    return frame.selectExpr("*", *_named(steps)).selectExpr("*", *_named(sums))


def _mean(column: str, rows: int) -> str:
    return f"(`{column}` + `__dev{rows}_{column}` / least(rn + 1, {rows}))"


def lag_columns(columns: Sequence[str], periods: Iterable[int]) -> dict[str, str]:
    return {f"{c}_lag{k}": _back(c, k) for c in columns for k in periods}


def rolling_columns(columns: Sequence[str], short: int, long: int) -> dict[str, str]:
    """Mean and sample deviation over the last `short` and `long` rows, fewer at a host's start."""
    out = {}
    for c in columns:
        for tag, rows in (("s", short), ("l", long)):
            n, first, second = f"least(rn + 1, {rows})", f"`__dev{rows}_{c}`", f"`__sq{rows}_{c}`"
            spread = f"greatest(0D, {second} - {first} * {first} / {n})"
            out[f"{c}_rmean_{tag}"] = _mean(c, rows)
            out[f"{c}_rstd_{tag}"] = f"if(rn = 0, null, sqrt({spread} / ({n} - 1)))"
    return out


def slope_columns(columns: Sequence[str], rows: int) -> dict[str, str]:
    """Least-squares slope per row over the last `rows` rows; 0 until that many exist.

    On evenly spaced rows least squares is a fixed weighting of the values.
    """
    middle, spread = (rows - 1) / 2, rows * (rows * rows - 1) / 12
    out = {}
    for c in columns:
        terms = " + ".join(f"{middle - k}D * {_back(c, k)}" for k in range(rows))
        out[f"{c}_slope"] = f"coalesce(({terms}) / {spread}D, 0D)"
    return out


def burst_columns(columns: Sequence[str], rows: int) -> dict[str, str]:
    """Largest value over mean value of the last `rows` rows."""
    return {
        f"{c}_burst": f"greatest({', '.join(_back(c, k) for k in range(rows))}) / ({_mean(c, rows)} + 1e-6D)"
        for c in columns
    }


def _named(expressions: dict[str, str]) -> list[str]:
    return [f"{sql} as `{name}`" for name, sql in expressions.items()]


def _numbered(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add `rn`, the 0-based position of a row in its window partition."""
    return frame.selectExpr("*", f"cast(row_number() {_over(keys)} - 1 as bigint) as rn")


def _ema_blocks(alphas: Sequence[float]) -> dict[float, int]:
    """Rows per block for each alpha; one common size where that loses nothing, so sorts are shared."""
    sizes = {a: _ema_block(a) for a in alphas if a < 1}
    if not sizes:
        return {}
    common = min(sizes.values())
    if all((1 - a) ** common < NEGLIGIBLE for a in sizes):
        return dict.fromkeys(sizes, common)
    return sizes


def _ema_sums(frame: DataFrame, keys: Sequence[str], columns: Sequence[str], alphas: Sequence[float]) -> DataFrame:
    """Add `__sum_*`: the weighted sum over a row's block up to the row.

    An exponential average is a recursion, which no SQL window has. Unrolled it is
    `q**t * sum(w_i * x_i * q**-i)`, a running sum; blocks keep `q**-i` in range. The first row of a
    host has weight 1, every other row `alpha`.
    """
    blocks = _ema_blocks(alphas)
    sizes = sorted(set(blocks.values()))
    frame = frame.selectExpr("*", *[f"floor(rn / {size}) as __blk{size}" for size in sizes])
    for size in sizes:
        shared = [a for a in blocks if blocks[a] == size]
        place = f"cast(rn % {size} as double)"
        growth = [f"pow({1.0 - a!r}D, -{place}) as __up_{ema_suffix(a)}" for a in shared]
        over = _over([*keys, f"__blk{size}"], "rn", "rows between unbounded preceding and current row")
        sums = {
            f"__sum_{c}_{ema_suffix(a)}": f"sum(`{c}` * if(rn = 0, 1D, {a!r}D) * __up_{ema_suffix(a)}) {over}"
            f" / __up_{ema_suffix(a)}"
            for c in columns
            for a in shared
        }
        frame = frame.selectExpr("*", *growth).selectExpr("*", *_named(sums))
    return frame


def ema_columns(keys: Sequence[str], columns: Sequence[str], alphas: Sequence[float]) -> dict[str, str]:
    """Averages from the block sums: own block plus what the end of the previous block still weighs.

    A block is long enough that anything before the previous block has decayed to nothing.
    """
    out = {}
    blocks = _ema_blocks(alphas)
    for c in columns:
        for a in alphas:
            name = f"{c}_{ema_suffix(a)}"
            if a not in blocks:
                out[name] = f"`{c}`"
                continue
            size, local = blocks[a], f"`__sum_{name}`"
            over = _over(keys, f"__blk{size}, rn", "rows between unbounded preceding and 1 preceding")
            carried = f"last(if(rn % {size} = {size - 1}, {local}, null), true) {over}"
            decay = f"{1.0 - a!r}D / __up_{ema_suffix(a)}"
            out[name] = f"{local} + {decay} * coalesce({carried}, 0D)"
    return out


def _looking_back(
    samples: DataFrame,
    columns: Iterable[str],
    depth: int,
    plan: SegmentPlan | None,
    compute: Callable[[list[str]], dict[str, str]],
    windows: Sequence[int] = (),
) -> DataFrame:
    """`samples` plus the columns that `compute` derives from the last `depth` earlier rows."""
    present = [c for c in columns if c in samples.columns]
    frame, keys = segmented(samples, plan, before=depth)
    own = [f"`{c}`" for c in frame.columns]
    history = _with_history(_numbered(frame, keys), present, depth, _over(keys))
    history = _with_deviation_sums(history, dict.fromkeys(present, windows))
    return core_rows(history.selectExpr(*own, *_named(compute(present))))


def add_lags(
    samples: DataFrame,
    columns: Sequence[str] = METRICS,
    periods: Sequence[int] = (1, 2, 3, 5),
    plan: SegmentPlan | None = None,
) -> DataFrame:
    """Add `<c>_lag<k>`: the value `k` rows earlier on the same host."""
    return _looking_back(samples, columns, max(periods, default=0), plan, lambda c: lag_columns(c, periods))


def add_rolling_stats(
    samples: DataFrame,
    columns: Sequence[str] = METRICS,
    short_window: int = 5,
    long_window: int = 30,
    plan: SegmentPlan | None = None,
) -> DataFrame:
    """Add `<c>_rmean_s`, `_rstd_s`, `_rmean_l`, `_rstd_l`; a deviation of one row is NULL."""
    windows = [short_window, long_window]
    return _looking_back(samples, columns, max(windows) - 1, plan, lambda c: rolling_columns(c, *windows), windows)


def add_slope(
    samples: DataFrame,
    columns: Sequence[str] = METRICS,
    window: int = 10,
    plan: SegmentPlan | None = None,
) -> DataFrame:
    """Add `<c>_slope`: least-squares slope per row over the last `window` rows, 0 before that."""
    return _looking_back(samples, columns, window - 1, plan, lambda c: slope_columns(c, window))


def add_burstiness(
    samples: DataFrame,
    columns: Sequence[str] = IO_METRICS,
    window: int = 10,
    plan: SegmentPlan | None = None,
) -> DataFrame:
    """Add `<c>_burst`: maximum over mean of the last `window` rows."""
    return _looking_back(samples, columns, window - 1, plan, lambda c: burst_columns(c, window), [window])


def add_ema(
    samples: DataFrame,
    columns: Sequence[str] = METRICS,
    alphas: Sequence[float] = (0.1, 0.3),
    plan: SegmentPlan | None = None,
) -> DataFrame:
    """Add `<c>_ema<int(10 * alpha)>`: y = (1 - alpha) * previous y + alpha * x, starting at x."""
    present = [c for c in columns if c in samples.columns]
    frame, keys = segmented(samples, plan, before=max((ema_memory(a) for a in alphas), default=0))
    own = [f"`{c}`" for c in frame.columns]
    sums = _ema_sums(_numbered(frame, keys), keys, present, alphas)
    return core_rows(sums.selectExpr(*own, *_named(ema_columns(keys, present, alphas))))


class _OrderedFeatures:
    """Features of ordered rows, a batch at a time, by the formulas of the functions above, for all metrics and hosts of a batch at once.

    Arrays are (metric, row). A NULL is a 0 marked in `null`. Between batches stay the last `depth` rows and, for each average, the
    sum of the block so far and the end of the block before.
    """

    def __init__(self, settings: FeatureSettings):
        self.settings, self.metrics = settings, list(settings.metrics)
        self.bursts = [self.metrics.index(c) for c in settings.burst_metrics()]
        self.blocks = _ema_blocks(settings.alphas)
        self.depth = settings.depth()
        many = len(self.metrics)
        self.values, self.nulls = np.zeros((many, self.depth)), np.ones((many, self.depth), bool)
        self.sums = {a: (np.zeros(many), np.zeros(many, bool), np.zeros(many)) for a in self.blocks}

    def _averages(self, x: np.ndarray, null: np.ndarray, rn: np.ndarray, alpha: float) -> np.ndarray:
        size, out = self.blocks[alpha], np.empty_like(x)
        total, seen, carried = self.sums[alpha]
        cuts = np.flatnonzero(rn % size == 0).tolist()
        for begin, end in zip([0, *cuts], [*cuts, x.shape[1]]):
            if begin == end:
                continue
            place = int(rn[begin] % size)
            if place == 0:
                total, seen = np.zeros_like(total), np.zeros_like(seen)
                if rn[begin] == 0:
                    carried = np.zeros_like(carried)
            up = (1.0 - alpha) ** -np.arange(place, place + end - begin, dtype=float)
            terms = x[:, begin:end] * alpha * up
            if rn[begin] == 0:
                terms[:, 0] = x[:, begin]
            terms[:, 0] += total
            sums = np.cumsum(terms, axis=1)
            local = sums / up
            out[:, begin:end] = local + (1.0 - alpha) / up * carried[:, None]
            known = ~null[:, begin:end]
            if not known.all():
                out[:, begin:end][~(np.logical_or.accumulate(known, axis=1) | seen[:, None])] = 0.0
            total, seen = sums[:, -1], seen | known.any(axis=1)
            if place + end - begin == size:
                carried = np.where(seen, local[:, -1], carried)
        self.sums[alpha] = total, seen, carried
        return out

    def features(self, x: np.ndarray, null: np.ndarray, rn: np.ndarray) -> dict[str, np.ndarray]:
        """The features by name; `rn` is the position of a row within its host."""
        s, n, depth = self.settings, x.shape[1], self.depth
        values, nulls = np.concatenate((self.values, x), axis=1), np.concatenate((self.nulls, null), axis=1)
        whole = not nulls.any() and int(rn.min()) >= depth  # every row has all its values before

        def back(k: int) -> np.ndarray:
            return values[:, depth - k : depth - k + n]

        def absent(k: int) -> np.ndarray:
            return nulls[:, depth - k : depth - k + n] | (rn < k)

        out: dict[str, np.ndarray] = {}

        def name(found: np.ndarray, tag: str, which: Sequence[int] | None = None) -> None:
            for place, j in enumerate(range(len(self.metrics)) if which is None else which):
                out[f"{self.metrics[j]}{tag}"] = found[place]

        name(x, "")
        for k in s.lag_periods:
            name(back(k) if whole else np.where(absent(k), 0.0, back(k)), f"_lag{k}")
        sizes = {s.short_window, s.long_window, s.burst_window}
        first, second = np.zeros_like(x), np.zeros_like(x)
        means, spreads = {}, {}
        for size in range(1, max(sizes) + 1):
            if size > 1:
                step = back(size - 1) - x
                if not whole:
                    step[absent(size - 1) | null] = 0.0
                first += step
                step *= step
                second += step
            if size in sizes:
                rows = np.minimum(rn + 1, size)
                means[size] = np.where(null, 0.0, x + first / rows)
                spreads[size] = np.sqrt(np.maximum(0.0, second - first * first / rows) / np.maximum(rows - 1, 1))
                spreads[size][:, rn == 0] = 0.0
        for tag, size in (("s", s.short_window), ("l", s.long_window)):
            name(means[size], f"_rmean_{tag}")
            name(spreads[size], f"_rstd_{tag}")
        for alpha in s.alphas:
            name(self._averages(x, null, rn, alpha) if alpha in self.blocks else x, f"_{ema_suffix(alpha)}")
        rows = s.slope_window
        slope = sum(((rows - 1) / 2 - k) * back(k) for k in range(rows)) / (rows * (rows * rows - 1) / 12)
        if not whole:
            slope[np.logical_or.reduce([absent(k) for k in range(rows)])] = 0.0
        name(slope, "_slope")
        if self.bursts:
            which = self.bursts
            most = reduce(np.maximum, [(back(k) if whole else np.where(absent(k), -np.inf, back(k)))[which] for k in range(s.burst_window)])
            burst = most / (means[s.burst_window][which] + 1e-6)
            burst[null[which]] = 0.0
            name(burst, "_burst", which)
        if depth:
            self.values, self.nulls = values[:, -depth:], nulls[:, -depth:]
        return out


def feature_table(
    samples: DataFrame,
    settings: FeatureSettings = FeatureSettings(),
    keep: Sequence[str] = ROW_KEY,
    plan: SegmentPlan | None = None,
) -> DataFrame:
    """All features of every sample, missing values as 0.0, after the columns in `keep`.

    One shuffle by host and one sort; then a task goes through its ordered rows in Arrow batches and keeps no more of
    them than the last few. As windows of SQL the some 300 expressions cost several times as much for a row.
    """
    metrics = list(settings.metrics)
    missing = [m for m in metrics if m not in samples.columns]
    if missing:
        raise ValueError(f"Missing metric columns: {missing}")
    narrow = samples.select(*dict.fromkeys([*keep, "sample_id", "host", "ts", *metrics]))
    # A row of 88 features makes one method of generated code that Java never compiles; above this size Spark cuts it up.
    samples.sparkSession.conf.set(CODE_LIMIT, "8000")
    frame, keys = segmented(narrow, plan, before=settings.rows_before())
    frame = frame.repartition(*keys).sortWithinPartitions(*keys, "ts", "sample_id")
    names = [n for n in settings.feature_names() if n not in keep]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running, last, position = _OrderedFeatures(settings), None, 0
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            own = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            begins = np.zeros(n, bool)
            for key in own:
                begins[1:] |= key[1:] != key[:-1]
            begins[0] = last != tuple(key[0] for key in own)
            last = tuple(key[-1] for key in own)
            at = np.arange(n)
            rn = at - np.maximum.accumulate(np.where(begins, at, 0 if begins[0] else -position))
            position = int(rn[-1]) + 1
            columns = [batch.column(m).cast(pa.float64()) for m in metrics]
            null = np.stack([c.is_null().to_numpy(zero_copy_only=False) for c in columns])
            values = np.stack([c.fill_null(0.0).to_numpy() for c in columns])
            with np.errstate(all="ignore"):
                found = running.features(values, null, rn)
            table = [*[batch.column(c) for c in keep], *[pa.array(found[c]) for c in names]]
            result = pa.RecordBatch.from_arrays(table, [*keep, *names])
            core = batch.column("in_core")
            yield result if core.true_count == n else result.filter(core)

    kept = [StructField(c, narrow.schema[c].dataType) for c in keep]
    return frame.mapInArrow(compute, StructType([*kept, *[StructField(c, DoubleType()) for c in names]]))

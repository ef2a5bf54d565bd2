"""A stream whose rows come out of order gives what the batch operator gives on all rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetpulse.operators.alerts import apply_cooldown, default_rules, raise_alerts
from fleetpulse.operators.features import FeatureSettings, feature_table
from fleetpulse.operators.rates import counter_rates
from fleetpulse.schema import METRICS
from fleetpulse.sources.views import counters
from fleetpulse.streaming import ordered
from fleetpulse.streaming.alerts import alert_stream, deliver
from fleetpulse.streaming.detection import RunningFeatures, feature_stream
from fleetpulse.streaming.ingest import ingest_stream
from fleetpulse.streaming.rates import counter_rate_stream

NOW = {"availableNow": True}
FILES, DELAY, AGAIN = 10, 3 * 86400, 20


@pytest.fixture(scope="module")
def files(spark, samples, tmp_path_factory):
    """Files in the order of arrival, which is up to DELAY after a row's time; the last one brings rows again which are long past."""
    path = str(tmp_path_factory.mktemp("source"))
    delayed = F.col("ts") + F.pmod(F.xxhash64("sample_id"), F.lit(DELAY))
    start, end = samples.agg(F.min("ts"), F.max("ts")).first()
    part = F.floor((delayed - start) * FILES / F.lit(end - start + DELAY + 1))
    dealt = samples.withColumn("part", part).drop("y_true").toPandas()
    schema = samples.drop("y_true").schema
    parts = [dealt[dealt["part"] == i] for i in range(FILES)]
    assert all(b["ts"].min() < a["ts"].max() for a, b in zip(parts, parts[1:]))  # truly out of order
    for frame in (*parts, dealt.nsmallest(AGAIN, "ts")):
        spark.createDataFrame(frame.drop(columns="part").sample(frac=1, random_state=1), schema).coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.fixture
def stream(spark, files):
    schema = spark.read.parquet(files).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(files)


def run(spark, stream, build, samples, tmp_path):
    """The table of the whole stream, and how many rows had come out before the heartbeat that ended it."""
    beats, table, checkpoint = (str(tmp_path / x) for x in ("beats", "table", "checkpoint"))
    built = build(ordered.with_heartbeats(stream, beats))
    deliver(built, table, checkpoint, NOW).awaitTermination()
    early = spark.read.parquet(table).filter("not late").count()
    ordered.heartbeat(spark, beats, samples.agg(F.max("ts")).first()[0] + DELAY + 1)
    deliver(built, table, checkpoint, NOW).awaitTermination()
    return spark.read.parquet(table), early


def test_features(spark, samples, stream, tmp_path, monkeypatch):
    result, early = run(spark, stream, lambda rows: feature_stream(rows, delay=DELAY), samples, tmp_path)
    names = FeatureSettings().feature_names()
    assert result.filter("late").count() == AGAIN and result.select("batch").distinct().count() > FILES / 2
    ours = result.filter("not late").toPandas().sort_values("sample_id", ignore_index=True)
    assert len(ours) / 2 < early < len(ours)  # rows are released as time goes on, and the last ones by the heartbeat
    batch = feature_table(samples).toPandas().sort_values("sample_id", ignore_index=True)
    assert ours["sample_id"].tolist() == batch["sample_id"].tolist()
    np.testing.assert_allclose(ours[names], batch[names], rtol=1e-7, atol=1e-4)


def test_rates(spark, samples, stream, tmp_path):
    names = ["read_bytes", "write_bytes", "sent_bytes", "recv_bytes"]
    result, _ = run(spark, stream, lambda rows: counter_rate_stream(counters(rows), names, DELAY), samples, tmp_path)
    assert result.filter("late").count() == AGAIN
    columns = ["sample_id", *[f"{n}_rate" for n in names]]
    batch = counter_rates(counters(samples), names).select(columns)
    assert sorted(result.filter("not late").select(columns).collect()) == sorted(batch.collect())


def test_alert_cooldown(spark, samples, stream, tmp_path):
    rules = default_rules(with_anomalies=False)
    result, early = run(spark, stream, lambda rows: alert_stream(rows, rules, 40_000, DELAY), samples, tmp_path)
    batch = apply_cooldown(raise_alerts(samples, rules), 40_000)
    assert 0 < early < batch.count() < raise_alerts(samples, rules).count()
    assert sorted(result.filter("not late").select(batch.columns).collect()) == sorted(batch.collect())


def test_rows_behind_their_host_are_late_and_far_older_ones_are_counted(spark, tmp_path):
    schema = "sample_id long, host string, ts long, c double"
    source, t = str(tmp_path / "rows"), 1_700_000_000
    batches = [
        [(1, "a", t + 10, 1.0), (2, "b", t + 5, 1.0)],
        [(3, "a", t + 900, 5.0)],
        [(4, "a", t + 5, 0.0), (5, "b", t + 700, 2.0), (6, "a", t + 10, 9.0), (2, "b", t + 5, 1.0), (7, "c", t - 9_000, 3.0), (8, "c", t + 20, 3.0)],
        [(9, "a", t + 2_000, 6.0), (10, "a", t + 7, 0.0)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = deliver(counter_rate_stream(stream, ["c"], 100, 5_000), str(tmp_path / "t"), str(tmp_path / "c"), NOW)
    query.awaitTermination()
    found = {(r.sample_id, r.late): r.c_rate for r in spark.read.parquet(str(tmp_path / "t")).collect()}
    # The second 2 repeats a row, and 10 stands before a row already released. 4, 6 and 8 are behind the watermark, but not
    # before a released row of their host, so they are placed. 9 waits, as nothing newer has come.
    assert {k[0] for k in found if k[1]} == {2, 10}
    assert {k[0] for k in found if not k[1]} == {1, 2, 3, 4, 5, 6, 8}
    assert found[1, False] == pytest.approx(1 / 5)
    assert found[6, False] == 0.0 and found[5, False] == pytest.approx(1 / 695) and found[3, False] == 0.0
    dropped = [s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"]]
    assert sum(dropped) == 1  # 7


@pytest.mark.parametrize("chunk", [1, 7, 64, 1000])
def test_running_features_do_not_depend_on_chunks(chunk):
    rng = np.random.default_rng(3)
    settings = FeatureSettings()
    values = rng.uniform(0, 100, (150, 7))
    running, whole = RunningFeatures(settings), RunningFeatures(settings).features(values, values[:0], None)[0]
    ring, averages, parts = values[:0], None, []
    for at in range(0, len(values), chunk):
        found, ring, averages = running.features(values[at : at + chunk], ring, averages)
        parts.append(found)
        assert len(ring) == min(at + len(found), settings.depth())
    np.testing.assert_allclose(np.concatenate(parts), whole, rtol=1e-12)
    frame = pd.DataFrame(whole, columns=settings.feature_names())
    np.testing.assert_allclose(frame["cpu_pct_ema3"], pd.Series(values[:, 0]).ewm(alpha=0.3, adjust=False).mean())


def test_ingest(spark, samples, stream, tmp_path):
    path = str(tmp_path / "store")
    dirty = stream.withColumn("host", F.when(F.col("sample_id") % 10 != 0, F.col("host")))
    query = ingest_stream(dirty, path, str(tmp_path / "c"), NOW)
    query.awaitTermination()
    stored, rejected = spark.read.parquet(path), spark.read.parquet(f"{path}_rejected")
    assert stored.count() + rejected.count() == samples.count() + AGAIN
    assert rejected.filter("missing != 'host'").count() == 0
    counted = [p["observedMetrics"]["ingest"] for p in query.recentProgress if p["observedMetrics"]]
    assert sum(c["accepted"] for c in counted) == stored.count()
    assert stored.filter("sample_id % 10 = 0").count() == 0 and set(METRICS) <= set(stored.columns)


class Store:
    """The state of one key, with counts of what is moved."""

    def __init__(self):
        self.value, self.map, self.timers, self.put, self.got = None, {}, set(), 0, 0

    def getValueState(self, name, schema):
        return self

    def getMapState(self, name, key, value):
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def updateValue(self, key, value):
        self.map[key], self.put = value, self.put + 1

    def getValue(self, key):
        self.got += 1
        return self.map[key]

    def removeKey(self, key):
        del self.map[key]

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def test_waiting_rows_are_not_moved_with_each_batch(monkeypatch):
    """A micro-batch writes its own rows and reads those that are released; what waits stays where it is, in pieces."""
    monkeypatch.setattr(ordered, "HELD_ROWS", 700)
    seen = []

    def step(chunk, before):
        seen.extend(zip(chunk["ts"].tolist(), chunk["sample_id"].tolist()))
        assert len(chunk["ts"]) <= 64
        return pd.DataFrame({"at": np.arange(len(chunk["ts"])), "x": chunk["c"]}), ((before or (0,))[0] + len(chunk["ts"]),)

    kinds = {"ts": "long", "sample_id": "long", "c": "double", "name": "string"}
    output = ["sample_id", "ts", "host", "x", "late"]
    store = Store()
    flow = ordered._InOrder(["host"], kinds, ["ts", "sample_id"], output, ["x"], step, "n long", 64)
    flow.init(store)

    rng = np.random.default_rng(5)
    rows = pd.DataFrame({"ts": rng.integers(0, 50 * ordered.SLOT_SECONDS, 5000), "sample_id": np.arange(5000), "c": rng.uniform(size=5000)})
    rows["name"] = [None if i % 7 == 0 else f"é{i}" for i in range(5000)]
    given, horizon = [], -1
    for at in range(0, 5000, 1000):
        given += list(flow._advance(("a",), iter([rows[at : at + 500], rows[at + 500 : at + 1000]]), horizon))
    assert not given and store.got == 0 and store.put <= 50 * 10 and len(store.value[0]) == 50
    assert store.timers == {int(rows["ts"].min()) * 1000 + 1}

    horizon = 20 * ordered.SLOT_SECONDS + 100
    before = len(store.map)
    given += list(flow._advance(("a",), iter([rows[:10]]), horizon))  # ten rows again, one of them or more released
    waits = rows[rows["ts"] > horizon]
    assert store.got <= before * 21 / 50 + 21 and {s for s, _ in store.map} == set((waits["ts"] // ordered.SLOT_SECONDS).tolist())
    given += list(flow._advance(("a",), iter([rows[:1].assign(ts=5)]), horizon))  # behind the released ones
    given += list(flow._advance(("a",), iter(()), 51 * ordered.SLOT_SECONDS))
    assert not store.map and not store.timers and store.value[-1] == 5000
    assert seen == sorted(zip(rows["ts"].tolist(), rows["sample_id"].tolist()))
    given = pd.concat(given)
    assert given["late"].sum() == 11 and given.loc[given["late"], "x"].isna().all()
    ours = given[~given["late"]].sort_values("sample_id")
    assert ours["x"].tolist() == rows["c"].tolist()

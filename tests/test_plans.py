import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetpulse.plans.joins import salted_join
from fleetpulse.plans.ranks import exact_percentile, percentiles, precedes_rank, value_at_rank
from fleetpulse.plans.totals import running_totals


@pytest.fixture(scope="module")
def numbers(spark):
    """3,000 values, a third of them equal."""
    return spark.range(3000).selectExpr("id", "if(id % 3 = 0, 500D, cast(pmod(hash(id), 1000) as double)) as v").cache()


@pytest.mark.parametrize("buckets", [64, 1 << 14])
def test_ranks_against_numpy(numbers, buckets):
    values = np.sort(numbers.toPandas()["v"].to_numpy())
    for rank in (0, 777, 1500, 2999):
        assert value_at_rank(numbers, "v", rank, buckets) == values[rank]
    assert value_at_rank(numbers, "v", 3000, buckets) is None
    for fraction in (0.0, 0.123, 0.5):
        expected = np.percentile(values, fraction * 100)
        assert exact_percentile(numbers, "v", fraction, buckets) == pytest.approx(expected, rel=1e-12)


@pytest.mark.parametrize("rank", [0, 1200, 2999, 3000])
def test_first_rows_by_rank(numbers, rank):
    chosen = numbers.filter(precedes_rank(numbers, "v", "id", rank, buckets=64)).toPandas()
    expected = numbers.toPandas().sort_values(["v", "id"]).head(rank)
    assert sorted(chosen["id"]) == sorted(expected["id"])


def test_values_far_apart(spark):
    """Powers of two are dealt badly by equal parts, and long integers do not fit a double."""
    powers = [2.0**k for k in range(-300, 300)] + [0.0, -5.0, 1e300]
    rows = spark.createDataFrame([(v,) for v in powers], "v double")
    for rank in (0, 1, 77, 602):
        assert value_at_rank(rows, "v", rank) == sorted(powers)[rank]
    longs = [2**62 + k for k in range(50)] + [-(2**61)]
    rows = spark.createDataFrame([(v,) for v in longs], "v long")
    assert [value_at_rank(rows, "v", r, 64) for r in (0, 25, 50)] == [sorted(longs)[r] for r in (0, 25, 50)]


def test_groups_are_searched_in_the_same_passes(spark, numbers):
    """One group holds most rows, one has a single row, one only nulls; the number of passes is that of one search."""
    rows = numbers.selectExpr("if(id = 7, 'one', if(id % 50 = 3, 'few', if(id % 50 = 4, null, 'hot'))) as g", "if(id % 50 = 5, null, v) as v")
    rows = rows.unionByName(spark.createDataFrame([("none", None)], "g string, v double"))
    found = {r.g: r.value for r in percentiles(rows, "v", 0.3, ["g"]).collect()}
    frame = rows.toPandas().dropna(subset="v")
    expected = frame.groupby("g", dropna=False)["v"].quantile(0.3)
    assert len(found) == 4 and "none" not in found
    for group, value in expected.items():
        assert found[None if group != group or group is None else group] == pytest.approx(value)


def test_percentile_of_nothing(spark):
    assert exact_percentile(spark.createDataFrame([], "v double"), "v", 0.5) is None


@pytest.mark.parametrize("buckets, per_group", [(1, 1000), (7, 1000), (40, 3), (40, 1)])
def test_running_totals(spark, buckets, per_group):
    rows = spark.range(500).selectExpr("cast(id * id as double) as k", "pmod(hash(id), 9) as a", "id % 5 as b")
    result = running_totals(rows, "k", ["a", "b"], following=["b"], buckets=buckets, buckets_per_group=per_group)
    ours = result.toPandas().sort_values("k", ignore_index=True)
    assert ours["cum_a"].tolist() == ours["a"].cumsum().tolist()
    assert ours["cum_b"].tolist() == ours["b"].cumsum().tolist()
    assert ours["next_b"].tolist()[:-1] == ours["b"].tolist()[1:] and np.isnan(ours["next_b"].iloc[-1])


def test_running_totals_of_nothing_and_of_nulls(spark):
    rows = spark.createDataFrame([(1.0, 2), (None, 5), (3.0, 4)], "k double, a int")
    assert sorted(r["cum_a"] for r in running_totals(rows, "k", ["a"]).collect()) == [2, 6]
    assert running_totals(rows.limit(0), "k", ["a"]).count() == 0


def test_running_totals_keep_rows_apart(spark, plan_of):
    rows = spark.range(5000).selectExpr("cast(id as double) as k", "1 as a")
    plan = plan_of(running_totals(rows, "k", ["a"], buckets=16))
    single = [line for line in plan.splitlines() if "SinglePartition" in line]
    assert all("total_a" in plan.split(line)[1][:2500] for line in single)


def test_salted_join_keeps_every_row(spark):
    rows = spark.range(1000).selectExpr("id as sample_id", "if(id < 900, 'hot', concat('h', id)) as host")
    lookup = spark.createDataFrame([("hot", 1), ("h950", 2)], "host string, x int")
    joined = salted_join(rows, lookup, ["host"])
    assert joined.count() == 1000
    assert joined.agg(F.sum("x")).first()[0] == 902

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadspark.operators import experiments as exp


def test_percentiles_close_in_on_their_ranks(spark, monkeypatch):
    monkeypatch.setattr(exp, "MOST_LISTED", 5)
    monkeypatch.setattr(exp, "BINS", 8)
    rng = random.Random(2)
    groups = {
        "even": [rng.random() for _ in range(700)],
        "heavy": [10 ** rng.uniform(-9, 9) * rng.choice([-1, 1]) for _ in range(301)],
        "ties": [rng.choice([0.0, 1.0, 1.0, 2.0]) for _ in range(200)],
        "wide": [-1.7e308, 1.7e308, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0],
        "one": [3.5],
        None: [1.0, 2.0],
    }
    rows = [(k, v) for k, vs in groups.items() if k is not None for v in vs] + [("one", None)]
    got = {(r.k, r.share): r.result for r in exp.exact_percentiles(spark.createDataFrame(rows, "k string, value double"), ["k"], [0.0, 0.5, 0.95]).collect()}
    for k, vs in groups.items():
        for p in (0.0, 0.5, 0.95) if k else ():
            assert got[k, p] == pytest.approx(np.percentile(vs, 100 * p), rel=1e-12), (k, p)


def test_aggregate_of_a_group_with_all_rows(spark, monkeypatch):
    n = 60_000
    runs = spark.range(n).select(F.lit("a").alias("scenario_id"), F.lit("s").alias("strategy_id"), (F.col("id") % 3 > 0).alias("success"), (F.col("id") * 7919 % n).cast("double").alias("travel_time_s"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("rejections"))
    metrics = ["travel_time_s", "rejections"]
    plain = exp.aggregate(runs, metrics).collect()
    monkeypatch.setattr(exp, "MOST_LISTED", 1000)
    got = exp.aggregate(runs, metrics)
    assert got.columns == exp.aggregate(runs.limit(3), metrics).columns
    assert [pytest.approx(r.asDict()) for r in plain] == [r.asDict() for r in got.collect()]


SPEC = "scenario_id string, repetition int, seed int, count int, start_s double, end_s double, duration_s double, step_s double, factor double, run_s double, action string"


def test_random_events_of_the_sample(spark):
    edges = spark.createDataFrame([(k,) for k in (3, 5, 8, 9)], "edge long")
    spec = spark.createDataFrame([("c", r, 42, 2, 10.0, 90.0, 5.0, 2.0, 0.3, 96.0, a) for r, a in ((1, "speed_factor"), (2, "close"))], SPEC)
    rows = exp.random_events(spec, edges, spark.createDataFrame([("c", 4)], "scenario_id string, edge long")).collect()
    for rep, actions in ((1, ["speed_factor", "speed_factor"]), (2, ["close", "open"])):
        mine = [r for r in rows if r.repetition == rep]
        assert len(mine) == 4 and len({r.edge for r in mine}) == 2
        for edge in {r.edge for r in mine}:
            a, b = sorted((r for r in mine if r.edge == edge), key=lambda r: r.t)
            assert b.t - a.t == 6 and a.t % 2 == 0 and 10 <= a.t <= 90
            assert [a.action, b.action] == actions and [a.value, b.value] == [0.3, 1.0]


@pytest.mark.parametrize(("change", "said"), [({"start_s": 11.0, "end_s": 11.5}, "no tick"), ({"run_s": 95.0}, "behind the run"), ({"count": 3}, "more random events")])
def test_random_events_that_do_not_fit_raise(spark, change, said):
    spec = spark.createDataFrame([("c", 1, 42, 2, 10.0, 90.0, 5.0, 2.0, 0.3, 96.0, "close")], SPEC).withColumns({k: F.lit(v) for k, v in change.items()})
    with pytest.raises(Exception, match=said):
        exp.random_events(spec, spark.createDataFrame([(1,), (2,)], "edge long")).collect()


def test_random_events_on_edges_set_by_hand_raise(spark):
    spec = spark.createDataFrame([("c", 1, 42, 2, 10.0, 90.0, 5.0, 2.0, 0.3, 96.0, "close")], SPEC)
    edges = spark.createDataFrame([(1,), (2,)], "edge long")
    with pytest.raises(ValueError, match="by hand"):
        exp.random_events(spec, edges, spark.createDataFrame([("c", 2)], "scenario_id string, edge long"))


def test_permutations_meet_every_place_once(spark):
    rows = spark.range(1, 40).select(F.col("id").alias("n"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("key")).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    got = rows.withColumn("at", exp.permuted(F.col("key"), F.col("k"), F.col("n"))).groupBy("n", "key").agg(F.sort_array(F.collect_list("at")).alias("at")).collect()
    assert len(got) == 78 and all(r["at"] == list(range(r.n)) for r in got)


def test_random_draws_are_even(spark):
    seeds, n = 4000, 7
    spec = spark.range(seeds).select(F.lit("c").alias("scenario_id"), F.lit(1).alias("repetition"), F.col("id").alias("seed"), F.lit(2).alias("count"), *(F.lit(v).alias(c) for c, v in (("start_s", 10.0), ("end_s", 28.0), ("duration_s", 5.0), ("step_s", 2.0), ("factor", 0.3))))
    # a repetition for each seed tells the draws apart, and the key is their sum
    spec = spec.withColumn("repetition", F.col("seed").cast("int")).withColumn("seed", F.lit(1))
    rows = exp.random_events(spec, spark.range(n).withColumnRenamed("id", "edge")).where("value < 1").groupBy("repetition").agg(F.sort_array(F.collect_list("edge")).alias("pair"), F.collect_list("t").alias("t")).collect()
    assert len(rows) == seeds

    def chi_squared(values, cells):
        counts = {c: 0 for c in cells}
        for v in values:
            counts[v] += 1
        mean = len(values) / len(cells)
        return sum((c - mean) ** 2 / mean for c in counts.values())

    pairs = [(a, b) for a in range(n) for b in range(a + 1, n)]
    assert chi_squared([tuple(r["pair"]) for r in rows], pairs) < 45.3  # 20 degrees of freedom, 0.999
    assert chi_squared([t for r in rows for t in r["t"]], [2.0 * k for k in range(5, 15)]) < 27.9  # 9 degrees, 0.999
    ticks = [(a, b) for a in range(10) for b in range(10)]
    assert chi_squared([tuple(int(t / 2) - 5 for t in r["t"]) for r in rows], ticks) < 148.3  # 99 degrees, 0.999

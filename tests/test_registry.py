import importlib

from roadspark.plans import registry


def test_sql_belongs_to_registered_queries():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert len(registry.queries()) > 120


def test_entry_module_has_all():
    entry = importlib.import_module("__spark_entry__")
    assert set(registry.queries()) <= set(entry.queries())


def test_streams_equal_batches(spark, tmp_path):
    from roadspark.operators import controls
    from roadspark.streaming import feeds

    rows = [(k % 3, float(k), k, [1.0, 1.5, 1.6, 0.9, 2.0, 2.05][k % 6], k % 5 == 0) for k in range(40)]
    costs = spark.createDataFrame(rows, "edge long, t double, seq long, factor double, explicit boolean").coalesce(1)
    feeds.configure(spark)
    costs.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(costs.schema).parquet(f"{tmp_path}/in")
    got = feeds.run_available(feeds.cost_changes(stream), f"{tmp_path}/out").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, controls.published_cost_changes(costs).collect()))

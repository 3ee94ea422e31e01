import json
import random

from roadspark.sources import readers


def test_collections_are_read_in_blocks(spark, tmp_path):
    rng = random.Random(3)
    odd = ['plain', 'a } b { c', 'say "hi" \\ {', '}}}', '{"type":"Feature"}', "é中", "\\", '"', "line\nbreak"]
    want = {}
    for name in ("one", "two"):
        features = []
        for k in range(400):
            props = {"edge": k, "name": rng.choice(odd), "other": rng.choice(odd)}
            kind = rng.choice(["LineString", "GeometryCollection", None])
            line = {"type": "LineString", "coordinates": [[float(k), 1.0], [2.0, 3.5]]}
            g = line if kind == "LineString" else {"type": kind, "geometries": [line]} if kind else None
            f = {"type": "Feature", "properties": props, "geometry": g}
            f = {"id": f"f{k}", **f} if k % 3 else {"geometry": g, "type": "Feature", "properties": props}
            features.append(f)
            want[name, k] = (f.get("id", str(k)), props["name"], 1 if g else 0)
        whole = {"type": "FeatureCollection", "name": "a { \" b", "crs": {"type": "name", "properties": {"name": "CRS84"}}, "features": features, "bbox": [0, 1], "more": {"x": {"y": "}"}}}
        (tmp_path / f"{name}.json").write_text(json.dumps(whole, indent=None if name == "one" else 1, ensure_ascii=name == "one") + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 10
        rows = readers.read_roads_geojson(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 800
    got = sorted((r.feature_ordinal, r.feature_id, r.properties["name"], len(r.parts)) for r in rows)
    assert got == sorted((k, *v) for (_, k), v in want.items())
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "e.json").write_text('{"type":"FeatureCollection","features":[]}')
    assert readers.read_roads_geojson(spark, str(tmp_path / "empty")).count() == 0


def test_playback_written_in_lines_gives_the_documents(spark, tmp_path):
    import json

    from pyspark.sql import functions as F

    from roadspark.sources import sinks

    runs = spark.createDataFrame([("b/1", 2.5), ("a", None), ('c"', 1.0)], "run_id string, step_s double")
    n = spark.range(3000)
    vehicles = n.select(F.when(F.col("id") % 10 < 9, "b/1").otherwise("a").alias("run_id"), (F.col("id") * 7 % 3001).alias("run"), F.array(F.array(F.col("id").cast("double"))).alias("samples"), F.when(F.col("id") % 3 > 0, "x").alias("number"))
    sections = {"vehicles": vehicles.union(vehicles.limit(5)), "edge_kpis": n.limit(4).select(F.lit("a").alias("run_id"), F.col("id").alias("edge"))}
    sinks.write_playback(runs, sections, str(tmp_path / "out"), parts=6)
    want = {r.run_id: json.loads(r.value) for r in sinks.playback(runs, sections).collect()}
    folders = sorted((tmp_path / "out").glob("run=*"))
    got = [json.loads("".join(f.read_text() for f in sorted(folder.glob("part-*")))) for folder in folders]
    assert {g["run_id"]: g for g in got} == want and [g["run_id"] for g in got] == sorted(want)
    assert max(len(list(folder.glob("part-*"))) for folder in folders) > 1

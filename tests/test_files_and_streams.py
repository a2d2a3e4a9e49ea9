import datetime as dt

from pyspark.sql import functions as F

from ridgeline.operators import series
from ridgeline.sources import files
from ridgeline.streaming import sensors


def test_gpx_points(spark, tmp_path):
    (tmp_path / "a.gpx").write_text(
        '<gpx><trk><trkseg><trkpt lat="47.5" lon="7.25"><ele>310.5</ele><time>2024-05-01T10:00:00Z</time></trkpt>'
        '<trkpt lat="47.6" lon="7.26"></trkpt></trkseg></trk></gpx>'
    )
    rows = files.read_gpx(spark, str(tmp_path)).orderBy("lat").collect()
    assert [(r.lat, r.lon, r.ele) for r in rows] == [(47.5, 7.25, 310.5), (47.6, 7.26, None)]
    assert rows[0].time == dt.datetime(2024, 5, 1, 10) and rows[1].time is None


def test_osm_lines_skip_missing_nodes(spark, tmp_path):
    (tmp_path / "a.osm").write_text(
        '<osm><node id="1" lat="1.0" lon="2.0"/><node id="2" lat="1.5" lon="2.5"><tag k="name" v="b"/></node>'
        '<way id="9"><nd ref="2"/><nd ref="7"/><nd ref="1"/><tag k="highway" v="path"/></way></osm>'
    )
    nodes, ways = (files.read_osm(spark, str(tmp_path), k) for k in ("node", "way"))
    (row,) = files.way_lines(ways, nodes).collect()
    assert row.tags == {"highway": "path"} and [(p.lon, p.lat) for p in row.line] == [(2.5, 1.5), (2.0, 1.0)]
    assert row.missing == 1 and not row.closed


def test_malformed_lines_are_kept_apart(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "name": "x"}\nnot json\n{"id": 2}\n')
    good, bad = files.read_envelopes(spark, str(tmp_path), "id long, name string")
    assert sorted((r.id, r.name) for r in good.collect()) == [(1, "x"), (2, None)]
    assert bad.count() == 1


def test_cells_prune(spark, tmp_path):
    files.write_cells(spark.range(100).withColumn("cell", F.col("id") % 4), f"{tmp_path}/cells")
    assert spark.read.parquet(f"{tmp_path}/cells").where("cell = 1").count() == 25


def run(spark, tmp_path, build, rows, schema):
    """Feed rows file by file and return all that the stream gave."""
    source = f"{tmp_path}/in"
    for n, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{source}/{n:03d}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source)
    q = build(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp")
    q.trigger(availableNow=True).outputMode("append").start().awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out").collect()


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


SCHEMA = "device string, ts timestamp, value double"


def test_stream_zones_equal_the_batch_fold(spark, tmp_path):
    values = [10.0, 22.0, 18.0, 14.0, None, 24.0, 26.0, 60.0, 47.0, 44.0]
    parts = [[("a", at(i), v)] for i, v in enumerate(values)]
    got = run(spark, tmp_path, lambda s: sensors.zones(s, "device", "ts", "value", [20, 50], 5), parts, SCHEMA)
    df = spark.createDataFrame([(values,)], "v array<double>")
    want = df.select(series.hysteresis_zone(F.col("v"), [20, 50], 5)).first()[0]
    assert [r.zone for r in sorted(got, key=lambda r: r.ts)] == want


def test_stream_mean_leaves_outliers_and_starts_anew(spark, tmp_path):
    parts = [[("a", at(i), 100.0) for i in range(10)], [("a", at(10), 500.0), ("a", at(11), 102.0)], [("a", at(12 + i), 300.0) for i in range(4)]]
    got = run(spark, tmp_path, lambda s: sensors.gated_mean(s, "device", "ts", "value", run=4), parts, SCHEMA)
    means = [r["mean"] for r in sorted(got, key=lambda r: r.ts)]
    assert means[10] == 100.0 and 100 < means[11] < 101 and means[14] < 101 and means[15] == 300.0


def test_stream_buckets_close_behind_the_watermark(spark, tmp_path):
    parts = [[("a", at(1), 2.0), ("a", at(4), 4.0)], [("a", at(200), 1.0)], [("a", at(300), 1.0)], [("a", at(2), 99.0), ("a", at(400), 1.0)]]
    got = run(spark, tmp_path, lambda s: sensors.buckets(s, "device", "ts", "value"), parts, SCHEMA)
    assert {(r.bucket, r["mean"], r.n) for r in got} >= {(at(0), 3.0, 2), (at(200), 1.0, 1)}
    assert not any(r["mean"] > 50 for r in got)

"""Streams of riders, dumps, packages and exports."""

from pyspark.sql import functions as F

from ridgeline.sources import files
from ridgeline.streaming import riders
from tests.test_files_and_streams import at, run

XY = "device string, ts timestamp, x double, y double"


def test_a_way_back_is_not_taken_for_the_way_out(spark, tmp_path):
    route = [(0.0, 0.0), (1000.0, 0.0), (0.0, 1.0)]
    xs = [(10, 0), (400, 2), (800, 0), (1000, 0), (700, 0), (700, 60), (700, 20), (700, 10), (None, 1)]
    parts = [[("a", at(i), None if x is None else float(x), float(y))] for i, (x, y) in enumerate(xs)]
    got = sorted(run(spark, tmp_path, lambda s: riders.matched(s, "device", "ts", route), parts, XY), key=lambda r: r.ts)
    assert [r.on for r in got] == [True, True, True, True, True, False, False, True]
    assert [round(r.along / 100) for r in got[:5]] == [0, 4, 8, 10, 13]


def test_a_trail_is_bounded_and_keeps_its_start_and_corner(spark, tmp_path):
    way = [(10.0 * i, 0.0) for i in range(30)] + [(290.0, 10.0 * i) for i in range(1, 30)] + [(290.0, 291.0)]
    parts = [[("a", at(100 * n + i), *p) for i, p in enumerate(way[n * 20 : n * 20 + 20])] for n in range(3)]
    got = run(spark, tmp_path, lambda s: riders.trail(s, "device", "ts", 5.0, 4, 6), parts, XY)
    last = list(zip(*max(got, key=lambda r: r.ts)[2:]))
    assert len(got) == 59 and len(last) == 10
    assert last[0] == (0.0, 0.0) and last[-1] == (290.0, 290.0) and (290.0, 0.0) in last


def test_next_places(spark, tmp_path):
    parts = [[("a", at(i), x)] for i, x in enumerate([0.0, 90.0, 101.0, 900.0, 2001.0, 20.0])]
    build = lambda s: riders.next_ahead(s, "device", "ts", [(100.0, "well"), (1000.0, "shop"), (2000.0, "inn")])
    got = sorted(run(spark, tmp_path, build, parts, "device string, ts timestamp, along double"), key=lambda r: r.ts)
    assert [(r.name, r.metres) for r in got] == [("well", 100.0), ("well", 10.0), ("shop", 899.0), ("shop", 100.0), (None, None), ("well", 80.0)]


def test_rows_of_a_dump(spark, tmp_path):
    (tmp_path / "d.sql").write_text("-- x\nINSERT INTO `page` VALUES (1,'A, (b)',NULL),(2,'it\\'s',0.5);\nINSERT INTO `other` VALUES (3,'c',1);\nINSERT INTO page VALUES (4,'o''k','');\n")
    rows = files.read_inserts(spark, str(tmp_path), "page", ["id", "title", "x"]).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("1", "A, (b)", None), ("2", "it's", "0.5"), ("4", "o'k", "")]


def test_exports_come_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, 47.5, 7.5, None), (1, 1, 47.0, 7.0, 310.0), (2, 1, 1.0, 2.0, 5.0)], "ride int, n int, lat double, lon double, ele double")
    files.write_gpx(rows, f"{tmp_path}/gpx", "ride", "n")
    back = files.read_gpx(spark, f"{tmp_path}/gpx/*").collect()
    assert sorted((r.lat, r.lon, r.ele) for r in back if "ride=1" in r.file) == [(47.0, 7.0, 310.0), (47.5, 7.5, None)]
    counts = {r.ride: r.rows for r in files.write_package(rows, f"{tmp_path}/package", "ride").collect()}
    assert counts == {1: 2, 2: 1}
    files.replace_partitions(rows, f"{tmp_path}/parts", "ride")
    files.replace_partitions(rows.where("ride = 2").withColumn("lat", F.lit(9.0)), f"{tmp_path}/parts", "ride")
    assert sorted((r.ride, r.lat) for r in spark.read.parquet(f"{tmp_path}/parts").collect()) == [(1, 47.0), (1, 47.5), (2, 9.0)]

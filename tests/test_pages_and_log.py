"""Packages that write what changed, logs whose batches are given again, clocks that go back."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ridgeline.sources import pages
from ridgeline.streaming import log

ROWS = [(1, "a", 1.5), (1, None, None), (1, "a", 1.5), (2, "b\n\"", 2.0), (3, "", 0.0), (4, "", 0.0)]
SCHEMA, REST = "cell int, name string, v double", "name string, v double"


def test_only_changed_pages_are_written(spark, tmp_path):
    path = str(tmp_path / "package")
    df = spark.createDataFrame(ROWS, SCHEMA)
    first = {r.page: r for r in pages.write_pages(df, path, "cell", "1").collect()}
    assert all(r.fresh for r in first.values()) and first[3].digest == first[4].digest
    assert spark.read.parquet(f"{path}/pages").count() == 3
    again = pages.write_pages(df.orderBy(F.desc("v")).repartition(5), path, "cell", "2").collect()
    assert not any(r.fresh for r in again) and {r.page: r.digest for r in again} == {k: r.digest for k, r in first.items()}
    changed = df.withColumn("name", F.when(F.col("cell") == 2, "c").otherwise(F.col("name")))
    third = pages.write_pages(changed, path, "cell", "3").collect()
    assert [r.page for r in third if r.fresh] == [2] and spark.read.parquet(f"{path}/pages").count() == 4
    key = lambda rows: sorted(map(repr, (tuple(r) for r in rows)))
    assert key(pages.read_pages(spark, path, "1", REST).collect()) == key(ROWS)
    assert key(pages.read_pages(spark, path, "3", REST, spark.createDataFrame([(2,), (9,)], "page int")).collect()) == key([(2, "c", 2.0)])
    with pytest.raises(PySparkException):
        pages.write_pages(changed, path, "cell", "3")
    assert pages.write_pages(df.limit(0), path, "cell", "4").count() == 0
    assert pages.read_pages(spark, path, "4", REST).count() == 0


def test_faults_of_packages_are_errors(spark, tmp_path):
    path = str(tmp_path / "package")
    df = spark.createDataFrame(ROWS, SCHEMA)
    with pytest.raises(ValueError, match="page 1 has"):
        pages.write_pages(df, path, "cell", "1", budget=60)
    with pytest.raises(ValueError, match="rows without cell"):
        pages.write_pages(df.withColumn("cell", F.expr("nullif(cell, 2)")), path, "cell", "1")
    digest = pages.write_pages(df, path, "cell", "1").where("page = 2").first().digest
    damaged = spark.read.parquet(f"{path}/pages").where(F.col("digest") == digest).withColumn("body", F.lit("{}"))
    damaged = spark.createDataFrame(damaged.collect(), damaged.schema)
    damaged.drop("slot").write.mode("overwrite").parquet(f"{path}/pages/slot={digest[:2]}")
    with pytest.raises(PySparkException, match="damaged page"):
        pages.read_pages(spark, path, "1", REST).collect()


def feed(spark, path, parts, schema):
    for n, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/{n:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def test_a_killed_log_has_each_row_once(spark, tmp_path):
    schema, path, cp = "id long", f"{tmp_path}/log", f"{tmp_path}/cp"
    stream = feed(spark, f"{tmp_path}/in", [[(i,), (i + 100,)] for i in range(4)], schema)
    log.append_log(stream, path, cp).awaitTermination()
    assert sorted(r.id for r in log.read_log(spark, path, schema).collect()) == sorted([*range(4), *range(100, 104)])
    # The note of the last batch is lost after its write, and a write is cut off before its end.
    (tmp_path / "cp" / "commits" / "3").unlink()
    (tmp_path / "cp" / "commits" / ".3.crc").unlink(missing_ok=True)
    log.append_log(stream, path, cp).awaitTermination()
    assert sorted(r.id for r in log.read_log(spark, path, schema).collect()) == sorted([*range(4), *range(100, 104)])
    (tmp_path / "cp" / "commits" / "3").unlink()
    (tmp_path / "cp" / "commits" / ".3.crc").unlink(missing_ok=True)
    (tmp_path / "log").glob("writer=*/batch=3/_SUCCESS").__next__().unlink()
    assert log.read_log(spark, path, schema).count() == 6
    log.append_log(stream, path, cp).awaitTermination()
    got = log.read_log(spark, path, schema).collect()
    assert sorted(r.id for r in got) == sorted([*range(4), *range(100, 104)]) and {r.batch for r in got} == {0, 1, 2, 3}
    assert log.read_log(spark, f"{tmp_path}/none", schema).count() == 0
    # A new checkpoint reads the source anew, beside the old writer.
    log.append_log(stream, path, f"{tmp_path}/cp2").awaitTermination()
    assert [r["count"] for r in log.read_log(spark, path, schema).groupBy("writer").count().collect()] == [8, 8]


@pytest.fixture
def ending(spark):
    """Queries with timeouts end when there is nothing more to read."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def plain_mean(samples, seconds):
    newest, window, out = None, {}, []
    for now, v in samples:
        if newest is not None and (now // 1000 < newest or now // 1000 - newest >= seconds):
            window.clear()
        newest = now // 1000
        window[newest] = v
        kept = [w for s, w in window.items() if newest - seconds < s <= newest]
        out.append(sum(kept) / len(kept))
    return out


def test_a_clock_that_goes_back_empties_the_window(spark, tmp_path, ending):
    clocks = [0, 900, 1500, 4000, 8000, 11200, 5000, 5100, 6000, 16000, 15999, 20000, 40000, 41000]
    samples = [(c, float(10 * i + 1)) for i, c in enumerate(clocks)]
    parts = [[("a", i, *s) for i, s in enumerate(samples)][k : k + 3] for k in range(0, len(samples), 3)]
    parts[2] += [("b", 7, 100, 5.0), ("b", 8, None, 6.0), ("b", 9, 200, None), (None, 10, 300, 1.0)]
    parts[0] = parts[0][::-1]
    stream = feed(spark, f"{tmp_path}/in", parts, "device string, n long, ms long, watts double")
    log.append_log(log.recent_mean(stream, "device", "n", "ms", "watts"), f"{tmp_path}/log", f"{tmp_path}/cp").awaitTermination()
    got = log.read_log(spark, f"{tmp_path}/log", "device string, n long, mean double").orderBy("device", "n").collect()
    assert [r["mean"] for r in got if r.device == "a"] == plain_mean(samples, 10)
    assert [(r.n, r["mean"]) for r in got if r.device == "b"] == [(7, 5.0)]


def test_silent_devices_are_forgotten(spark, tmp_path, ending):
    parts = [[("a", 1, 0, 10.0)], [("b", 2, 0, 1.0)], [("a", 3, 1000, 30.0)]]
    for idle, want in (("1 hour", 20.0), ("1 ms", 30.0)):
        at = f"{tmp_path}/{idle.replace(' ', '')}"
        stream = feed(spark, f"{at}/in", parts, "device string, n long, ms long, watts double")
        log.append_log(log.recent_mean(stream, "device", "n", "ms", "watts", idle=idle), f"{at}/log", f"{at}/cp").awaitTermination()
        got = {r.n: r["mean"] for r in log.read_log(spark, f"{at}/log", "device string, n long, mean double").collect()}
        assert got == {1: 10.0, 2: 1.0, 3: want}

"""Each plan gives on Spark what it gives on DuckDB; folds and streams run."""

import duckdb
import pytest

import __spark_entry__
from docspark.plans import catalog, folds
from docspark.sources import logs
from docspark.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in catalog.TABLES:
        con.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    return con


def tidy(rows):
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(repr(tuple(plain(v) for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.PLANS))
def test_plan(spark, duck, name):
    want = duck.sql(catalog.oracle(name))
    columns, rows = want.columns, want.fetchall()
    assert tidy(tuple(r) for r in catalog.query(name)(spark, SF).select(*columns).collect()) == tidy(rows)


@pytest.mark.parametrize("name", sorted(folds.QUERIES))
def test_fold(spark, duck, name):
    got = folds.QUERIES[name](spark, SF)
    if name not in folds.ORACLES:  # held against a plain loop in test_folds.py
        assert got.count() > 0
        return
    want = duck.sql(folds.ORACLES[name])
    assert tidy(tuple(r) for r in got.select(*want.columns).collect()) == tidy(want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_own_tables_take_a_views_place(spark):
    rows = spark.createDataFrame([(1, 0, "16 | Head", 40.0, 612.0)], "doc_id long, seq long, t string, y double, page_height double")
    assert catalog.run("c03_running_furniture", spark, {"v_samples": rows}).first().value is True
    spark.catalog.dropTempView("v_samples")


def test_logs(spark, tmp_path):
    assert logs.read_results(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_text('{"unitId":"b1","translatedText":"x"}\n{"unitId":"b1","translatedText":"y"}\n{"unitId":"b2","tra\n{"unitId":"b3"}\n')
    assert [tuple(r) for r in logs.read_results(spark, str(tmp_path / "log")).collect()] == [("b1", "y")]
    logs.append_results(spark.createDataFrame([("b7", "z")], "unit_id string, text string"), str(tmp_path / "out"), 4)
    assert logs.read_results(spark, str(tmp_path / "out" / "capture_version=4")).first().text == "z"
    entries = spark.createDataFrame([("ab1", "", 0), ("cd2", "done", 3)], logs.ENTRY)
    logs.put_cache(entries, str(tmp_path / "cache"))
    got = logs.get_cache(entries.select("key"), spark.read.parquet(str(tmp_path / "cache")))
    assert {r.key: r.translated for r in got.collect()} == {"ab1": None, "cd2": "done"}
    logs.snapshot(str(tmp_path / "s.json"), {"a": 1})
    assert logs.load_snapshot(str(tmp_path / "s.json")) == {"a": 1} and logs.load_snapshot(str(tmp_path / "no")) is None
    assert logs.settings({"a": 2, "x": 1}, {"a": 0, "b": 5}) == {"a": 2, "b": 5}
    with pytest.raises(ValueError, match="bad job id"):
        logs.safe_folder(str(tmp_path), "..")
    assert '"role":"assistant"' in logs.sft_records(spark.createDataFrame([("a", "b")], "left_text string, right_text string"), "s").first().value


def test_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{SF}/events.parquet").write.parquet(str(tmp_path / "in" / "1"))
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
    for name, df, mode in (("followed", jobs.follow(jobs.job_events(stream)), "append"), ("rates", jobs.windowed_rates(stream), "append")):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
    got = spark.sql("select job_id, count_if(status = 'canceled' and legal) as c, count(*) as n from followed group by job_id").collect()
    assert got and all(r.c <= 1 for r in got) and spark.table("rates").count() >= 0
    assert jobs.latest(jobs.job_events(spark.read.parquet(f"{SF}/events.parquet"))).count() == spark.read.parquet(f"{SF}/events.parquet").select("user_id").distinct().count()

import pytest
from pyspark.sql import functions as F

from docspark.operators.control import Failover, JobManager, overall
from docspark.sources import files


def steps(job, report):
    for phase in ("translating", "typesetting", "exporting"):
        report(phase, 50)


def test_jobs_run_in_order_and_survive(tmp_path):
    seen = []
    manager = JobManager(str(tmp_path), steps, lambda job: seen.append((job.id, job.status)))
    manager.add("a", "x")
    manager.add("b", "y")
    manager.run_queued()
    assert [s for s in seen if s[1] in ("extracting", "done")] == [("a", "extracting"), ("a", "done"), ("b", "extracting"), ("b", "done")]
    manager.jobs["b"].status = "translating"
    manager._save()
    manager.flush()
    again = JobManager(str(tmp_path), steps)
    assert [(j.id, j.status) for j in again.list()] == [("a", "done"), ("b", "paused")]
    again.resume("b")
    again.run_queued()
    assert again.jobs["b"].status == "done"
    with pytest.raises(ValueError, match="->"):
        again.resume("a")
    again.remove("a")
    assert [j.id for j in again.list()] == ["b"]


def test_pause_cancel_and_errors(tmp_path):
    def work(job, report):
        report("translating", 10)
        if job.id == "p":
            manager.pause("p")
        if job.id == "c":
            manager.cancel("c")
        if job.id == "e":
            raise OSError("disk")
        report("typesetting", 0)

    manager = JobManager(str(tmp_path), work)
    for k in "pce":
        manager.add(k, k)
    manager.run_queued()
    assert {j.id: j.status for j in manager.list()} == {"p": "paused", "c": "canceled", "e": "error"} and "disk" in manager.jobs["e"].error
    with pytest.raises(ValueError, match="bad job id"):
        manager.add("../x", "x")
    assert overall("translating", 50) == 47.5 and overall("exporting", 200) == 100


def test_failover():
    policy = Failover(lambda m: "lost" in m)
    assert not policy.failed("odd") and not policy.failed("odd") and policy.failed("odd") and policy.cpu
    policy.succeeded()
    assert policy.failed("device lost") and policy.failed("device lost")
    with pytest.raises(RuntimeError, match="failed 4 times"):
        policy.failed("device lost")


def test_files_and_boxes(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"one two")
    (tmp_path / "b.bin").write_bytes(b"!")

    def make():
        def parse(content):
            if content == b"!":
                raise ValueError("broken")
            return [(1 + k, k, w, 0.0, 0.0, 1.0, 10.0, "f") for k, w in enumerate(content.decode().split() + [" "])]

        return parse

    rows = files.read_items(spark, str(tmp_path), make).collect()
    assert sorted(r.str for r in rows if r.error is None) == ["one", "two"] and [r.error for r in rows if r.error] == ["ValueError('broken')"]
    assert files.read_items(spark, str(tmp_path), make, 1).where("error is null").count() == 1
    pages = spark.createDataFrame([(1, 1, b"x"), (1, 2, b"y")], "doc_id long, page int, pixels binary")
    boxes = files.detect(pages, lambda: lambda pixels: [("image", 0.9, 0, 0, 80, 50), ("image", 0.1, 0, 0, 80, 50), ("text", 0.9, 0, 0, 1, 1)] if pixels == b"x" else [])
    assert boxes.count() == 1 and files.sparse_figures(boxes.withColumn("ink", F.lit(3.0))).count() == 1
    assert files.detector_recall(pages.select("doc_id", "page"), boxes).first().recall == 0.5


def test_hardware(spark):
    from docspark.operators import hardware as h

    assert h.cores("12th Gen Intel(R) Core(TM) i5-12600KF", 16, 10, True) == (True, 6) and h.threads("i5-12600KF", 16, 10, measured=True) == 12
    assert h.cores("Intel i5-12400", 12, 6, True) == (False, 6) and h.threads("AMD Ryzen 7 5800X", 16, 8) == 8 and h.threads("odd", 8, 4, "unknown") == 7 and h.physical_cores(7) == 7
    assert h.short_name("12th Gen Intel(R) Core(TM) i5-12600KF") == "Intel i5-12600KF" and h.short_name("AMD Ryzen 7 5800X") == "AMD Ryzen 7 5800X"
    models = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    sizes = spark.createDataFrame([("a", 20 << 20), ("b", 5)], "id string, length long")
    running = spark.createDataFrame([("c", "downloading")], "id string, status string")
    assert {r.id: r.status for r in h.catalogue(models, sizes, running).collect()} == {"a": "available", "b": "not-downloaded", "c": "downloading"}


def test_figure_regions(spark):
    pages = spark.createDataFrame([(1, 1, b"x"), (1, 2, b"y")], "doc_id long, page int, pixels binary")
    boxes = [("image", 0.9, 10.0, 10.0, 100.0, 60.0), ("image", 0.2, 10.0, 300.0, 100.0, 60.0), ("table", 0.9, 10.0, 500.0, 100.0, 60.0)]
    matched = spark.createDataFrame([(1, 1, 12.0, 60.0)], "doc_id long, page int, y double, h double")
    ink = lambda df: df.withColumn("ink", F.lit(5.0))
    assert [(r.doc_id, r.page, r["class"]) for r in files.figure_regions(pages, lambda: lambda pixels: boxes, ink, matched).collect()] == [(1, 2, "image")]
    assert files.figure_regions(pages, None, ink, matched).count() == 0

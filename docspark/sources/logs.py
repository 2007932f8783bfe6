"""Result logs, snapshots, caches and corpora: how they are read and written.

Reads are tolerant: a line that doesn't parse is dropped, a missing file is an empty table. Writes only append, or
replace a folder through Spark's committer; control files are written beside and renamed.
"""

from __future__ import annotations

import json
import os
import threading
import time
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.functions import text as t

LOG, ENTRY = "unitId string, translatedText string", "key string, translated string, tokens int"


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(unit_id, text) of a JSON-lines log; of lines with one key the last of its file counts. Broken lines are dropped."""
    if not spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
        return spark.createDataFrame([], "unit_id string, text string")
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    rows = lines.select("file", "at", F.from_json("value", LOG).alias("x")).select("file", "at", F.col("x.unitId").alias("unit_id"), F.col("x.translatedText").alias("text")).where("unit_id is not null and text is not null")
    return rows.groupBy("unit_id").agg(F.max_by("text", F.struct("file", "at")).alias("text"))


def append_results(results: DataFrame, path: str, version: int) -> None:
    """Results (unit_id, text) added to the log of one capture version; older versions stay beside it."""
    results.select(F.col("unit_id").alias("unitId"), F.col("text").alias("translatedText")).write.mode("append").json(f"{path}/capture_version={version}")


def archive_stale(spark: SparkSession, path: str, version: int) -> list[str]:
    """Logs of other capture versions get the ending .stale, so that they are kept but not read; the new names."""
    jvm, done = spark._jvm.org.apache.hadoop.fs, []
    root = jvm.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return done
    for status in files.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("capture_version=") and name != f"capture_version={version}" and not name.endswith(".stale"):
            old, k = jvm.Path(root, name + ".stale"), 1
            while files.exists(old):
                old, k = jvm.Path(root, f"{name}.{k}.stale"), k + 1
            if not files.rename(status.getPath(), old):
                raise OSError(f"cannot rename {status.getPath()}")
            done.append(old.getName())
    return sorted(done)


class Debounced:
    """Calls save() once for the touches of a while: `wait` seconds after the first of them, or at flush()."""

    def __init__(self, save: Callable[[], None], wait: float = 0.12):
        self.save, self.wait = save, wait
        self.lock, self.timer = threading.Lock(), None

    def touch(self) -> None:
        with self.lock:
            if self.timer is None:
                self.timer = threading.Timer(self.wait, self.flush)
                self.timer.daemon = True
                self.timer.start()

    def flush(self) -> None:
        """Save now if there was a touch since the last save."""
        with self.lock:
            timer, self.timer = self.timer, None
        if timer is not None:
            timer.cancel()
            self.save()


def assert_written(path: str) -> int:
    """The bytes of an output file; raises if it is missing or empty."""
    size = Path(path).stat().st_size if Path(path).is_file() else 0
    if not size:
        raise OSError(f"no output at {path}")
    return size


def cache_key(*parts: str):
    return F.sha2(F.concat_ws("\x00", *parts), 256)


def put_cache(entries: DataFrame, path: str) -> None:
    """Entries (key, translated, tokens) added to a cache whose folders are the first two digits of the key."""
    entries.withColumn("shard", F.substring("key", 1, 2)).write.mode("append").partitionBy("shard").parquet(path)


def get_cache(units: DataFrame, cache: DataFrame) -> DataFrame:
    """units(key, ...) with translated where the cache has a result that is not empty."""
    newest = cache.where(F.length("translated") > 0).groupBy("key").agg(F.max("translated").alias("translated"))
    return units.join(newest, "key", "left")


def snapshot(path: str, data: dict, tries: int = 5) -> None:
    """A small control file, written beside and renamed."""
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    Path(beside).write_text(json.dumps(data))
    for k in range(tries):
        try:
            os.replace(beside, path)
            return
        except PermissionError:
            time.sleep(0.05 * (k + 1))
    os.unlink(beside)
    raise PermissionError(path)


def load_snapshot(path: str) -> dict | None:
    """A control file's content; None if it is missing or broken."""
    try:
        data = json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return None
    return data if isinstance(data, dict) else None


def settings(stored: dict | None, defaults: dict) -> dict:
    """Known keys only, the stored value before the default."""
    return {k: (stored or {}).get(k, v) for k, v in defaults.items()}


def safe_folder(root: str, job_id: str) -> Path:
    """The folder of a job; raises for ids that could lead elsewhere."""
    import re

    if job_id in (".", "..") or not re.fullmatch(r"[A-Za-z0-9_.-]+", job_id):
        raise ValueError(f"bad job id: {job_id!r}")
    return Path(root, job_id)


def sft_records(pairs: DataFrame, system: str) -> DataFrame:
    """(left_text, right_text) as one JSON line each: a system, a user and an assistant message."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return pairs.select(F.to_json(F.struct(F.array(message("system", F.lit(system)), message("user", F.col("left_text")), message("assistant", F.col("right_text"))).alias("messages"))).alias("value"))


def batches(units: DataFrame, by: list[str], order: list[str], size: int = 4) -> DataFrame:
    """units with the number of the batch of `size` that each falls in within its group."""
    return units.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / size))


def clean(df: DataFrame, column: str = "text") -> DataFrame:
    """df without rows whose text is garbage."""
    return df.where(~t.apply(t.garbage, column))

"""Threads to use, from a processor's name and core counts; and a catalogue of models with what is there of them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Desktop parts with two kinds of cores: generations 12 to 14; the fast cores of each class.
FAST_CORES = {"600": 6, "700": 8, "900": 8}
HYBRID_NAME = re.compile(r"1[2-4]th Gen|i[3579]-?1[2-4]\d{3}|Core\s*\(?\w*\)?\s*Ultra", re.I)
MODEL_BYTES = 10 * 1024 * 1024


def cores(name: str, logical: int, physical: int, measured: bool = False) -> tuple[bool, int]:
    """Whether a processor has two kinds of cores, and how many are fast.

    Some cores with two threads and some with one give a count between the two; where the physical count is only
    estimated, the name of a hybrid generation tells.
    """
    hybrid = physical < logical < 2 * physical or (not measured and bool(HYBRID_NAME.search(name)) and logical > 1.5 * physical)
    part = re.search(r"i[3579]-?1[2-4](\d00)", name, re.I)
    return hybrid, FAST_CORES.get(part[1], physical) if hybrid and part else physical


def physical_cores(logical: int) -> int:
    """An estimate: two threads a core, but one if their count is odd."""
    return logical if logical % 2 else logical // 2


def threads(name: str, logical: int, physical: int, arch: str = "x64", measured: bool = False) -> int:
    hybrid, fast = cores(name, logical, physical, measured)
    want = 2 * fast if hybrid else logical - 1 if arch not in ("x64", "arm64") else fast
    return max(2, min(logical, want))


def short_name(name: str) -> str:
    """The brand and the part, as people say it."""
    clean = " ".join(re.sub(r"\(R\)|\(TM\)", "", name).split())
    for pattern, brand in ((r"i[3579]-?\d{4,5}[a-z]*", "AMD" if "amd" in clean.lower() else "Intel"), (r"Core Ultra\s*\d+.*$", "Intel"), (r"Ryzen\s*\d.*$", "AMD")):
        if m := re.search(pattern, clean, re.I):
            return f"{brand} {m[0]}"
    return clean


def catalogue(models: DataFrame, files: DataFrame, running: DataFrame | None = None) -> DataFrame:
    """models(id, ...) with status: what is running now, else available if its file (id, length) is large enough."""
    there = files.groupBy("id").agg(F.max("length").alias("length"))
    out = models.join(there, "id", "left")
    out = out.join(running.select("id", F.col("status").alias("now")), "id", "left") if running is not None else out.withColumn("now", F.lit(None).cast("string"))
    return out.withColumn("status", F.coalesce("now", F.when(F.col("length") >= MODEL_BYTES, "available").otherwise("not-downloaded"))).drop("length", "now")

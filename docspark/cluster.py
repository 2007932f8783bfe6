"""Python workers on other machines need this package: it is sent to them once per Spark context."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make docspark importable in the Python workers of this context."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    here = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="docspark-"), f"docspark-{context.applicationId}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(here.rglob("*.py")):
            out.write(source, source.relative_to(here.parent))
    context.addPyFile(str(path))
    _SENT.add(context.applicationId)

"""Job state in Structured Streaming: legal transitions, progress and time left, upserts and tombstones.

One state row per job, kept by transformWithStateInPandas; a canceled job leaves a tombstone, so late events of it are
dropped. Windows and watermarks (windowed_rates) are extras of this engine.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docspark.plans.catalog import LEGAL
from docspark.plans.views import STATUSES

OUTPUT = "job_id long, seq long, status string, legal boolean, progress double, eta double"


class JobState(StatefulProcessor):
    """Follows one job: its last status, progress and smoothed seconds per percent."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("job", "status string, progress double, at double, rate double, gone boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        status, progress, at, rate, gone = self.state.get() if self.state.exists() else (None, None, None, None, False)
        out = []
        for row in pd.concat(list(rows)).sort_values(["ts", "seq"]).itertuples():
            if gone:
                continue
            legal = status is None or status == row.status or row.status in LEGAL[status]
            now = row.ts.timestamp()
            if progress is not None and row.progress > progress:
                step = (now - at) / (row.progress - progress)
                rate = step if rate is None else 0.7 * rate + 0.3 * step
            elif progress is not None:
                rate = None
            left = rate * (100 - row.progress) if rate is not None and 5 < row.progress < 100 else None
            if legal:
                status = row.status
            progress, at, gone = float(row.progress), now, legal and row.status == "canceled"
            out.append((key[0], row.seq, row.status, legal, progress, left))
        self.state.update((status, progress, at, rate, gone))
        yield pd.DataFrame(out, columns=["job_id", "seq", "status", "legal", "progress", "eta"])

    def close(self) -> None:
        pass


def job_events(events: DataFrame) -> DataFrame:
    """Events as states of jobs, as the view v_job_events has them; for a stream or a table."""
    status = F.element_at(F.array(*map(F.lit, STATUSES)), (F.col("event_id") % 9 + 1).cast("int"))
    return events.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), "ts", status.alias("status"), (F.col("event_id") % 131).cast("double").alias("progress")).withColumn("progress", F.least("progress", F.lit(100.0)))


def follow(events: DataFrame) -> DataFrame:
    """A stream of job_events with each transition's legality, progress and time left; needs the RocksDB state store."""
    return events.groupBy("job_id").transformWithStateInPandas(JobState(), OUTPUT, "Append", "None")


def latest(batch: DataFrame) -> DataFrame:
    """The last event of each job, for use in foreachBatch with an upsert by job_id."""
    return batch.groupBy("job_id").agg(F.max_by(F.struct("status", "progress", "ts"), F.struct("ts", "seq")).alias("x")).select("job_id", "x.*")


def windowed_rates(events: DataFrame, delay: str = "10 minutes", size: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Extra: counts and sums by sliding event-time window and type, behind a watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(F.window("ts", size, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))

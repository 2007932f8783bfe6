"""Control of jobs on the driver: one runs at a time, in the order they came; they can be paused, resumed and canceled.

State changes go through one check of legality. The catalogue is a snapshot file; a job that was running when the
program ended is found paused at the next start.
"""

from __future__ import annotations

import shutil
import threading
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from pathlib import Path

from docspark.plans.catalog import ACTIVE, LEGAL
from docspark.sources.logs import Debounced, load_snapshot, safe_folder, snapshot


class Stopped(Exception):
    """Raised by a job's work once it was asked to stop."""


@dataclass
class Job:
    id: str
    source: str
    status: str = "queued"
    progress: float = 0.0
    error: str | None = None
    created: float = field(default_factory=time.time)


Work = Callable[[Job, Callable[[str, float], None]], None]


def overall(phase: str, progress: float) -> float:
    """Progress of the whole job, from that of its phase."""
    start, share = {"extracting": (0, 5), "translating": (5, 85), "typesetting": (92, 0), "exporting": (98, 2), "done": (100, 0)}.get(phase, (0, 0))
    return start + share * min(100.0, max(0.0, progress)) / 100


class Failover:
    """When an engine is given up: at a hardware error, or at three errors in a row; more than three rebuilds raise."""

    def __init__(self, is_hardware: Callable[[str], bool], errors: int = 3, rebuilds: int = 3):
        self.is_hardware, self.errors, self.rebuilds = is_hardware, errors, rebuilds
        self.in_a_row = self.built = 0
        self.cpu = False

    def succeeded(self) -> None:
        self.in_a_row = 0

    def failed(self, message: str) -> bool:
        """Whether the engine is to be rebuilt on the CPU from now on."""
        self.in_a_row += 1
        if self.is_hardware(message) or self.in_a_row >= self.errors:
            self.cpu, self.in_a_row, self.built = True, 0, self.built + 1
            if self.built > self.rebuilds:
                raise RuntimeError(f"engine failed {self.built} times: {message}")
            return True
        return False


class EnginePool:
    """One engine at a time, which is made again when its model, device or number of threads changes."""

    def __init__(self, make: Callable[[str, str, int], object], close: Callable[[object], None] = lambda engine: None):
        self.make, self.close = make, close
        self.key, self.engine = None, None

    def get(self, model: str, device: str, threads: int) -> object:
        if self.key != (model, device, threads):
            self.release()
            self.engine, self.key = self.make(model, device, threads), (model, device, threads)
        return self.engine

    def release(self) -> None:
        if self.key is not None:
            engine, self.engine, self.key = self.engine, None, None
            self.close(engine)


class JobManager:
    def __init__(self, root: str, work: Work, notify: Callable[[Job], None] = lambda job: None):
        self.root, self.work, self.notify = root, work, notify
        self.lock = threading.RLock()
        self.catalogue = Debounced(self._write)
        self.asked: dict[str, str] = {}
        self.jobs = {k: Job(**v) for k, v in (load_snapshot(self._catalogue) or {}).items()}
        for job in self.jobs.values():
            if job.status in ACTIVE:
                job.status = "paused"
        self._write()

    @property
    def _catalogue(self) -> str:
        return str(Path(self.root, "jobs.json"))

    def _write(self) -> None:
        with self.lock:
            Path(self.root).mkdir(parents=True, exist_ok=True)
            snapshot(self._catalogue, {k: asdict(v) for k, v in self.jobs.items()})

    def _save(self) -> None:
        """Changes in quick succession are saved together."""
        self.catalogue.touch()

    def flush(self) -> None:
        """Save what is not saved yet; the program calls this before it ends."""
        self.catalogue.flush()

    def move(self, job: Job, status: str) -> None:
        with self.lock:
            if status != job.status and status not in LEGAL[job.status]:
                raise ValueError(f"{job.status} -> {status}")
            job.status = status
            self._save()
        self.notify(job)

    def add(self, job_id: str, source: str) -> Job:
        safe_folder(self.root, job_id)
        with self.lock:
            job = self.jobs[job_id] = Job(job_id, source)
            self._save()
        return job

    def list(self) -> list[Job]:
        return list(self.jobs.values())

    def pause(self, job_id: str) -> None:
        if self.jobs[job_id].status in ACTIVE:
            self.asked[job_id] = "paused"

    def resume(self, job_id: str) -> None:
        self.move(self.jobs[job_id], "queued")

    def cancel(self, job_id: str) -> None:
        job = self.jobs[job_id]
        if job.status in ACTIVE:
            self.asked[job_id] = "canceled"
        else:
            self.move(job, "canceled")

    def remove(self, job_id: str) -> None:
        if self.jobs[job_id].status in ACTIVE:
            raise ValueError("running")
        folder = safe_folder(self.root, job_id)
        if folder.is_dir():
            shutil.rmtree(folder)
        del self.jobs[job_id]
        self._save()
        self.flush()

    def run_queued(self) -> None:
        """Runs queued jobs one after another until none is left."""
        while job := next((j for j in self.jobs.values() if j.status == "queued"), None):
            self._run(job)
        self.flush()

    def _run(self, job: Job) -> None:
        def report(phase: str, progress: float) -> None:
            if self.asked.get(job.id):
                raise Stopped
            self.move(job, phase)
            job.progress = overall(phase, progress)

        try:
            report("extracting", 0)
            self.work(job, report)
            self.move(job, "done")
            job.progress = 100.0
        except Stopped:
            self.move(job, self.asked.pop(job.id))
        except Exception as error:
            job.error = repr(error)
            self.move(job, "error")
        self._save()

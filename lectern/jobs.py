"""A log of background jobs, run by a thread pool on the driver."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import asdict, dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.errors import JobNotFound

STATUSES = ("pending", "running", "succeeded", "failed", "cancelled", "interrupted")
ENDED = frozenset(STATUSES[2:])


def iso(at: float) -> str:
    return datetime.fromtimestamp(at, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


@dataclass
class Job:
    job_id: str
    type: str
    kb: str
    params: dict
    status: str = "pending"
    done: int = 0
    total: int = 0
    current_doc: str | None = None
    error: str | None = None
    result: dict | None = None
    created_at: str = ""
    updated_at: str = ""

    def elapsed(self, now: float) -> float:
        at = lambda s: datetime.fromisoformat(s.replace("Z", "+00:00")).timestamp()
        return round(max(0.0, (at(self.updated_at) if self.status in ENDED else now) - at(self.created_at)), 3)


class Jobs:
    """Submits, runs and remembers jobs.

    ``load`` gives the JSON texts of all jobs, ``save`` takes a job's id and text,
    ``drop`` its id: a change writes one job.
    """

    def __init__(self, workers: int = 1, clock: Callable[[], float] = time.time, load: Callable[[], list[str]] = list, save: Callable[[str, str], None] = lambda job_id, text: None, drop: Callable[[str], None] = lambda job_id: None):
        self._clock, self._save, self._drop, self._lock = clock, save, drop, threading.RLock()
        self._handlers: dict[str, Callable[[Job], dict]] = {}
        self._pool = ThreadPoolExecutor(workers)
        self._running: dict[str, Future] = {}
        held = sorted((Job(**json.loads(text)) for text in load()), key=lambda j: (j.created_at, j.job_id))
        self._jobs = {j.job_id: j for j in held}

    def register(self, kind: str, handler: Callable[[Job], dict]) -> None:
        self._handlers[kind] = handler

    def recover(self) -> int:
        """Marks jobs that ran when the process ended as interrupted; pending ones stay."""
        with self._lock:
            cut = [j for j in self._jobs.values() if j.status == "running"]
            for j in cut:
                self._set(j, status="interrupted")
        return len(cut)

    def submit(self, kind: str, kb: str, params: dict) -> str:
        if kind not in self._handlers:
            raise ValueError(f"no handler for jobs of type {kind}")
        with self._lock:
            job = Job(str(uuid.uuid4()), kind, kb, params, created_at=iso(self._clock()))
            self._jobs[job.job_id] = job
            self._set(job)
            self._running[job.job_id] = self._pool.submit(self._run, job)
        return job.job_id

    def again(self, job_id: str) -> None:
        """Runs a job again that failed, was cancelled or interrupted."""
        with self._lock:
            job = self.get(job_id)
            if job.status not in ENDED or job.status == "succeeded":
                raise ValueError(f"a job that is {job.status} can't be run again")
            if job.type not in self._handlers:
                raise ValueError(f"no handler for jobs of type {job.type}")
            self._set(job, status="pending", error=None)
            self._running[job_id] = self._pool.submit(self._run, job)

    def _set(self, job: Job, **values) -> None:
        with self._lock:
            for k, v in values.items():
                setattr(job, k, v)
            job.updated_at = iso(self._clock())
            self._save(job.job_id, json.dumps(asdict(job)))

    def _moved(self, job: Job, was: str, **values) -> bool:
        """Sets values only if the status still is ``was``."""
        with self._lock:
            if job.status != was:
                return False
            self._set(job, **values)
            return True

    def _run(self, job: Job) -> None:
        if not self._moved(job, "pending", status="running"):
            return
        try:
            result = self._handlers[job.type](job)
        except Exception as e:  # a job's failure is its result
            self._moved(job, "running", status="failed", error=str(e))
        else:
            self._moved(job, "running", status="succeeded", result=result)

    def progress(self, job: Job, done: int, total: int | None = None, current: str | None = None) -> None:
        self._set(job, done=done, total=job.total if total is None else total, current_doc=current)

    def get(self, job_id: str) -> Job:
        with self._lock:
            if job_id not in self._jobs:
                raise JobNotFound(f"job not found: {job_id}")
            return self._jobs[job_id]

    def wait(self, job_id: str, timeout: float | None = None) -> Job:
        if job_id in self._running:
            self._running[job_id].result(timeout)
        return self.get(job_id)

    def forget(self, kb: str) -> None:
        with self._lock:
            for k in [k for k, j in self._jobs.items() if j.kb == kb]:
                del self._jobs[k]
                self._drop(k)

    def close(self) -> None:
        self._pool.shutdown(wait=True)


def summary(jobs: DataFrame) -> DataFrame:
    """(type, kb, jobs, done, failed, last_job): of jobs as rows (job_id, type, kb, status, done), how many there are of a type and base, their documents, and failures."""
    failed = F.sum(F.when(F.col("status").isin("failed", "interrupted"), 1).otherwise(0))
    return jobs.groupBy("type", "kb").agg(F.count("*").alias("jobs"), F.coalesce(F.sum("done"), F.lit(0)).cast("long").alias("done"), failed.cast("long").alias("failed"), F.max("job_id").alias("last_job"))

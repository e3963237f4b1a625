"""Jobs one after the other, to be stopped, resumed and discarded (STR-5, STR-6, STR-9)."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import SparkSession

from confab.operators import history, jobs


class JobQueue:
    """Runs jobs in the order they came, one at a time, each as a Spark job group.

    `work(job, stopping)` does a job's distributed work and returns its results as a
    dict; `stopping()` tells whether it shall end. A stop cancels the group's Spark
    jobs and waits `grace` seconds for `work` to come back, so tasks end with it. The
    checkpoint stays; `resume` queues the job again from there, `discard` deletes its
    folder. Every end but a discard is written to the history.
    """

    def __init__(self, spark: SparkSession, work: Callable, told: Callable[[dict], None] = lambda job: None, history_path: str | None = None, folder: str | None = None, grace: float = 2.0):
        self.spark, self.work, self.told, self.history_path, self.folder, self.grace = spark, work, told, history_path, folder, grace
        self.waiting: deque[dict] = deque()
        self.known: dict[str, dict] = {}
        self.stops: dict[str, threading.Event] = {}
        self.ids = 0

    def _tell(self, job: dict, status: str, **more) -> None:
        job.update(more, status=status)
        self.told(dict(job))

    def submit(self, job: dict) -> str:
        """Queue a job (id, source_path, model, language, ...); its id."""
        job = dict(job)
        self.known[job["id"]], self.stops[job["id"]] = job, threading.Event()
        self.waiting.append(job)
        self._tell(job, "queued")
        return job["id"]

    def stop(self, job_id: str) -> bool:
        """End a queued or running job; False if there is none."""
        if job_id not in self.known:
            return False
        self.stops[job_id].set()
        self.spark.sparkContext.cancelJobGroup(f"job-{job_id}")
        return True

    def resume(self, job_id: str) -> bool:
        """Queue a stopped or failed job again; False if it is unknown, discarded or not finished."""
        job = self.known.get(job_id)
        if job is None or job["status"] not in jobs.TERMINAL:
            return False
        self.stops[job_id] = threading.Event()
        self.waiting.append(job)
        self._tell(job, "queued", error=None)
        return True

    def discard(self, job_id: str) -> bool:
        """Forget a job and delete its folder."""
        if self.known.pop(job_id, None) is None:
            return False
        self.stops[job_id].set()
        self.waiting = deque(j for j in self.waiting if j["id"] != job_id)
        if self.folder:
            jobs.discard(self.spark, f"{self.folder}/{job_id}")
        return True

    def run(self) -> None:
        """Work until nothing waits."""
        while self.waiting:
            job = self.waiting.popleft()
            if self.stops[job["id"]].is_set():
                self._end(job, "stopped", datetime.now(), 0.0)
                continue
            self._one(job)

    def _one(self, job: dict) -> None:
        began, clock, stop, out = datetime.now(), time.monotonic(), self.stops[job["id"]], {}
        self._tell(job, "transcribing")

        def go() -> None:
            self.spark.sparkContext.setJobGroup(f"job-{job['id']}", job["id"], interruptOnCancel=True)
            try:
                out["result"] = self.work(dict(job), stop.is_set)
            except Exception as e:
                out["error"] = f"{type(e).__name__}: {e}"

        worker = threading.Thread(target=go, daemon=True)
        worker.start()
        while worker.is_alive() and not stop.wait(0.05):
            worker.join(0.05)
        if stop.is_set():
            self.spark.sparkContext.cancelJobGroup(f"job-{job['id']}")
            worker.join(self.grace)
        took = time.monotonic() - clock
        if stop.is_set():
            self._end(job, "stopped", began, took)
        elif "error" in out:
            self._end(job, "error", began, took, error=out["error"])
        else:
            self._end(job, "done", began, took, **(out["result"] or {}))

    def _end(self, job: dict, status: str, began: datetime, took: float, **more) -> None:
        self._tell(job, status, elapsed=took, **more)
        if self.history_path and job["id"] in self.known:
            self.ids += 1
            row = {k: job.get(k) for k in ("source_path", "output_path", "model", "language", "audio_duration_seconds", "turns_json", "error")}
            row |= {"id": int(began.timestamp() * 1000) * 1000 + self.ids % 1000, "status": "success" if status == "done" else status, "elapsed_seconds": took}
            row |= {"started_at": began.isoformat(timespec="seconds"), "finished_at": datetime.now().isoformat(timespec="seconds")}
            names = [c.split(" ")[0] for c in history.SCHEMA.split(", ")]
            history.record(self.spark.createDataFrame([tuple(row[n] for n in names)], history.SCHEMA), self.history_path)

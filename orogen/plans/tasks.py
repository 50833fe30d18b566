"""Operators run in the background, with a state and a way to stop them."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from typing import Any

from pyspark.sql import SparkSession

_pool = ThreadPoolExecutor(max_workers=8, thread_name_prefix="orogen")


class Task:
    """PENDING, RUNNING, SUCCEEDED, FAILED or CANCELLED; a result is published only on success."""

    def __init__(self, spark: SparkSession, work: Callable[[], Any]) -> None:
        self.spark, self.tag, self.cancelled, self.started = spark, f"orogen-{uuid.uuid4().hex}", False, False

        def run() -> Any:
            self.started = True
            spark.addTag(self.tag)
            try:
                return work()
            finally:
                spark.removeTag(self.tag)

        self.future: Future = _pool.submit(run)

    @property
    def state(self) -> str:
        if not self.future.done():
            return "RUNNING" if self.started else "PENDING"
        if self.future.cancelled() or (self.cancelled and self.future.exception()):
            return "CANCELLED"
        return "FAILED" if self.future.exception() else "SUCCEEDED"

    def cancel(self) -> None:
        self.cancelled = True
        if not self.future.cancel():
            self.spark.interruptTag(self.tag)

    def wait(self, timeout: float | None = None) -> bool:
        """Whether the task has ended within the time."""
        try:
            self.future.exception(timeout)
        except TimeoutError:
            return False
        except BaseException:  # a cancelled future
            return True
        return True

    def result(self) -> Any:
        return self.future.result()

    def error(self) -> str | None:
        return str(self.future.exception()) if self.state == "FAILED" else None


def submit(spark: SparkSession, work: Callable[[], Any]) -> Task:
    return Task(spark, work)

"""Work on tiles one after the other, with progress, that can be stopped and keeps what is done."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


class Cancelled(Exception):
    """Work was stopped on request."""


@dataclass
class Progress:
    completed: int
    total: int
    message: str = ""
    metrics: dict = field(default_factory=dict)


class Task:
    """A job group of Spark that can be stopped from another thread; check() ends the work between steps."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.stopped = spark, name, threading.Event()

    def __enter__(self) -> Task:
        self.spark.sparkContext.setJobGroup(self.name, self.name, interruptOnCancel=True)
        return self

    def __exit__(self, *_: object) -> None:
        for key in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            self.spark.sparkContext.setLocalProperty(key, None)

    def cancel(self) -> None:
        """Stop the running jobs, and the steps to come."""
        self.stopped.set()
        self.spark.sparkContext.cancelJobGroup(self.name)

    def check(self) -> None:
        if self.stopped.is_set():
            raise Cancelled(self.name)


def run_tiles(task: Task, tiles: list[tuple], work: Callable[[tuple], None], done: list[tuple] | None = None, unchanged: Callable[[], bool] = lambda: True) -> Iterator[Progress]:
    """Work on tiles that aren't done yet, and note each in ``done``; a stop, an error or a changed source leaves the rest for later."""
    done = [] if done is None else done
    known = set(done)
    for tile in tiles:
        if tile in known:
            continue
        task.check()
        if not unchanged():
            raise RuntimeError(f"the source changed; {len(tiles) - len(done)} tiles are left")
        work(tile)
        done.append(tile)
        yield Progress(len(done), len(tiles), f"tile {tile}")

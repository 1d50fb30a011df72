"""Driver-side helpers: balanced schedules, retries, parallel tasks, timeouts."""

from __future__ import annotations

import heapq
import threading
import time
import uuid
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait

from pyspark.sql import SparkSession

from sluice.errors import FlowTimeout


def balanced(sizes: Sequence[float], machines: int) -> list[list[int]]:
    """Jobs of each machine, the longest first to the machine with least work: at most a third above the optimum."""
    loads = [(0.0, m) for m in range(machines)]
    out: list[list[int]] = [[] for _ in range(machines)]
    for job in sorted(range(len(sizes)), key=lambda j: (-sizes[j], j)):
        load, m = heapq.heappop(loads)
        out[m].append(job)
        heapq.heappush(loads, (load + sizes[job], m))
    return out


def retried(action: Callable, tries: int = 4, first_wait: float = 1.0, factor: float = 2.0, terminal: Callable[[Exception], bool] = lambda e: False):
    """Runs an action until it works, waiting longer each time; the last failure, or a terminal one, is raised."""
    pause = first_wait
    for left in range(tries - 1, -1, -1):
        try:
            return action()
        except Exception as e:
            if not left or terminal(e):
                raise
        time.sleep(pause)
        pause *= factor


def in_parallel(items: Iterable, task: Callable, threads: int = 8) -> list:
    """Results of a task for each item in order; after a failure, tasks that haven't begun are left out."""
    with ThreadPoolExecutor(threads) as pool:
        futures = [pool.submit(task, i) for i in items]
        done, open_ = wait(futures, return_when=FIRST_EXCEPTION)
        for f in open_:
            f.cancel()
        for f in done:
            f.result()
        return [f.result() for f in futures]


def within(spark: SparkSession, seconds: float, action: Callable[[], object]) -> object:
    """Runs an action that starts Spark jobs; interrupts them and raises FlowTimeout if it isn't done in time."""
    tag, late = f"within-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        return action()
    except Exception as e:
        if late.is_set():
            raise FlowTimeout(f"not done in {seconds} s") from e
        raise
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)

"""Several fits at once: the jobs of a small fit leave most of a cluster idle, and overlap with those of others."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from concurrent.futures import ThreadPoolExecutor, as_completed

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

#: Fits that run at the same time. Each asks for jobs of its own; Spark deals out the cores.
AT_ONCE = 8


def together(spark: SparkSession, tasks: dict[Hashable, Callable[[], object]], at_once: int = AT_ONCE) -> dict[Hashable, object]:
    """The results of all tasks by name, in the order given.

    Each runs in a thread that carries the caller's local properties, and in a scheduler pool of
    its own, so that under fair scheduling a long fit does not hold up a short one. The first
    error is raised; tasks that have not begun are then left out.
    """
    context = spark.sparkContext

    def run(place: int, task: Callable[[], object]) -> object:
        context.setLocalProperty("spark.scheduler.pool", f"fit-{place % at_once}")
        try:
            return task()
        finally:
            context.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(at_once) as threads:
        wrapped = inheritable_thread_target(spark)(run)
        begun = {threads.submit(wrapped, place, task): name for place, (name, task) in enumerate(tasks.items())}
        try:
            done = {begun[future]: future.result() for future in as_completed(begun)}
        except BaseException:
            threads.shutdown(wait=False, cancel_futures=True)
            raise
    return {name: done[name] for name in tasks}

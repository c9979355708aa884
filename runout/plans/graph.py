"""Run steps that depend on each other, several at once."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from graphlib import TopologicalSorter

from pyspark.sql import SparkSession

#: Steps that run at once; a step is mostly Spark jobs, of which most leave cores idle at their ends.
THREADS = 4


class StepsFailed(RuntimeError):
    """Some steps failed. ``errors`` holds their errors, ``skipped`` the steps that waited for them."""

    def __init__(self, errors: Mapping[str, Exception], skipped: Iterable[str]):
        self.errors = dict(errors)
        self.skipped = sorted(skipped)
        told = "; ".join(f"{name}: {type(e).__name__}: {e}" for name, e in self.errors.items())
        super().__init__(f"failed: {told}; not run: {', '.join(self.skipped) or 'none'}")


def run_steps(
    spark: SparkSession,
    steps: Mapping[str, Callable[[], object]],
    reads: Mapping[str, Iterable[str]],
    threads: int = THREADS,
) -> None:
    """Run every step after the steps it reads from, up to ``threads`` at once.

    Each step has a scheduler pool of its own, so that under ``spark.scheduler.mode=FAIR`` a long step
    leaves cores to the others; in any mode a step uses the cores that the others leave idle. A step that
    fails stops those that read from it, all others are finished before ``StepsFailed`` is raised.
    """
    order = TopologicalSorter({name: [r for r in reads.get(name, ()) if r in steps] for name in steps})
    order.prepare()

    def run(name: str) -> None:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        spark.sparkContext.setJobDescription(name)
        steps[name]()

    errors: dict[str, Exception] = {}
    finished: set[str] = set()
    running: dict[Future, str] = {}
    with ThreadPoolExecutor(threads, thread_name_prefix="step") as pool:
        while True:
            running |= {pool.submit(run, name): name for name in order.get_ready()}
            if not running:
                break
            done, _ = wait(running, return_when=FIRST_COMPLETED)
            for future in done:
                name = running.pop(future)
                if error := future.exception():
                    errors[name] = error
                else:
                    finished.add(name)
                    order.done(name)
    if errors:
        raise StepsFailed(errors, set(steps) - finished - set(errors))

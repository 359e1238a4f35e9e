"""Work on pairs in Python: results in the order of the input, a deadline for each pair, and errors kept to their pair."""

from __future__ import annotations

import contextlib
import multiprocessing
import signal
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

RESULT = "pos long, pair_id string, score double, status string, reason string, duration_ms long, budget_sec double"


class Overdue(Exception):
    """A pair has used up its time."""


@contextlib.contextmanager
def deadline(seconds: float) -> Iterator[None]:
    """Raises Overdue inside the block once the time is up; needs the main thread, where Spark's workers run."""

    def stop(*_) -> None:
        raise Overdue

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def _judge(work: Callable[[dict], float], row: dict, seconds: float) -> tuple[float | None, str, str | None]:
    try:
        with deadline(seconds):
            return float(work(row)), "success", None
    except Overdue:
        return None, "budget_exceeded", "pair_timeout"
    except Exception as problem:  # the pair's own failure, whatever it is, is its result
        return None, "analysis_failed", f"{type(problem).__name__}: {problem}"[:500]


def _judge_apart(work: Callable[[dict], float], row: dict, seconds: float) -> tuple[float | None, str, str | None]:
    """The same in a process of its own, so that a crash or an endless loop in native code ends that process only."""
    context = multiprocessing.get_context("fork")
    here, there = context.Pipe(duplex=False)
    child = context.Process(target=lambda: there.send(_judge(work, row, seconds)), daemon=True)
    child.start()
    there.close()
    try:
        if not here.poll(seconds + 0.5):
            return None, "budget_exceeded", "pair_timeout"
        return here.recv()
    except EOFError:
        return None, "analysis_failed", "worker_crashed"
    finally:
        if child.is_alive():
            child.kill()
        child.join()
        here.close()


def map_pairs(pairs: DataFrame, work: Callable[[dict], float], seconds: float = 30.0, apart: bool = False, pos: str = "pos") -> DataFrame:
    """RESULT for each row of `pairs`, which has pair_id and the place `pos`; sort by pos for the order of the input.

    A pair that is overdue gets budget_exceeded, one that fails analysis_failed
    with the reason; the others are not touched.  With `apart`, each pair has a
    process of its own, and a crash gives worker_crashed.  Work that never
    returns to Python is stopped with `apart` only.
    """
    judge = _judge_apart if apart else _judge

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                began = time.monotonic()
                score, status, reason = judge(work, row, seconds)
                out.append((row[pos], row["pair_id"], score, status, reason, int(1000 * (time.monotonic() - began)), seconds))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])

    return pairs.mapInPandas(run, RESULT)


def incidents(results: DataFrame, stage: str = "pairwise") -> DataFrame:
    """The incident rows of results that were overdue."""
    return results.where("status = 'budget_exceeded'").selectExpr("pair_id", "status", "duration_ms", "cast(budget_sec as int) pair_timeout_sec", f"'{stage}' stage")

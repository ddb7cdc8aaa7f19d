"""Fitting models by gradients that tasks sum up: what comes to the driver is one vector of the model's size per task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Tasks, and so vectors, of one sum.
TASKS = 8


def summed(rows: DataFrame, work: Callable[[np.ndarray, Iterator[pa.RecordBatch]], np.ndarray], w: np.ndarray) -> np.ndarray:
    """The sum of work(w, batches) over the tasks of `rows`, a written table, in order of the tasks, so that reruns agree.

    `rows` is a sample of bounded size, so TASKS tasks do; so many vectors come to the driver, however many files it has.
    """
    shared = rows.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = work(shared.value, batches)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([got.tobytes()])], names=["part", "total"])

    parts = rows.coalesce(TASKS).mapInArrow(run, "part bigint, total binary").collect()
    shared.destroy()
    total = np.zeros(0)
    for r in sorted(parts, key=lambda r: r.part):
        got = np.frombuffer(r.total)
        total = total + got if len(total) else got
    return total


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, rounds: int = 40, memory: int = 8) -> np.ndarray:
    """A point where f, which gives (value, gradient), is small: `rounds` steps of L-BFGS with backtracking at most."""
    value, grad = f(w)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, kept = grad.copy(), []
        for s, y in reversed(steps):
            a = s @ q / (s @ y)
            kept.append(a)
            q -= a * y
        if steps:
            s, y = steps[-1]
            q *= s @ y / (y @ y)
        else:
            q /= max(1e-12, float(np.abs(grad).max()))
        for (s, y), a in zip(steps, reversed(kept)):
            q += s * (a - y @ q / (s @ y))
        slope, t = float(grad @ q), 1.0
        if slope <= 1e-12:
            break
        while True:
            at = w - t * q
            new, g = f(at)
            if new <= value - 1e-4 * t * slope or t < 1e-4:
                break
            t /= 4
        if new >= value:
            break
        if (at - w) @ (g - grad) > 1e-12:
            steps = [*steps[1 - memory :], (at - w, g - grad)]
        done = value - new < 1e-6 * abs(value)
        w, value, grad = at, new, g
        if done:
            break
    return w

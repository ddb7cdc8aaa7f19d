"""Folds over ordered rows of each key, in batches by a sorted pass and in streams by keyed state.

A fold reads its rows in order and carries a small state. In a batch, rows are dealt by key and sorted within their
partition, and one pass keeps the state of the key it is in: no key's rows are gathered, however many there are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

State = tuple
Step = Callable[[State, tuple], tuple[State, tuple]]


def fold(rows: DataFrame, key: str, order: list[str], values: list[str], start: State, step: Step, out: str) -> DataFrame:
    """`key, *order` and the outputs of `step(state, values) -> (state, outputs)` for each row, columns named in `out`.

    Rows with a null key are one key's rows.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in [key, *order]) + ", " + out
    names = [key, *order, *(p.split()[0] for p in out.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current: Any = object()
        state = start
        for b in batches:
            told = []
            for k, at, v in zip(b[key], b[order].itertuples(index=False, name=None), b[values].itertuples(index=False, name=None)):
                if k != current and not (_null(k) and _null(current)):
                    current, state = k, start
                state, got = step(state, v)
                told.append((k, *at, *got))
            yield pd.DataFrame(told, columns=names)

    cols = list(dict.fromkeys([key, *order, *values]))
    dealt = rows.select(cols).repartition(key).sortWithinPartitions(key, *order)
    if kinds[key] not in ("tinyint", "smallint", "int", "bigint") or key in [*order, *values]:
        return dealt.mapInPandas(run, schema)
    # Whole numbers beside nulls would be floats in pandas; as text they keep all digits.
    got = dealt.withColumn(key, F.col(key).cast("string")).mapInPandas(run, schema.replace(f"{key} {kinds[key]}", f"{key} string", 1))
    return got.withColumn(key, F.col(key).cast(kinds[key]))


def fold_stream(rows: DataFrame, key: str, order: list[str], values: list[str], start: State, step: Step, out: str, state_schema: str) -> DataFrame:
    """The same fold over a stream, in append mode. Rows of a key are ordered within each micro-batch."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in [key, *order]) + ", " + out
    names = [key, *order, *(p.split()[0] for p in out.split(", "))]

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else start
        b = pd.concat(list(batches)).sort_values(order)
        told = []
        for at, v in zip(b[order].itertuples(index=False, name=None), b[values].itertuples(index=False, name=None)):
            now, got = step(tuple(now), v)
            told.append((k[0], *at, *got))
        state.update(now)
        yield pd.DataFrame(told, columns=names)

    return rows.groupBy(key).applyInPandasWithState(run, schema, state_schema, "append", GroupStateTimeout.NoTimeout)


def _null(x: Any) -> bool:
    return x is None or x != x


def fps(smoothing: float = 0.08, interval_ms: float = 250.0) -> tuple[State, Step, str, str]:
    """Smoothed frames per second of frame times in ms: an exponential mean, shown anew after `interval_ms`."""

    def step(s: State, v: tuple) -> tuple[State, tuple]:
        last, shown_at, mean, shown = s
        (now,) = v
        if last < 0:
            return (now, now, 0.0, 0.0), (0.0, 0.0)
        f = 1000 / max(1.0, now - last)
        mean = f if mean == 0 else mean + (f - mean) * smoothing
        if now - shown_at >= interval_ms:
            shown_at, shown = now, math.floor(mean + 0.5)
        return (now, shown_at, mean, float(shown)), (mean, float(shown))

    return (-1.0, -1.0, 0.0, 0.0), step, "fps double, shown double", "last double, shown_at double, mean double, shown double"


def approach(rate_in: float = 14.0, rate_out: float = 7.0) -> tuple[State, Step, str, str]:
    """A value that follows its target exponentially, at one rate downwards and one upwards. Values: (dt, target).

    The first target is taken at once; a missing target resets the value, so that the next is taken at once too.
    """

    def step(s: State, v: tuple) -> tuple[State, tuple]:
        (now,), (dt, target) = s, v
        if _null(target):
            return (-1.0,), (None,)
        if now < 0:
            now = target
        else:
            now += (target - now) * (1 - math.exp(-max(0.0, dt) * (rate_in if target < now else rate_out)))
        return (now,), (now,)

    return (-1.0,), step, "smoothed double", "now double"


def window_starts(gap: float) -> tuple[State, Step, str, str]:
    """Whether a window starts with a row: the first, and each that is `gap` or more after the last start. Values: (time,).

    The same as windows.chain() for streams, one row after another.
    """

    def step(s: State, v: tuple) -> tuple[State, tuple]:
        (start, known), (now,) = s, v
        if known and now < start + gap:
            return (start, known), (False,)
        return (float(now), True), (True,)

    return (0.0, False), step, "starts boolean", "start double, known boolean"


def locomotion(leave: float = 0.05, enter: float = 0.12, fall: float = -0.85) -> tuple[State, Step, str, str]:
    """Idle and Walk with hysteresis on speed; Fall in the air when slow and sinking fast. Values: (speed, grounded, vertical)."""

    def step(s: State, v: tuple) -> tuple[State, tuple]:
        (mode,), (speed, grounded, vertical) = s, v
        if not grounded and speed < enter and vertical <= fall:
            return (mode,), ("Fall",)
        if mode == "Walk":
            mode = "Idle" if speed < leave else "Walk"
        elif speed > enter:
            mode = "Walk"
        return (mode,), (mode,)

    return ("Idle",), step, "action string", "mode string"


def fixed_steps(step_s: float = 1 / 60, longest: float = 1 / 20, most: int = 10) -> tuple[State, Step, str, str]:
    """How many fixed steps each frame runs. A frame counts for 0 to `longest` seconds, and `most` steps are owed at most."""

    def step(s: State, v: tuple) -> tuple[State, tuple]:
        (owed,), (dt,) = s, v
        owed = min(owed + min(max(0.0, dt), longest), most * step_s)
        n = 0
        while owed >= step_s:
            owed -= step_s
            n += 1
        return (owed,), (n, owed)

    return (0.0,), step, "steps int, owed double", "owed double"


def spring(stiffness: float = 120.0, damping: float = 14.0, gravity: float = 9.8, slack: float = 0.1) -> tuple[State, Step, str, str]:
    """Height above ground held by a spring and damper; free fall when over `slack` too high. Values: (dt, target height)."""

    def step(s: State, v: tuple) -> tuple[State, tuple]:
        (y, speed, known), (dt, target) = s, v
        if known < 0:
            y = target
        off = y - target
        if off > slack:
            speed -= gravity * dt
            grounded = False
            if y + speed * dt <= target:
                y, speed = target, 0.0
        else:
            speed += (-stiffness * off - damping * speed) * dt
            grounded = True
        y += speed * dt
        return (y, speed, 1.0), (y, speed, grounded)

    return (0.0, 0.0, -1.0), step, "height double, speed double, grounded boolean", "y double, speed double, known double"


def cross_fade(seconds: float = 0.18) -> tuple[State, Step, str, str]:
    """Weights of the action that begins and of the one that it replaces, linear over `seconds`. Values: (dt, action).

    A change during a fade begins a new one, from the action that was fading in.
    """

    def step(s: State, v: tuple) -> tuple[State, tuple]:
        (action, before, since), (dt, wanted) = s, v
        if action == "":
            return (wanted, "", seconds), (wanted, 1.0, None)
        since = since + max(0.0, dt)
        if wanted != action:
            action, before, since = wanted, action, 0.0
        w = min(1.0, since / seconds)
        return (action, before, since), (action, w, before if w < 1 else None)

    return ("", "", 0.0), step, "action string, weight double, fading string", "action string, before string, since double"

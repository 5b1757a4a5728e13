"""Work and break phases of a focus timer: a pure state machine, over a batch or a stream of ticks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skriptor.session import prepare

WORK, SHORT, LONG = "work", "short", "long"


@dataclass(frozen=True)
class Timer:
    """State of one user's timer; durations in seconds."""

    phase: str = WORK
    left: int = 1500
    running: bool = False
    done: int = 0
    worked: int = 0
    day: str = ""
    work_s: int = 1500
    short_s: int = 300
    long_s: int = 900
    rounds: int = 4
    auto_break: bool = True
    auto_work: bool = False


def clamp(value, default: int, low: int, high: int) -> int:
    """A whole number within bounds; the default where it is none."""
    try:
        return min(max(int(value), low), high)
    except (TypeError, ValueError):
        return default


def _length(t: Timer, phase: str) -> int:
    return {WORK: t.work_s, SHORT: t.short_s, LONG: t.long_s}[phase]


def _over(t: Timer) -> tuple[Timer, list[tuple[str, str]]]:
    """The phase after one that ran out."""
    events = [("phase_end", t.phase)]
    if t.phase == WORK:
        t = replace(t, done=t.done + 1, worked=t.worked + t.work_s)
        events.append(("work_done", str(t.done)))
        phase, goes = (LONG if t.done % t.rounds == 0 else SHORT), t.auto_break
    else:
        phase, goes = WORK, t.auto_work
    t = replace(t, phase=phase, left=_length(t, phase), running=goes)
    return t, [*events, *([("phase_start", phase)] if goes else [])]


def step(t: Timer, action: str, seconds: int = 0, day: str = "") -> tuple[Timer, list[tuple[str, str]]]:
    """The state after start, pause, toggle, reset, skip or tick, and what happened; a new day resets the counts."""
    events: list[tuple[str, str]] = []
    if day and day != t.day:
        t = replace(t, day=day, done=0 if t.day else t.done, worked=0 if t.day else t.worked)
    if action == "start" or action == "toggle" and not t.running:
        return (t, events) if t.running else (replace(t, running=True), [("phase_start", t.phase)])
    if action in ("pause", "toggle"):
        return replace(t, running=False), events
    if action == "reset":
        return replace(t, phase=WORK, left=t.work_s, running=False), events
    if action == "skip":
        phase = SHORT if t.phase == WORK else WORK
        return replace(t, phase=phase, left=_length(t, phase), running=False), [("phase_end", t.phase)]
    if action == "tick":
        rest = max(int(seconds), 0)
        while t.running and rest >= t.left:
            rest -= t.left
            t, more = _over(t)
            events += more
        if t.running:
            t = replace(t, left=t.left - rest)
    return t, events


SCHEMA = "user_id bigint, ts timestamp, event string, detail string"
_FIELDS = list(asdict(Timer()))
_TYPES = {"phase": "string", "day": "string", "running": "boolean", "auto_break": "boolean", "auto_work": "boolean"}
STATE = ", ".join(f"{k} {_TYPES.get(k, 'bigint')}" for k in _FIELDS)


def _run(t: Timer, user: int, pdf: pd.DataFrame) -> tuple[Timer, list[tuple]]:
    out = []
    for ts, action, seconds in pdf.sort_values(["ts", "action"])[["ts", "action", "seconds"]].itertuples(index=False):
        t, events = step(t, action, 0 if pd.isna(seconds) else int(seconds), str(ts.date()))
        out += [(user, ts, e, d) for e, d in events]
    return t, out


def phase_events(actions: DataFrame, timer: Timer | None = None) -> DataFrame:
    """(user_id, ts, event, detail) of a stream of (user_id, ts, action, seconds); one small state a user."""
    prepare(actions.sparkSession)
    base = timer or Timer()

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t = Timer(**dict(zip(_FIELDS, state.get))) if state.exists else base
        for pdf in batches:
            t, out = _run(t, key[0], pdf)
            yield pd.DataFrame(out, columns=["user_id", "ts", "event", "detail"])
        state.update(tuple(asdict(t).values()))

    return actions.groupBy("user_id").applyInPandasWithState(run, SCHEMA, STATE, "append", GroupStateTimeout.NoTimeout)


def simulate(actions: list[tuple], timer: Timer | None = None) -> tuple[Timer, list[tuple[str, str]]]:
    """The machine over (action, seconds) pairs, for tests and small runs."""
    t, out = timer or Timer(), []
    for action, seconds in actions:
        t, events = step(t, action, seconds)
        out += events
    return t, out

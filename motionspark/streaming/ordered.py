"""Machines over a stream in the order of event time, whatever order and micro-batches the rows come in.

Rows are held until the watermark has passed them, then stepped in order; a key's timer steps them where no further
row comes, rings the machine's own alarms, and ends a key that has been idle for long enough. What is held of a key is
the machine's state and the rows of the watermark's delay.

Defined cases: rows without a key part or a time are left out; rows beyond the watermark are late and Spark drops them;
rows of one instant are stepped together, in the order of their values; a key that ended begins anew with its next row.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.machines import Engagement, Occlusion

_HELD = "machine string, waiting string, last long"


class Machine(Protocol):
    """What :func:`stepped` drives. Times are milliseconds."""

    def step(self, at: int, rows: list[tuple]) -> list[tuple]: ...
    def wake(self) -> int | None: ...
    def alarm(self, at: int) -> list[tuple]: ...
    def finish(self) -> list[tuple]: ...
    def packed(self) -> dict: ...
    def unpack(self, state: dict) -> None: ...


def _plain(x):
    return None if x is None or x is pd.NaT or (isinstance(x, float) and x != x) else x.item() if hasattr(x, "item") else x


def stepped(rows: DataFrame, keys: list[str], time: str, values: list[str], make: Callable[[], Machine], idle_ms: int, schema: str) -> DataFrame:
    """The rows that each key's machine gives; ``rows`` is a stream with a watermark on ``time``, ``schema`` begins with the keys."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine, waiting, last, out = make(), [], 0, []
        if state.exists:
            packed, held, last = state.get
            machine.unpack(json.loads(packed))
            waiting = json.loads(held)
        for part in parts:
            waiting += [[int(t), *map(_plain, v)] for t, *v in part[["_ms", *values]].itertuples(index=False, name=None)]
        now = state.getCurrentWatermarkMs()
        order = lambda r: [(x is not None, x) if not isinstance(x, (str, bool)) else (True, str(x)) for x in r]
        waiting.sort(key=order)
        ready = [r for r in waiting if r[0] <= now]
        waiting = waiting[len(ready) :]
        for at, group in groupby(ready, key=lambda r: r[0]):
            while (bell := machine.wake()) is not None and bell < at:
                out += machine.alarm(bell)
            out += machine.step(at, [tuple(r[1:]) for r in group])
            last = max(last, at)
        while (bell := machine.wake()) is not None and bell < now:
            out += machine.alarm(bell)
        if not waiting and last and now > last + idle_ms:
            out += machine.finish()
            state.remove()
        else:
            state.update((json.dumps(machine.packed()), json.dumps(waiting), last))
            times = [waiting[0][0]] if waiting else [(last or now) + idle_ms]
            times += [bell] if (bell := machine.wake()) is not None else []
            state.setTimeoutTimestamp(max(min(times), now + 1))
        yield pd.DataFrame([(*key, *x) for x in out], columns=names)

    narrow = rows.dropna(subset=[*keys, time]).select(*keys, time, F.unix_millis(F.col(time).cast("timestamp")).alias("_ms"), *[v for v in values if v != time])
    return narrow.groupBy(*keys).applyInPandasWithState(run, schema, _HELD, "append", GroupStateTimeout.EventTimeTimeout)


class _Quiet:
    """A machine without alarms."""

    def wake(self) -> None:
        return None

    def alarm(self, at: int) -> list[tuple]:
        return []


class EngagementSteps(_Quiet):
    def __init__(self, session: tuple[int, int], **params: float) -> None:
        self.machine, self.session, self.last = Engagement(**params), session, 0

    def _out(self) -> list[tuple]:
        out, self.machine.out = self.machine.out, []
        return out

    def step(self, at: int, rows: list[tuple]) -> list[tuple]:
        for frame, dist in rows:
            if frame is not None and dist is not None:
                self.machine.step(frame, dist, self.session[0])
                self.last = frame
        return self._out()

    def finish(self) -> list[tuple]:
        self.machine.finish(self.last, self.session[1])
        return self._out()

    def packed(self) -> dict:
        m = self.machine
        return {"state": m.state, "run": m.run, "start": m.start, "partial": m.partial, "last": self.last}

    def unpack(self, state: dict) -> None:
        self.last = state.pop("last")
        for k, v in state.items():
            setattr(self.machine, k, v)


def engagements(pairs: DataFrame, time: str, idle_ms: int, session: tuple[int, int], **params: float) -> DataFrame:
    """The stream twin of :func:`motionspark.operators.machines.engagements`: intervals as they end."""
    schema = "person_a string, person_b string, start_frame long, end_frame long, partial_start boolean, partial_end boolean"
    return stepped(pairs, ["person_a", "person_b"], time, ["frame_index", "dist_m"], lambda: EngagementSteps(session, **params), idle_ms, schema)


class OcclusionSteps(_Quiet):
    def __init__(self, **params: float) -> None:
        self.machine = Occlusion(**params)

    def step(self, at: int, rows: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        for frame, y1, y2 in rows:
            out += self.machine.step(frame, None if y1 is None or y2 is None else y2 - y1, y2)
        return out

    def finish(self) -> list[tuple]:
        return self.machine.finish()

    def packed(self) -> dict:
        return self.machine.packed()

    def unpack(self, state: dict) -> None:
        self.machine.unpack(state)


def occlusions(rows: DataFrame, time: str, idle_ms: int, **params: float) -> DataFrame:
    """The stream twin of :func:`motionspark.operators.machines.occlusions`: spans once no later one can be joined to them."""
    return stepped(rows, ["tracklet_id"], time, ["frame_index", "y1", "y2"], lambda: OcclusionSteps(**params), idle_ms, "tracklet_id string, start_frame long, end_frame long")


class Readiness:
    """Whether a session may go on: its end and a buffer must have passed, and one camera have done all its clips seen so far.

    Cameras that have not are timed out. Without any tag bytes by then the session is blocked (``tag_required``), else ``ready``.
    A decision is final: later clips change nothing.
    """

    def __init__(self, buffer_ms: int) -> None:
        self.buffer = buffer_ms
        self.end: int | None = None
        self.clips: dict[str, dict[str, bool]] = {}
        self.tags = self.closed = self.passed = False

    def step(self, at: int, rows: list[tuple]) -> list[tuple]:
        if self.closed:
            return []
        for cam, clip, done, tag_bytes, end in rows:
            if end is not None:
                self.end = end if self.end is None else max(self.end, end)
            if cam is not None and clip is not None:
                cam_clips = self.clips.setdefault(cam, {})
                cam_clips[clip] = cam_clips.get(clip, False) or done is True
            self.tags |= (tag_bytes or 0) > 0
        self.passed = self.end is not None and at > self.end + self.buffer
        return self._decide(at) if self.passed else []

    def wake(self) -> int | None:
        return None if self.end is None or self.passed or self.closed else self.end + self.buffer

    def alarm(self, at: int) -> list[tuple]:
        self.passed = True
        return self._decide(at)

    def _decide(self, at: int) -> list[tuple]:
        whole = sorted(c for c, clips in self.clips.items() if all(clips.values()))
        if not whole:
            return []
        out = (at, "ready" if self.tags else "tag_required", ",".join(whole), ",".join(sorted(set(self.clips) - set(whole))))
        self.closed, self.clips = True, {}
        return [out]

    def finish(self) -> list[tuple]:
        return []

    def packed(self) -> dict:
        return {"end": self.end, "clips": self.clips, "tags": self.tags, "closed": self.closed, "passed": self.passed}

    def unpack(self, state: dict) -> None:
        for k, v in state.items():
            setattr(self, k, v)


READINESS = "session_id string, decided_at long, decision string, cameras_done string, cameras_timed_out string"


def readiness(events: DataFrame, time: str, buffer_ms: int, keep_ms: int) -> DataFrame:
    """Decisions over a stream (session_id, cam_id, clip_id, done, tag_bytes, end_ms) with a watermark, by event time as the clock.

    A decided session is remembered for ``keep_ms`` after its last row, so late clips do not open it again; then its state goes.
    """
    return stepped(events, ["session_id"], time, ["cam_id", "clip_id", "done", "tag_bytes", "end_ms"], lambda: Readiness(buffer_ms), keep_ms, READINESS)

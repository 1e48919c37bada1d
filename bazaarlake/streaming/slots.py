"""Rate slots of keys: how many calls a key may still make, folded over its log of calls.

A key's minute begins with the first check at least a minute after the last beginning; a rate-limited answer
rests the key for 65 seconds. The effective rate is a share of the nominal one, 1 at least.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "slot string, id bigint, at double, granted boolean, calls int"
_STATE = "begun double, calls int, rest_until double"
WINDOW, REST = 60.0, 65.0


def step(state: tuple[float, int, float], at: float, limited: bool, rpm: int, margin: float) -> tuple[bool, tuple[float, int, float]]:
    begun, calls, rest = state
    if at < rest:
        return False, state
    if at - begun >= WINDOW:
        begun, calls = at, 0
    if calls >= max(1, int(rpm * margin)):
        return False, (begun, calls, rest)
    return True, (begun, calls + 1, at + REST if limited else rest)


def granted(calls: DataFrame, rpm: int = 15, margin: float = 0.8) -> DataFrame:
    """Each call (slot, id, at, limited) of a stream with whether its key had a slot for it."""

    def run(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else (-WINDOW, 0, 0.0)
        out = []
        for r in pd.concat(list(batches)).sort_values(["at", "id"]).itertuples():
            ok, now = step(now, r.at, bool(r.limited), rpm, margin)
            out.append((key[0], r.id, r.at, ok, now[1]))
        state.update(now)
        yield pd.DataFrame(out, columns=["slot", "id", "at", "granted", "calls"])

    return calls.groupBy("slot").applyInPandasWithState(run, OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


ROTATED = "pool string, id bigint, at double, slot int, tried int"
_POOL = "begun array<double>, calls array<int>, rest_until array<double>"


def rotated(calls: DataFrame, slots: int, rpm: int = 15, margin: float = 0.8) -> DataFrame:
    """Each call (pool, id, at, limited) of a stream with the key that answered it: the first of ``slots`` keys, in their order, that is free.

    ``limited`` is an array with what each key would answer: a key that is rate-limited rests, and the next is
    tried. ``tried`` is the number of keys asked; slot is null where all rest or are used up.
    """

    def run(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = [list(x) for x in zip(*state.get, strict=True)] if state.exists else [[-WINDOW, 0, 0.0] for _ in range(slots)]
        out = []
        for r in pd.concat(list(batches)).sort_values(["at", "id"]).itertuples():
            answered, tried = None, 0
            for k in range(slots):
                limited = r.limited is not None and k < len(r.limited) and bool(r.limited[k])
                ok, then = step(tuple(now[k]), r.at, limited, rpm, margin)
                now[k] = list(then)
                tried += ok
                if ok and not limited:
                    answered = k
                    break
            out.append((key[0], r.id, r.at, answered, tried))
        state.update(tuple([x[j] for x in now] for j in range(3)))
        frame = pd.DataFrame(out, columns=["pool", "id", "at", "slot", "tried"])
        frame["slot"] = frame["slot"].astype("Int32")
        yield frame

    return calls.groupBy("pool").applyInPandasWithState(run, ROTATED, _POOL, "append", GroupStateTimeout.NoTimeout)

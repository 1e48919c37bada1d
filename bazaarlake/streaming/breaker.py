"""Circuit breaker per site over a stream of fetch outcomes.

After ``limit`` blocks in a row a site is open for ``hold`` seconds; a success or the end of that time sets the
count back. While a site is open its outcomes are refused and change nothing. Time is that of the events.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "domain string, id bigint, at double, allowed boolean, in_a_row int, open_until double"
_STATE = "in_a_row int, open_until double"
#: Statuses that count as blocks.
BLOCKED = (403, 429, 503)


def step(in_a_row: int, open_until: float, at: float, status: int, limit: int, hold: float) -> tuple[bool, int, float]:
    """(allowed, blocks in a row, open until) after one outcome."""
    if open_until > at:
        return False, in_a_row, open_until
    if open_until:
        in_a_row, open_until = 0, 0.0
    in_a_row = in_a_row + 1 if status in BLOCKED else 0
    if in_a_row >= limit:
        open_until = at + hold
    return True, in_a_row, open_until


def _folded(limit: int, hold: float):
    def run(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        in_a_row, open_until = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(batches)).sort_values(["at", "id"])
        out = []
        for r in rows.itertuples():
            allowed, in_a_row, open_until = step(in_a_row, open_until, r.at, r.status, limit, hold)
            out.append((key[0], r.id, r.at, allowed, in_a_row, open_until))
        state.update((in_a_row, open_until))
        yield pd.DataFrame(out, columns=["domain", "id", "at", "allowed", "in_a_row", "open_until"])

    return run


def guarded(outcomes: DataFrame, limit: int = 5, hold: float = 3600.0) -> DataFrame:
    """Each outcome (domain, id, at, status) of a stream with what the breaker makes of it."""
    return outcomes.groupBy("domain").applyInPandasWithState(_folded(limit, hold), OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def replayed(outcomes: DataFrame, limit: int = 5, hold: float = 3600.0) -> DataFrame:
    """The same over a whole table: one task folds one site's outcomes."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        in_a_row, open_until, out = 0, 0.0, []
        for r in rows.sort_values(["at", "id"]).itertuples():
            allowed, in_a_row, open_until = step(in_a_row, open_until, r.at, r.status, limit, hold)
            out.append((key[0], r.id, r.at, allowed, in_a_row, open_until))
        return pd.DataFrame(out, columns=["domain", "id", "at", "allowed", "in_a_row", "open_until"])

    return outcomes.groupBy("domain").applyInPandas(run, OUT)

"""Streams that decide row by row from the state of a key: a response cache and a rate limit.

Rows of a key are taken in the order of their times within each batch.  What arrives in a
later batch with an earlier time is decided by what is known then; a response from after a
call never answers it.  The state of a key is bounded: one response, or as many times as
calls are allowed.  Keys are called upon in groups of like hash.  A key's state goes once the watermark has passed its end, which changes no result,
as decisions compare times and not whether state is still there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


#: Groups into which keys are dealt by their hash.  A group is called once a batch, so that calls do not grow with the keys.
GROUPS = 1024


def _rows(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True).sort_values(["of", "at", "id"], ignore_index=True)


def _grouped(calls: DataFrame, keys: list[str], whole: list[str], lateness: str) -> DataFrame:
    """Calls that have all they need, with their times in microseconds as `at`, their keys as one text `of` and its group."""
    rows = calls.where(" and ".join(f"`{c}` is not null" for c in whole)).withColumn("at", F.unix_micros("ts")).withWatermark("ts", lateness)
    of = F.to_json(F.array(*(F.col(f"`{k}`").cast("string") for k in keys)))
    return rows.withColumn("of", of).withColumn("group", F.pmod(F.xxhash64("of"), F.lit(GROUPS)).cast("int"))


def _keep(state: GroupState, held: dict, end: Callable) -> None:
    """Keep what the watermark has not passed the end of; decisions compare times, and rows before the watermark do not come."""
    mark = state.getCurrentWatermarkMs()
    ends = {k: end(v) // 1000 + 1 for k, v in held.items()}
    live = {k: held[k] for k, e in ends.items() if e > mark}
    if not live:
        if state.exists:
            state.remove()
        return
    state.update((list(live), list(live.values())))
    state.setTimeoutTimestamp(max(min(ends[k] for k in live), mark + 1))


def _held(state: GroupState) -> dict[str, list[int]]:
    return {k: list(v) for k, v in zip(*state.get, strict=True)} if state.exists else {}


STATE = "keys array<string>, held array<array<long>>"


def answered(calls: DataFrame, keys: list[str], ttl: int, lateness: str = "1 day") -> DataFrame:
    """Each call (id, ts, status and keys) with hit_id, the call whose response answers it, and that response's age in seconds.

    A response answers calls of its keys for `ttl` seconds, the last moment included.  A call that nothing answers is
    a miss with a null hit_id; if its status is `ok`, its own response is kept from then on.  Hits prolong nothing.
    Calls without an id, a time or a key are not looked up and have no row.
    """
    kinds = {f.name: f.dataType.simpleString() for f in calls.schema}
    length = ttl * 1_000_000

    def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = _held(state)
        if state.hasTimedOut:
            _keep(state, held, lambda v: v[1] + length)
            return
        rows = _rows(frames)
        hits, ages = [], []
        for of, i, at, status in zip(*(rows[c].tolist() for c in ("of", "id", "at", "status")), strict=True):
            now = held.get(of)
            hit = now is not None and 0 <= at - now[1] <= length
            if not hit and status == "ok" and (now is None or at >= now[1]):
                held[of] = [i, at]
            hits.append(now[0] if hit else None), ages.append((at - now[1]) / 1e6 if hit else None)
        _keep(state, held, lambda v: v[1] + length)
        yield rows[[*keys, "id"]].assign(hit_id=pd.array(hits, "Int64"), age_s=pd.array(ages, "Float64"))

    rows = _grouped(calls, keys, ["id", "ts", *keys], lateness)
    out = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", id long, hit_id long, age_s double"
    return rows.groupBy("group").applyInPandasWithState(run, out, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def limited(calls: DataFrame, by: str, most: int = 120, seconds: int = 60, lateness: str = "1 day") -> DataFrame:
    """Each call (id, ts and the key) with `allowed`: whether fewer than `most` allowed calls of its key lie less than so many seconds back.

    Calls that are refused count for nothing.  Calls without an id, a time or a key have no row.
    """
    kind = dict(calls.dtypes)[by]
    length = seconds * 1_000_000

    def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = _held(state)
        if not state.hasTimedOut:
            rows = _rows(frames)
            allowed = []
            for of, at in zip(rows["of"].tolist(), rows["at"].tolist(), strict=True):
                held[of] = times = [t for t in held.get(of, ()) if at - t < length]
                allowed.append(len(times) < most)
                if allowed[-1]:
                    times.append(at)
            yield rows[[by, "id"]].assign(allowed=allowed)
        _keep(state, held, lambda v: max(v, default=0) + length)

    rows = _grouped(calls, [by], ["id", "ts", by], lateness)
    return rows.groupBy("group").applyInPandasWithState(run, f"`{by}` {kind}, id long, allowed boolean", STATE, "append", GroupStateTimeout.EventTimeTimeout)

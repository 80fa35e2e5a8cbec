"""Streams with state of their own: records that expire and come back, and sessions that are reported while still open.

State lives in Spark's state store, one entry a key, and timers on event time drop it once the watermark has passed; nothing depends on when a batch runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from logspark.session import scratch_path, ship
from logspark.streaming.jobs import SESSION_IDLE, run_latest, run_to_table

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE = "spark.sql.streaming.stateStore.providerClass"


def _micros(times: pd.Series) -> list[int]:
    return sorted(times.dropna().astype("datetime64[us]").astype("int64").tolist())


def _sightings(life: int):
    """Lets a key's record through if none of it lives, and keeps when it expires. A batch's states come and go with its rows, many keys at a time."""

    def step(key, frames, state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        until = state.get[0] if state.exists else None
        shown = []
        for ts in _micros(pd.concat([frame["ts"] for frame in frames])):
            if until is None or ts >= until:
                until = ts + life
                shown.append(ts)
        state.update((until,))
        state.setTimeoutTimestamp(max(-(-until // 1000), state.getCurrentWatermarkMs() + 1))
        if shown:
            times = pd.to_datetime(pd.Series(shown, dtype="int64"), unit="us")
            yield pd.DataFrame({"id": key[0], "ts": times, "ttl": [(s + life) // 1_000_000 for s in shown]})

    return step


def sightings(records: DataFrame, life_seconds: int, late: str = "10 minutes") -> DataFrame:
    """``id, ts, ttl``: records (``id, ts``) that are not hidden by an earlier one of their id, which hides others for ``life_seconds`` of event time.

    A record at or after the end of that life comes through again. ``ttl`` is its own end in epoch seconds, as ``live_rows`` reads it. Within a batch records
    count in order of ``ts``; those later than the watermark are dropped, and rows without ``ts`` too.
    """
    kind = records.schema["id"].dataType.simpleString()
    ship(records.sparkSession)
    ready = records.select("id", "ts").where("ts is not null").withWatermark("ts", late)
    schema = f"id {kind}, ts timestamp, ttl long"
    return ready.groupBy("id").applyInPandasWithState(_sightings(life_seconds * 1_000_000), schema, "until long", "append", GroupStateTimeout.EventTimeTimeout)


def run_sightings(records: DataFrame, life_seconds: int, late: str = "10 minutes", path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run :func:`sightings` until all present input is done, and read the table of what came through; its states lie in Spark's RocksDB store, not in memory."""
    spark = records.sparkSession
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        return run_to_table(sightings(records, life_seconds, late), path, checkpoint)
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def _sessions(idle: int):
    def step(key, frames, state) -> Iterator[pd.DataFrame]:
        open_ = [list(s) for s in zip(*state.get, strict=True)] if state.exists else []
        gone: set[int] = set()
        touched: set[int] = set()
        if not state.hasTimedOut:
            for ts in _micros(pd.concat([frame["ts"] for frame in frames])):
                meets = [s for s in open_ if ts < s[1] and ts + idle > s[0]]
                merged = [min([ts, *(s[0] for s in meets)]), max([ts + idle, *(s[1] for s in meets)]), 1 + sum(s[2] for s in meets)]
                gone |= {s[0] for s in meets}
                open_ = [s for s in open_ if s not in meets] + [merged]
                touched = (touched - {s[0] for s in meets}) | {merged[0]}
        watermark = state.getCurrentWatermarkMs() * 1000
        rows = [(*s, s[1] <= watermark) for s in sorted(open_) if s[0] in touched or s[1] <= watermark]
        # a session that begins earlier now, or became part of another: its old row counts no turns
        rows += [(start, start, 0, True) for start in sorted(gone - {s[0] for s in open_})]
        left = [s for s in open_ if s[1] > watermark]
        if left:
            state.update(tuple(map(list, zip(*left, strict=True))))
            state.setTimeoutTimestamp(max(-(-min(s[1] for s in left) // 1000), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if rows:
            out = pd.DataFrame(rows, columns=["session_start", "session_end", "turns", "closed"])
            for c in ("session_start", "session_end"):
                out[c] = pd.to_datetime(out[c], unit="us")
            out.insert(0, "key", key[0])
            yield out

    return step


def session_updates(turns: DataFrame, idle: str = SESSION_IDLE, late: str = "10 minutes", key: str = "conv_id") -> DataFrame:
    """``key, session_start, session_end, turns, closed`` in update mode: every session that a batch changes or ends, open ones with what they hold so far.

    A late turn may join two sessions or begin one earlier; the row that no longer holds then comes with 0 turns. A session ends ``idle`` after its last turn
    and is dropped from the state once the watermark has passed that.
    """
    seconds, unit = idle.split()
    if not unit.startswith("second"):
        raise ValueError("the idle time is given in seconds")
    kind = turns.schema[key].dataType.simpleString()
    ship(turns.sparkSession)
    ready = turns.select(F.col(key).alias("key"), "ts").where("ts is not null").withWatermark("ts", late)
    schema = f"key {kind}, session_start timestamp, session_end timestamp, turns long, closed boolean"
    state = "starts array<long>, ends array<long>, turns array<long>"
    found = ready.groupBy("key").applyInPandasWithState(_sessions(int(seconds) * 1_000_000), schema, state, "update", GroupStateTimeout.EventTimeTimeout)
    return found.withColumnRenamed("key", key)


def run_sessions(turns: DataFrame, idle: str = SESSION_IDLE, late: str = "10 minutes", key: str = "conv_id", path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """All sessions of the present input, open ones included: ``key, session_start, session_end, turns, closed``."""
    spark = turns.sparkSession
    newest = run_latest(session_updates(turns, idle, late, key), [key, "session_start"], path or scratch_path(spark, "sessions"), checkpoint)
    return newest.where("turns > 0")

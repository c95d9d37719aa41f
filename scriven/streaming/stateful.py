"""Service behaviour over event streams: request limiter, login bans, progress, and windows."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import constants as K


def admit(times: list[float], log: list[float], limit: int, window: float) -> tuple[list[bool], list[float]]:
    """(admitted or not, log after) of requests in order of time: the log holds admitted requests of the last window; refused ones are not logged."""
    out, held = [], deque(log)
    for t in times:
        while held and t - held[0] >= window:
            held.popleft()
        ok = len(held) < limit
        out.append(ok)
        if ok:
            held.append(t)
    return out, list(held)


_LIMITED = "user_id bigint, event_id bigint, ts timestamp, admitted boolean"


def limiter(events: DataFrame, limit: int = K.RATE_LIMIT, window_s: float = K.RATE_WINDOW_S) -> DataFrame:
    """(user_id, event_id, ts, admitted) of a batch of requests, each client on its own.

    The rule is recursive, a refused request does not count for later ones, so
    requests are folded in order. Where a client is silent for a window its log
    is empty: its requests are parted there, and each part is a group of its own.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "event_id"])
        ok, _ = admit([t.timestamp() for t in pdf["ts"]], [], limit, window_s)
        return pdf.assign(admitted=ok)[["user_id", "event_id", "ts", "admitted"]]

    rows = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")).where("user_id IS NOT NULL AND ts IS NOT NULL")
    return _parted(rows, window_s).groupBy("user_id", "part").applyInPandas(run, _LIMITED)


def limiter_stream(events: DataFrame, limit: int = K.RATE_LIMIT, window_s: float = K.RATE_WINDOW_S) -> DataFrame:
    """The limiter over a stream: the state of a client is its log, dropped when it falls silent."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        ok, log = admit([t.timestamp() for t in pdf["ts"]], log, limit, window_s)
        state.update((log,))
        state.setTimeoutDuration(int(window_s * 2000))
        yield pdf.assign(admitted=ok)[["user_id", "event_id", "ts", "admitted"]]

    rows = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return rows.groupBy("user_id").applyInPandasWithState(run, _LIMITED, "log array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def attempts(events: DataFrame, window_s: int = K.RATE_WINDOW_S) -> DataFrame:
    """(user_id, event_id, attempts): requests of a client within the window up to and with each one."""
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-window_s * 1_000_000, 0)
    return events.select("user_id", "event_id", F.count("*").over(w).alias("attempts"))


#: Rows of a client that are folded as one group, at least.
FOLD_ROWS = 10_000


def _parted(rows: DataFrame, silence_s: float) -> DataFrame:
    """``rows`` with ``part``: groups of about ``FOLD_ROWS`` that begin where a client has been silent for ``silence_s``."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w) >= int(silence_s * 1_000_000)
    rows = rows.withColumn("nth", F.row_number().over(w)).withColumn("gap", F.coalesce(gap, F.lit(True)))
    begun = F.max(F.when(F.col("gap"), F.col("nth"))).over(w)
    return rows.withColumn("part", F.floor(begun / FOLD_ROWS)).drop("nth", "gap")


def ban_states(times: list[float], kinds: list[str], fail: str, success: str, fails: list[float], until: float) -> tuple[list[str], list[float], float]:
    """(state of each login event, failures held, end of the ban) from events in order of time."""
    out, held = [], deque(fails)
    for t, kind in zip(times, kinds, strict=True):
        if t < until:
            out.append("banned")
        elif kind == success:
            held.clear()
            out.append("ok")
        elif kind == fail:
            while held and t - held[0] >= K.FAIL_WINDOW_S:
                held.popleft()
            held.append(t)
            if len(held) >= K.FAIL_LIMIT:
                until = t + K.BAN_S
                held.clear()
            out.append("failed")
        else:
            out.append("none")
    return out, list(held), until


_BANNED = "user_id bigint, event_id bigint, ts timestamp, state string"


def bans(events: DataFrame, fail: str = "error", success: str = "signup") -> DataFrame:
    """(user_id, event_id, ts, state) of login events: five failures in 600 s ban for 900 s; a success clears; other events are no attempt."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "event_id"])
        states, _, _ = ban_states([t.timestamp() for t in pdf["ts"]], list(pdf["event_type"]), fail, success, [], 0.0)
        return pdf.assign(state=states)[["user_id", "event_id", "ts", "state"]]

    rows = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type").where("user_id IS NOT NULL AND ts IS NOT NULL")
    # after so long a silence neither a failure nor a ban is left
    return _parted(rows, max(K.FAIL_WINDOW_S, K.BAN_S)).groupBy("user_id", "part").applyInPandas(run, _BANNED)


def bans_stream(events: DataFrame, fail: str = "error", success: str = "signup") -> DataFrame:
    """The bans over a stream: the state of a client is its failures and the end of its ban, dropped when it falls silent."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        fails, until = state.get if state.exists else ([], 0.0)
        pdf = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        states, fails, until = ban_states([t.timestamp() for t in pdf["ts"]], list(pdf["event_type"]), fail, success, list(fails), until)
        state.update((fails, until))
        state.setTimeoutDuration(int(max(K.FAIL_WINDOW_S, K.BAN_S) * 2000))
        yield pdf.assign(state=states)[["user_id", "event_id", "ts", "state"]]

    rows = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return rows.groupBy("user_id").applyInPandasWithState(run, _BANNED, "fails array<double>, until double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def progress_changes(events: DataFrame) -> DataFrame:
    """(user_id, event_id, event_type): an event is sent only when its kind differs from the client's last one."""
    last = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.withColumn("last", last).where(~F.col("event_type").eqNullSafe(F.col("last"))).select("user_id", "event_id", "event_type")


def live_progress(events: DataFrame, now: str, ttl_s: int = K.PROGRESS_TTL_S) -> DataFrame:
    """(user_id, event_type): the latest event of each client that is younger than the time to live at ``now``."""
    latest = events.groupBy("user_id").agg(F.max("ts").alias("ts"), F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))
    return latest.where(F.col("ts") > F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(ttl_s)} SECONDS")).select("user_id", "event_type")


def hourly(events: DataFrame) -> DataFrame:
    """(hour, event_type, events, total): tumbling windows of one hour; late rows are dropped after one day in a stream."""
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    if events.isStreaming:
        rows = rows.withWatermark("ts", "1 day")
    by = rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return by.select(F.col("w.start").alias("hour"), "event_type", "events", F.round("total", 2).alias("total"))


def sliding(events: DataFrame, length: str = "2 hours", step: str = "1 hour") -> DataFrame:
    """(start, event_type, events) of overlapping windows; late rows are dropped after one day in a stream."""
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    if events.isStreaming:
        rows = rows.withWatermark("ts", "1 day")
    by = rows.groupBy(F.window("ts", length, step).alias("w"), "event_type").agg(F.count("*").alias("events"))
    return by.select(F.col("w.start").alias("start"), "event_type", "events")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """(user_id, start, events): a client's events without a silence of ``gap`` between them are one session."""
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    if events.isStreaming:
        rows = rows.withWatermark("ts", "1 day")
    by = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events"))
    return by.select("user_id", F.col("w.start").alias("start"), "events")


# fixed values: how far a check is when it reaches a stage
STAGES = {"parse": 10, "web": 55, "aigc": 70, "save": 92, "done": 100, "error": 100}


def stage_percent(stage: Column) -> Column:
    """Progress of a stage; null for others."""
    return F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv])[stage]


def ingest_stream(documents: DataFrame, path: str, checkpoint: str):
    """A stream of documents appended to a table of sentences, batch by batch; titles seen within a day are dropped."""
    from ..operators.index import library_sentences, sentences

    fresh = documents.withWatermark("created_at", "1 day").dropDuplicatesWithinWatermark(["title"])

    def append(batch: DataFrame, batch_id: int) -> None:
        library_sentences(sentences(batch)).withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(path)

    return fresh.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Execution records as a stream: an experiment that doesn't report in time becomes failed when event time has passed its limit."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STATE = "started bigint, seconds int, ended bigint, return_code int, metric double, status string"


def finished(log: DataFrame, late: str = "10 minutes") -> DataFrame:
    """experiment, started, ended (microseconds), seconds, return_code, metric, reported: one row for each experiment of a streamed log, once it ends or times out.

    The state holds one start and one end of an experiment; it goes with its row. Rows that come after that, or later than ``late``, are dropped.
    """
    import pandas as pd

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        none = (None,) * 6
        if state.hasTimedOut:
            started, seconds, *_ = state.get
            state.remove()
            yield pd.DataFrame([(key[0], started, None, seconds, None, None, None)], columns=_COLUMNS).astype(_KINDS)
            return
        started, seconds, ended, code, metric, status = state.get if state.exists else none
        for rows in batches:
            for r in rows.itertuples():
                if r.kind == "start" and (started is None or r.at_us < started):
                    started, seconds = r.at_us, r.timeout_seconds
                elif r.kind == "end" and (ended is None or r.at_us < ended):
                    ended, code, metric, status = r.at_us, *(None if pd.isna(x) else x for x in (r.return_code, r.metric, r.status))
        if started is not None and ended is not None:
            if state.exists:
                state.remove()
            yield pd.DataFrame([(key[0], started, ended, seconds, code, metric, status)], columns=_COLUMNS).astype(_KINDS)
            return
        state.update((started, None if seconds is None else int(seconds), ended, None if code is None else int(code), metric, status))
        if started is not None:
            state.setTimeoutTimestamp(max(started // 1000 + int(seconds) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([], columns=_COLUMNS).astype(_KINDS)

    rows = log.withWatermark("at", late).select("experiment", "kind", "at", F.unix_micros("at").alias("at_us"), "timeout_seconds", "return_code", "metric", "status")
    return rows.groupBy("experiment").applyInPandasWithState(fold, _SCHEMA, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


_SCHEMA = "experiment string, started bigint, ended bigint, seconds int, return_code int, metric double, status string"
_COLUMNS = ["experiment", "started", "ended", "seconds", "return_code", "metric", "status"]
_KINDS = {"started": "Int64", "ended": "Int64", "seconds": "Int32", "return_code": "Int32", "metric": "Float64"}


def as_log(done: DataFrame) -> DataFrame:
    """What ``finished`` gave, as a log of starts and ends for ``execution_records``, so that batch and stream share their rules."""
    start = F.struct(F.lit("start").alias("kind"), F.timestamp_micros("started").alias("at"), F.col("seconds").alias("timeout_seconds"), F.lit(None).cast("int").alias("return_code"), F.lit(None).cast("double").alias("metric"), F.lit(None).cast("string").alias("status"))
    end = F.struct(F.lit("end").alias("kind"), F.timestamp_micros("ended").alias("at"), F.lit(None).cast("int").alias("timeout_seconds"), "return_code", "metric", "status")
    return done.select("experiment", F.inline(F.array(start, end))).where("at is not null")

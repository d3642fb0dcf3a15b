"""Streams of experiment results."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def decide(results: DataFrame, key: str, seq: str, value: str, higher: bool = True) -> DataFrame:
    """Each result with keep, discard or failed against the best value of its schedule so far, which is the only state."""
    import pandas as pd

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(seq)
        out = []
        for r in rows.itertuples():
            x = getattr(r, value)
            if pd.isna(x):
                what = "failed"
            elif best is None or (x > best if higher else x < best):
                what, best = "keep", float(x)
            else:
                what = "discard"
            out.append((k[0], getattr(r, seq), None if pd.isna(x) else x, what, best))
        if best is not None:
            state.update((best,))
        yield pd.DataFrame(out, columns=[key, seq, value, "decision", "best"])

    kinds = dict(results.dtypes)
    picked = results.select(key, seq, F.col(value).cast("double").alias(value))
    return picked.groupBy(key).applyInPandasWithState(fold, f"{key} {kinds[key]}, {seq} {kinds[seq]}, {value} double, decision string, best double", "best double", "append", GroupStateTimeout.NoTimeout)


def resume(source: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done yet."""
    return source.join(done.select(key).distinct(), key, "left_anti")


def append_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what is there and stop; a later call goes on where this one ended."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(stream: DataFrame, ts: str, keys: list[str], value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and mean by event-time window, for data at most ``late`` behind."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))

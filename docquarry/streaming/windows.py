"""Event-time windows over a stream or a table: tumbling, sliding and session windows.

The same expressions serve both. On a stream the watermark bounds the state: a window is given out once,
when events are later than its end by ``lateness``, and rows that come after that are dropped. A
heartbeat (a row whose keys are null) moves the time on without counting.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tumbling(width: str, at: str = "ts") -> Column:
    return F.window(at, width)


def sliding(width: str, step: str, at: str = "ts") -> Column:
    return F.window(at, width, step)


def session(gap: str, at: str = "ts") -> Column:
    """Runs of events less than ``gap`` apart, ending ``gap`` after their last one."""
    return F.session_window(at, gap)


def windowed(events: DataFrame, window: Column, keys: list[str], lateness: str = "1 hour", at: str = "ts", value: str = "value") -> DataFrame:
    """``window_start, window_end``, keys, ``events, total, highest`` per window and keys.

    Totals add values of two digits exactly. Rows without a time are left out, null values add nothing.
    """
    amount = F.col(value).cast("decimal(18,2)")
    grouped = events.withWatermark(at, lateness).groupBy(window.alias("w"), *keys)
    real = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.lit(True))
    out = grouped.agg(F.count_if(real).alias("events"), F.sum(amount).cast("double").alias("total"), F.max(value).alias("highest"))
    # A filter of the keys would be pushed below the watermark, which heartbeats have to reach.
    out = out.filter("events > 0")
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "events", "total", "highest")


def start_windows(windows: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append each window to a table when it is over; a restarted query goes on from its checkpoint."""
    writer = windows.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

"""Extension: the state of a change log that is still being written.

The batch readers of the event log replay it up to an event; here the last value of every field and
key that is not null is kept by a stateful aggregation, one row of state a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current_state(log: DataFrame, key: str, fields: Sequence[str], order: str) -> DataFrame:
    """(key, fields...): the value with the highest ``order`` among those that are not null.

    Works on a streaming DataFrame (output mode update or complete) and on a batch one; late rows of
    a lower order change nothing. A field without any value is null.
    """
    best = [F.max(F.when(F.col(f).isNotNull(), F.struct(F.col(order).alias("o"), F.col(f).alias("v")))).alias(f) for f in fields]
    return log.groupBy(key).agg(*best).select(key, *[F.col(f)["v"].alias(f) for f in fields])


def rain_windows(weather: DataFrame, t: str, rate: str, width: str, late: str) -> DataFrame:
    """(start, end, mean_rate, n) of a stream of weather readings by tumbling event-time windows; readings
    later than the watermark ``late`` are dropped by the engine."""
    w = F.window(F.col(t), width)
    out = weather.withWatermark(t, late).groupBy(w).agg(F.avg(rate).alias("mean_rate"), F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "mean_rate", "n")

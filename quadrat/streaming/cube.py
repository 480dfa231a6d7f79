"""The cube of a stream: counts of groups and labels in event-time windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed_cube(stream: DataFrame, time: str, groups: Sequence[Column], labels: Sequence[Column], count: Column | None = None, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """(window, grp, label, n) of a stream's records; records later than `late` are dropped by the watermark, which also bounds the state.

    The same plan works on a static table.  Aggregation is partial before the
    exchange, so a label that most records hold is one row a task.
    """
    key = lambda axes: F.concat_ws(":", *[a.cast("string") for a in axes])
    n = F.lit(1.0) if count is None else F.coalesce(count.cast("double"), F.lit(0.0))
    rows = stream.withWatermark(time, late)
    return rows.groupBy(F.window(time, window).alias("window"), key(groups).alias("grp"), key(labels).alias("label")).agg(F.sum(n).alias("n"))

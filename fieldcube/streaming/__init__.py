"""Cubes over streams: time windows with a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as fn


def windowed(df: DataFrame, ts: str, width: str, how: str, value: str, keys: Sequence[str] = (), slide: str | None = None, late: str | None = None) -> DataFrame:
    """(start, keys, value): ``value`` reduced in windows of event time, for a batch or a streaming table.

    ``late``: how long a streaming window stays open for late rows; its state goes then.
    """
    if late is not None:
        df = df.withWatermark(ts, late)
    window = F.window(ts, width, slide)
    out = df.groupBy(window.alias("__w"), *keys).agg(fn.reduction(how)(F.col(value)).alias(value))
    return out.select(F.col("__w.start").alias("start"), *keys, value)

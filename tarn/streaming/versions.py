"""Feature versions from an endless source. An extension: the batch form is ``operators.rivers.dedupe_versions``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_by_window(stream: DataFrame, key: str, at: str, *, every: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """The newest record of each key in each window of event time: ``window, key``, the other columns. Records later than the watermark are left out, so state stays bounded."""
    others = F.struct(*(c for c in stream.columns if c not in (key, at)))
    got = stream.withWatermark(at, late).groupBy(F.window(at, every), key).agg(F.max(at).alias(at), F.max_by(others, at).alias("b"))
    return got.select("window", key, at, "b.*")

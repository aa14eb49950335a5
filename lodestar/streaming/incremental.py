"""Discovery over streams: sufficient statistics are mergeable, so windows of them are plain aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_fit(events: DataFrame, ts: str, x: str, y: str, window: str = "1 hour", late: str = "10 minutes", keys: list[str] | None = None) -> DataFrame:
    """Sums for y = a + b x by time window (and keys), with a watermark for late rows."""
    own = events.withWatermark(ts, late) if events.isStreaming else events
    cx, cy = F.col(x).cast("double"), F.col(y).cast("double")
    return own.groupBy(F.window(ts, window), *(keys or [])).agg(F.count("*").alias("n"), F.sum(cx).alias("sx"), F.sum(cy).alias("sy"), F.sum(cx * cx).alias("sxx"), F.sum(cx * cy).alias("sxy"), F.sum(cy * cy).alias("syy"), F.min(cy).alias("lo"), F.max(cy).alias("hi"))


def with_line(sums: DataFrame) -> DataFrame:
    """Adds slope, intercept and R2 from windowed sums."""
    n, sx, sy, sxx, sxy, syy = (F.col(c) for c in ("n", "sx", "sy", "sxx", "sxy", "syy"))
    vx, vy, cxy = sxx - sx * sx / n, syy - sy * sy / n, sxy - sx * sy / n
    slope = F.try_divide(cxy, vx)
    return sums.withColumns({"slope": slope, "intercept": (sy - slope * sx) / n, "r2": F.try_divide(cxy * cxy, vx * vy)})


def merge(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of sums: windows or batches into larger ones."""
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy", "syy")], F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def start(events: DataFrame, ts: str, x: str, y: str, name: str, **options):
    """Runs the windowed fit into a memory table of that name."""
    return with_line(windowed_fit(events, ts, x, y, **options)).writeStream.outputMode("update").format("memory").queryName(name).start()

"""The ingest of :func:`loomwright.sources.io.ingest` on unbounded input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery


def stream_ingest(df: DataFrame, time_col: str, filters: Sequence[Column] = (), dedup_fields: Sequence[str] = (), delay: str = "1 day") -> DataFrame:
    """Filtered rows without repetitions inside the watermark; state is dropped after ``delay``, rows later than it are too."""
    for condition in filters:
        df = df.where(condition)
    return df.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(list(dedup_fields)) if dedup_fields else df


def write_parquet(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All that is there now, appended once and remembered in ``checkpoint``."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

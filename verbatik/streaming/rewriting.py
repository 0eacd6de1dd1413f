"""Rewriting of text streams: the stages are row-local, so a stream needs no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from verbatik.functions import rewrite


def normalize_stream(rows: DataFrame, text: str, path: str, checkpoint: str) -> StreamingQuery:
    """Write all that is available of a streaming frame, with `normalized`, to Parquet; a restart goes on where it stopped."""
    out = rewrite.normalize(rows, text, "normalized")
    return out.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)

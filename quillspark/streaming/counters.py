"""Counters over a stream of found terms, each batch applied once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quillspark.operators import changes


def count_hits(found: DataFrame, group: str, terms: str, path: str, checkpoint: str) -> StreamingQuery:
    """Start recording the hits of a stream under path, by batch; changes.counters() sums them up."""
    writer = found.writeStream.foreachBatch(lambda batch, number: changes.record(changes.hits(batch, group, terms), number, path))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

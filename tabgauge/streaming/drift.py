"""Distances of each micro-batch of a stream from a fixed baseline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabgauge.operators.tables import TwoColumnMap


def watch(stream: DataFrame, baseline: DataFrame, metric: TwoColumnMap, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Call ``sink(result, batch_id)`` with (column, value, batch_id) for each micro-batch that has rows."""

    def one(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            if not batch.isEmpty():
                sink(metric.compute(baseline, batch).withColumn("batch_id", F.lit(batch_id)), batch_id)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()

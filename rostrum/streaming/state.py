"""The last-write-wins merge as a stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rostrum.operators.state import last_write


def merge_stream(log: DataFrame, keys: Sequence[str], checkpoint: str, sink: Callable[[DataFrame, int], None], once: bool = True) -> StreamingQuery:
    """Keep the winning entry of each id over a streaming log, and hand the ids that changed to `sink` (batch, batch
    number) after every trigger. The state is one entry an id; a restart from the same checkpoint goes on where it
    stopped, and a batch that is handed over again has the same rows."""
    writer = last_write(log, keys).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(events: DataFrame, at: str, kind: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each kind by tumbling window; rows later than `late` are dropped, so the state stays bounded."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy(F.window("_at", width), kind).agg(F.count(F.lit(1)).alias("n"))

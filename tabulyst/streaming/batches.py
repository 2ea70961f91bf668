"""Apply a table operator to every micro-batch of a stream.

The reference has no streaming operators (no windows, watermarks or state), so
nothing stream-specific is claimed. This helper lets any ``tabulyst`` operator
run inside Structured Streaming: ``foreachBatch`` hands each micro-batch to the
operator as a static DataFrame and every result table is appended to
``<out_dir>/<table>/`` with a ``batch_id`` column. Output and checkpoint paths
must be on shared storage; the streaming checkpoint makes reruns exactly-once
per batch id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def foreach_batch_tables(stream: DataFrame, operator: Callable[..., dict], out_dir: str, checkpoint: str,
                         tables: list[str] | None = None, trigger: dict | None = None, **kwargs) -> StreamingQuery:
    """Start a streaming query running ``operator(batch, **kwargs)`` per micro-batch."""

    def run(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        result = operator(batch, **kwargs)
        for name, table in result.items():
            if tables and name not in tables:
                continue
            (table.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{out_dir.rstrip('/')}/{name}"))

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = writer.trigger(**(trigger or {"availableNow": True}))
    return writer.start()

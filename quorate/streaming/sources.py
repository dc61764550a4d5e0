"""Event streams: reading, splitting off unknown types, callbacks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quorate import schemas
from quorate.operators.events import known_events


def stream_events(spark: SparkSession, path: str, fmt: str = "json",
                  files_per_trigger: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Streams of the events of declared types, and of the rejected rest."""
    reader = spark.readStream.schema(schemas.EVENTS).format(fmt)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return known_events(reader.load(path))


def on_batch(stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str,
             output_mode: str = "append", once: bool = True) -> StreamingQuery:
    """Call ``fn(rows, batch_id)`` for every micro-batch.

    A batch may be replayed after a failure with the same id: ``fn`` should
    write under that id. ``once`` drains what is there and stops.
    """
    writer = (
        stream.writeStream.foreachBatch(fn)
        .outputMode(output_mode)
        .option("checkpointLocation", checkpoint)
    )
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()

"""Encoding of a stream, micro-batch by micro-batch (an extension: the block format itself knows files only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..plans.encode import encode


def encode_stream(stream: DataFrame, path: str, checkpoint: str, *order: str, config: Config = Config(), available_now: bool = True) -> StreamingQuery:
    """Append the encoded blocks of each micro-batch to ``path``/batch=<id>.

    A batch that is run again overwrites its own folder, so blocks are written exactly once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        encode(batch, *order, config=config).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_stats(stream: DataFrame, time: str, value: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts, nulls and range of a column per window of event time; rows later than ``late`` are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(value).isNull()).alias("nulls"), F.min(value).alias("vmin"), F.max(value).alias("vmax"))

"""The same stages over files that arrive: a file-source stream, stateless stages on it, and batches for those with windows."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagewright.operators import layout
from pagewright.session import shared_folder


def documents(spark: SparkSession, folder: str, schema: str = "doc_id bigint, text string, lang string, source string, n_chars bigint") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def lines_to(stream: DataFrame, path: str, checkpoint: str | None = None) -> StreamingQuery:
    """Each micro-batch's documents as reading-order lines, appended to a table; one folder a batch, so that a batch that is run again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        layout.line_texts(layout.quick_lines(layout.words(batch))).write.mode("overwrite").parquet(f"{path}/batch={number}")

    # Each output has a checkpoint of its own, found again by its path.
    checkpoint = checkpoint or f"{shared_folder(stream.sparkSession)}/lines-stream-{hashlib.md5(path.encode()).hexdigest()}"
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, watermark: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n, total) of event-time windows; late rows are dropped behind the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    counted = timed.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")

"""Incremental forms of the batch operators: manifest ingestion and metric-log tailing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quern.functions import text as X
from quern.operators.quality import Thresholds, reject_reason


def ingest_manifest(
    spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, thresholds: Thresholds = Thresholds(), compose: bool = True
) -> StreamingQuery:
    """Judge new JSON-lines files as they arrive. Accepted and rejected rows go to ``target`` by ``accepted``.

    Each micro-batch replaces the folder of its own number, so one that is run again after a failure leaves no copies.
    """
    rows = spark.readStream.schema(schema).json(source)
    judged = rows.withColumn("text", X.normalize(F.col("text"), compose)).withColumn("reject_reason", reject_reason(thresholds))

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("accepted", F.col("reject_reason").isNull()).write.mode("overwrite").partitionBy("accepted").parquet(f"{target}/batch={number}")

    return judged.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_metrics(events: DataFrame, time: str, value: str, width: str = "1 hour", late: str = "2 hours", key: str = "event_type") -> DataFrame:
    """Count, sum and mean by event-time window and key; windows close once the watermark has passed them."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(value).alias("total"), F.avg(value).alias("mean")
    ).select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), key, "rows", "total", "mean")

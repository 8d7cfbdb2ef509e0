"""Layout of documents as their extraction files arrive.

An extension: the file source gives each new JSON document once, and each micro-batch writes its
documents' partitions anew, so a batch that runs again leaves the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import layout as L
from ..sources import json_io as J


def layout_stream(spark: SparkSession, source: str, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    docs = spark.readStream.schema(spark.read.schema(J.EXTRACTION).json(spark.sparkContext.emptyRDD()).schema).option("multiLine", True).json(source)

    def write(batch: DataFrame, _: int) -> None:
        regions = L.detect(J.text_blocks(batch), J.figure_blocks(batch)).withColumn("doc", F.col("doc_id"))
        regions.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc").parquet(target)

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def recent_counts(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Events of each type in windows of event time, later rows than ``late`` left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))

"""Streams: windows over events, and an index that follows arriving blobs.

An extension; both run the batch operators' own plans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casframe.operators import search


def windowed(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and users by window and type; users are exact in batches and approximate in streams."""
    users = F.approx_count_distinct("user_id") if events.isStreaming else F.count_distinct("user_id")
    kind = dict(events.dtypes)["ts"]
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), users.alias("users")).select(F.col("w.start").cast(kind).alias("start"), "event_type", "n", "users")


def follow_blobs(blobs: DataFrame, index_path: str, checkpoint: str):
    """Append the vectors of arriving (blob_id, data) to an index, each blob once."""

    def add(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(["blob_id"])
        try:
            known = spark.read.parquet(index_path).where(F.col("epoch") != epoch).select("blob_id")
            rows = rows.join(known, "blob_id", "left_anti")
        except Exception as e:  # the first batch finds no index
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        # An epoch's own folder is replaced where the batch is run again, so that it counts once.
        made = search.vectors(search.chunks(search.extracted(rows)))
        made.write.mode("overwrite").parquet(f"{index_path}/epoch={epoch}")

    return blobs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)

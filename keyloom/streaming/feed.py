"""Datasets that a stream keeps up to date.

Every micro-batch is written under its own number, so a batch that is run again
replaces itself; the dataset is the latest row of each key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.relation import col, quoted
from ..sources.schema import Dataset, Schema

BATCH = "batch"


def start(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write a stream's micro-batches under path; once: work off what is there and stop."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest(spark: SparkSession, path: str, keys: list[str], order: str) -> DataFrame:
    """The row of the largest `order` for each key; of equals, the one of the later batch."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, BATCH)]
    newest = F.max_by(F.struct(*map(quoted, rest)), F.struct(quoted(order), BATCH)).alias("row")
    return rows.groupBy(*map(quoted, keys)).agg(newest).select(*map(quoted, keys), *[F.col(f"row.{quoted(c)}").alias(c) for c in rest])


def register(schema: Schema, path: str, keys: list[str], order: str) -> Dataset:
    """Register what the stream has brought so far: its keys are unique by construction."""
    df = latest(schema.spark, path, keys, order)
    return schema.register(df.select(*map(col, df.columns)), keys, check=False)

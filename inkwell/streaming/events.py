"""Event streams: idempotent intake, windows with late rows, joins with tables, attempts until success."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.plans.runtime import checkpoint_dir
from inkwell.sources.readers import write_batch


def read_events(spark: SparkSession, sf_dir: str, name: str = "events", files_per_batch: int = 64) -> DataFrame:
    """A stream over the Parquet files of a table; times without zone are taken as UTC, which watermarks need."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    stream = reader.parquet(path) if not path.startswith("file:") and os.path.isdir(path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return stream.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"})


def once(stream: DataFrame, key: str, time: str | None = None, delay: str = "7 days") -> DataFrame:
    """The first event of each key. Without ``time`` every key is remembered for ever; with it only for ``delay``, which bounds
    the state and lets a repetition after that through."""
    if time is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, time: str, keys: list[str], length: str, delay: str, *aggregates: Column) -> DataFrame:
    """Aggregates per window and key; a window is given out once no row of it can still come."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, length), *keys).agg(*aggregates)


def run(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that is there now, through a sink in the shared folder, as a table."""
    spark = stream.sparkSession
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write_batch(f"{base}/out")).start()
    else:
        # the last batch of a complete result holds all of it
        query = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def delivered(attempts: Column, most: int) -> Column:
    """Fold of attempt results (booleans in order): how many were made, and whether the event was delivered or given up after ``most`` failures."""
    start = F.struct(F.lit(0).alias("made"), F.lit("pending").alias("state"))

    def step(acc: Column, ok: Column) -> Column:
        made = acc["made"] + F.when(acc["state"] == "pending", 1).otherwise(0)
        state = F.when(acc["state"] != "pending", acc["state"]).when(ok, "delivered").when(made >= most, "dead").otherwise("pending")
        return F.struct(made.alias("made"), state.alias("state"))

    return F.aggregate(attempts, start, step)

"""Run events as streams: the last state of each run, counts per window, first inserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.session import scratch_path


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A folder or file of event rows as a stream; event time as an instant, as watermarks need."""
    at_rest = spark.read.parquet(path)
    reader = spark.readStream.schema(at_rest.schema).option("maxFilesPerTrigger", files_per_batch)
    folder, name = path.rstrip("/").rsplit("/", 1)
    alone = any(f.endswith(f"/{name}") for f in at_rest.inputFiles())  # one file, not a folder: read its folder, filtered
    stream = reader.option("pathGlobFilter", name).parquet(folder) if alone else reader.parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def terminal_states(events: DataFrame) -> DataFrame:
    """Per run (user), its latest event and how many it had; the same on a stream and on a table."""
    order = F.struct("ts", "event_id")
    return events.groupBy("user_id").agg(F.max_by("event_type", order).alias("last_type"), F.max(order)["event_id"].alias("last_event"), F.count(F.lit(1)).alias("n_events"))


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events per window and type. In append and update mode rows later than the watermark are dropped and closed windows leave
    the state; a complete result keeps all windows and drops nothing."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def first_seen(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first row of each event id on a stream: repeated inserts are ignored."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def replay(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there and read its result: every batch's rows go to the shared folder, the last batch of
    a complete result replaces those before."""
    spark = stream.sparkSession
    at = scratch_path(spark, "stream")

    def put(batch: DataFrame, n: int) -> None:
        # A batch that is tried again writes the same folder again.
        batch.write.mode("overwrite").parquet(f"{at}/out" if mode == "complete" else f"{at}/out/batch={n}")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.parquet(f"{at}/out")
    return found if mode == "complete" else found.drop("batch")

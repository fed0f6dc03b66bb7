"""Drawing sets arriving in a folder, taken off as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspan.operators.nested import flat_table, flatten
from quillspan.operators.takeoff import countable

_MEMBERS = ["id", "entity_type", "label", "confidence", "ifc_class", "attributes"]


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """(set_key, payload) of each new JSON file; the key is a hash of its name."""
    files = spark.readStream.format("text").option("wholetext", True).load(folder)
    return files.select(F.xxhash64(F.col("_metadata.file_path")).alias("set_key"), F.col("value").alias("payload"))


def batch_lines(batch: DataFrame) -> DataFrame:
    """Takeoff lines of a batch: counted labels of each set with mean confidence and how many need review."""
    rows = flat_table(flatten(batch, kinds=("entity",)), "entity", _MEMBERS)
    counted = countable(rows.withColumn("confidence", F.col("confidence").try_cast("double")))
    return counted.groupBy("set_key", "label").agg(F.count("*").alias("n"), F.avg("confidence").alias("avg_confidence"), F.count_if(F.col("confidence") < 0.5).alias("needs_review"))


def start(spark: SparkSession, folder: str, out: str, state: str, *, once: bool = True) -> StreamingQuery:
    """Append each batch's lines under its number: a batch that runs again writes over itself, so none counts twice."""

    def write(batch: DataFrame, number: int) -> None:
        batch_lines(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = arriving(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", state)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def event_windows(events: DataFrame, *, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) per window, on a stream or a table; later rows are dropped on
    a stream only."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")

"""Ingest as Structured Streaming: exactly-once claims against a ledger, and windows over events.

Within a query, Spark's state drops repeated keys; across queries and forever, each batch is joined
against all of the stored ledger but what it wrote itself, and kept under the ids of its query and
batch: a batch that runs again changes nothing, and another query's batches of the same numbers are
other folders.  One query writes to a ledger at a time, as one writer holds a mailbox.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

KEY = ["mailbox_id", "dedup_key"]


def event_stream(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def first_claims(stream: DataFrame) -> DataFrame:
    """Each (mailbox_id, dedup_key) once, for as long as the query lives."""
    return stream.dropDuplicates(KEY)


def first_claims_within(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """As first_claims with bounded state: keys are forgotten when they are older than the delay."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(KEY)


def append_claims(ledger_path: str, query: str):
    """A foreachBatch function that adds the batch's new keys to the ledger, once for each query (a name that
    lasts, such as that of its checkpoint) and batch id.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(KEY)
        if _exists(spark, ledger_path):
            known = read_ledger(spark, ledger_path, batch.schema).where((F.col("query") != query) | (F.col("batch") != batch_id))
            new = new.join(known.select(*KEY).distinct(), KEY, "left_anti")
        new.write.mode("overwrite").parquet(f"{ledger_path}/query={query}/batch={batch_id}")

    return write


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def run_available(stream: DataFrame, ledger_path: str, checkpoint: str) -> None:
    """Claim all that is there now; the checkpoint names the query."""
    query = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]
    q = stream.writeStream.foreachBatch(append_claims(ledger_path, query)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def read_ledger(spark: SparkSession, ledger_path: str, schema: StructType | None = None) -> DataFrame:
    """The claims of all queries, with the query and batch that made them."""
    reader = spark.read if schema is None else spark.read.schema(StructType([*schema.fields, StructField("query", StringType()), StructField("batch", LongType())]))
    return reader.option("basePath", ledger_path).parquet(ledger_path)


def event_windows(stream: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = "2 hours") -> DataFrame:
    """Counts and sums by event type over windows of event time."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", size, slide or size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def event_sessions(stream: DataFrame, gap: str = "30 minutes", delay: str = "2 hours") -> DataFrame:
    """Sessions of a user's events that lie at most gap apart."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))

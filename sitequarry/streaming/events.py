"""Streams: issue counts, first sightings, windows and sessions.

Each takes a streaming DataFrame, and a batch one as well, which has the same result once a stream has ended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitequarry.operators.store import first_per_key


def read(spark: SparkSession, folder: str, table: str, schema) -> DataFrame:
    """A table as a stream of its files; NTZ times become times, which watermarks need."""
    df = spark.readStream.schema(schema).parquet(f"{folder}/{table}.parquet*")
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in df.columns else df


def running_counts(stream: DataFrame, key: str) -> DataFrame:
    return stream.groupBy(key).count()


def first_seen(stream: DataFrame, key: str, time: str = "ts", within: str = "1 day") -> DataFrame:
    """One row for each key and watermark: the state of a key is dropped once it is older than that."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def windows(stream: DataFrame, key: str, time: str = "ts", length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(key, start, n, total) by tumbling window."""
    g = stream.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(key, F.col("w.start").alias("start"), "n", "total")


def sessions(stream: DataFrame, key: str, time: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    g = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def drained(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """The result of a stream over what is there now, as Parquet in a folder that driver and executors share.

    Each batch has its own sub-folder, which a repeated batch replaces: all of them are the result in append mode, the last in complete mode.
    """
    spark = stream.sparkSession
    schema, written = stream.schema, f"{folder}/rows"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{written}/{'last' if mode == 'complete' else f'batch-{number}'}")

    stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{written}/none")
    return spark.read.schema(schema).parquet(f"{written}/*")


def cached(rows: DataFrame, key: str, at: str, order: str, success: Column, now: Column, seconds: int) -> DataFrame:
    """The latest success of each key that is not older than so many seconds."""
    age = F.unix_millis(now.cast("timestamp")) - F.unix_millis(F.col(at).cast("timestamp"))
    alive = rows.where(success & (age < seconds * 1000))
    return first_per_key(alive, [key], [F.desc(at), F.desc(order)])


def retained(jobs: DataFrame, key: str, at: str, done: Column, now: Column, most: int, seconds: int) -> DataFrame:
    """jobs that are still known, with remembered (of the last `most`) and listed (not done, or done at most so many seconds ago)."""
    last = jobs.orderBy(F.desc(at), F.desc(key)).limit(most).select(key, F.lit(True).alias("remembered"))
    age = F.unix_millis(now.cast("timestamp")) - F.unix_millis(F.col(at).cast("timestamp"))
    out = jobs.join(F.broadcast(last), key, "left").withColumns({"remembered": F.coalesce("remembered", F.lit(False)), "listed": ~done | (age < seconds * 1000)})
    return out.where("remembered or listed")

"""Facts kept by content: only files whose text is new are analysed again, in batch or as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyed(files: DataFrame, rules_version: str) -> DataFrame:
    """Adds the store's key: path, text and the version of the rules that read it."""
    return files.withColumn("content_key", F.sha2(F.concat_ws("\x00", "path", F.coalesce("text", F.lit("")), F.lit(rules_version)), 256))


def unseen(files: DataFrame, store: DataFrame, rules_version: str) -> DataFrame:
    """Files that aren't in the store as they are. store: content_key."""
    return keyed(files, rules_version).join(store.select("content_key").distinct(), "content_key", "left_anti")


def commit_feed(commits: DataFrame, late: str = "1 day", window: str = "7 days") -> DataFrame:
    """Changes and churn per path and window of a stream (or table) of commit files with a time `ts`."""
    return (
        commits.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "path")
        .agg(F.count("*").alias("changes"), F.sum(F.col("added") + F.col("deleted")).alias("churn"))
        .select(F.col("w.start").alias("start"), "path", "changes", "churn")
    )


def run_incremental(stream: DataFrame, store_path: str, checkpoint: str, rules_version: str, analyse: Callable[[DataFrame], None]):
    """Analyses what a stream of files brings anew, then adds its keys to the store. A batch that is tried again finds its own keys or none."""

    def each(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            store = spark.read.parquet(store_path)
        except Exception:  # the store's first batch
            store = spark.createDataFrame([], "content_key string")
        new = unseen(batch, store, rules_version).dropDuplicates(["content_key"]).persist()
        try:
            analyse(new)
            new.select("content_key").write.mode("append").parquet(store_path)
        finally:
            new.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

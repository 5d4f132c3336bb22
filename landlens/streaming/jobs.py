"""Structured Streaming versions of the incremental jobs. Each equals its batch form over all rows seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo as G
from ..operators import monitor as M
from .portal import portal_batch, portal_state, portal_upsert  # noqa: F401  (jobs of this package)


def _archive(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def news_batch(path: str):
    """foreachBatch function: items whose title key the archive lacks are added to it, first of each key.

    A batch is compared with the folders of other batches only, never with its own, and writes its own folder whole: run
    again after a failure at any point, it writes the same rows. Archive and stream checkpoint belong together."""

    def run(batch: DataFrame, batch_id: int) -> None:
        first = M.news_dedup(batch)
        held = _archive(batch.sparkSession, path)
        new = first if held is None else M.fresh(first, held.where(F.col("batch") != batch_id).drop("batch"))
        new.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return run


def inc_news(items: DataFrame, path: str, checkpoint: str):
    """Daily items archived for ever; unseen keys only."""
    return items.writeStream.foreachBatch(news_batch(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def portal_rescan(records: DataFrame, horizon: str = "45 days") -> DataFrame:
    """Records within the re-read horizon, one row an id as long as its date is within it."""
    return records.withWatermark("produced", horizon).dropDuplicatesWithinWatermark(["id"])


def latest_by_key(feed: DataFrame) -> DataFrame:
    """Last update of each key, for a complete-mode sink."""
    return feed.groupBy("key").agg(F.max("updated").alias("updated"))


def stale(latest: DataFrame, hours: dict[str, int], now) -> DataFrame:
    """Sources that are late at ``now``; sources never seen count as stale."""
    spark = latest.sparkSession
    limits = spark.createDataFrame(list(hours.items()), "key string, stale_hours int")
    j = limits.join(latest, "key", "left")
    late = F.col("updated").isNull() | (F.unix_seconds(now) - F.unix_seconds("updated") > 3600 * F.col("stale_hours"))
    return j.select("key", "updated", late.alias("stale"))


def collection_gate(batch: DataFrame) -> DataFrame:
    """One row ``collected, failed, fresh, verdict``: nothing collected fails, nothing new is not published."""
    got = batch.agg(F.count_if(F.col("ok")).alias("collected"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(F.col("ok") & F.col("is_new")).alias("fresh"))
    return got.withColumn("verdict", F.when(F.col("collected") == 0, "fail").when(F.col("fresh") == 0, "skip").otherwise("publish"))

"""Portal records re-scanned within a horizon: an upsert by id into a stored state.

A record keeps the fields of its first reading and gathers the keywords of all. A re-scan reads the days of its horizon only,
so records of months before it are settled: a new base moves them to the state's closed folders, and later bases rewrite the
open months alone. A settled record that is read again all the same is merged when the state is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import state

OWN = ("r", "at", "kwds", "last")


def fold(records: DataFrame, batch_id: int) -> DataFrame:
    """Records ``(id, seq, kwds, fields...)`` of a batch, one an id. Null ids and records without keywords are kept as they are."""
    fields = [c for c in records.columns if c not in ("id", "seq", "kwds")]
    rows = records.select("id", F.struct(*fields).alias("r"), F.struct(F.lit(batch_id).cast("long").alias("batch"), F.col("seq").cast("long").alias("seq")).alias("at"), F.coalesce("kwds", F.array().cast("array<string>")).alias("kwds"), F.lit(batch_id).cast("long").alias("last"))
    return merge_folds(rows)


def merge_folds(folds: DataFrame) -> DataFrame:
    words = F.array_sort(F.array_distinct(F.flatten(F.collect_set("kwds"))))
    return folds.groupBy("id").agg(F.min_by("r", "at").alias("r"), F.min("at").alias("at"), words.alias("kwds"), F.max("last").alias("last"))


def before_horizon(produced: str, days: int):
    """Condition of records whose month ends before the horizon, which reaches ``days`` back from the newest record."""

    def settled(folds: DataFrame) -> Column:
        day = F.col(f"r.{produced}").cast("date")
        newest = folds.agg(F.max(day).alias("d")).first()["d"]
        return day < F.trunc(F.date_sub(F.lit(newest).cast("date"), days), "month")

    return settled


def portal_batch(path: str, produced: str = "produced", days: int = 45, every: int = state.EVERY):
    """foreachBatch function of the upsert. Without a column ``produced`` nothing is ever settled."""

    def run(batch: DataFrame, batch_id: int) -> None:
        folds = fold(batch, batch_id)
        settled = before_horizon(produced, days) if produced in batch.columns else None
        state.put(folds, batch_id, path, folds.schema, merge_folds, every, settled)

    return run


def portal_upsert(records: DataFrame, path: str, checkpoint: str, produced: str = "produced", days: int = 45, every: int = state.EVERY):
    return records.writeStream.foreachBatch(portal_batch(path, produced, days, every)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def portal_state(spark: SparkSession, path: str) -> DataFrame:
    """One row an id over all batches: ``id``, the fields as first read, ``kwds`` of all readings, ``added`` if the last batch
    that read anything was the first to bring it."""
    schema = StructType([f for f in spark.read.parquet(f"{path}/delta").schema.fields if f.name == "id" or f.name in OWN])
    whole = merge_folds(state.parts(spark, path, schema))
    last = whole.agg(F.max("last").alias("_last"))
    fields = [F.col(f"r.{c}") for c in schema["r"].dataType.names]
    return whole.crossJoin(F.broadcast(last)).select("id", *fields, "kwds", (F.col("at.batch") == F.col("_last")).alias("added"))  # one row

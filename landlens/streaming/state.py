"""A stored state of folds: rows that merge by key in any order, kept in a bounded number of folders.

``delta/slot=k`` has the fold of one batch, ``base/slot=k`` that of all batches up to one. Every ``every``-th batch writes a base
from the base before it and the deltas since. Slots are used in turn, two for bases and two rounds of deltas, and each is
written whole, so nothing is removed that a repeat of the last batch still reads. Rows that a state calls settled leave the
base for ``closed/slot=<batch>``, are not written again, and take part in reads only.

A batch run again, after a failure at any point, leaves the same state. A state has one writer, and belongs to its stream's
checkpoint."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Batches from one base to the next.
EVERY = 16


Schema = str | StructType


def _read(spark: SparkSession, folder: str, schema: Schema) -> DataFrame:
    """Folds of all slots of a folder with the batch ``upto`` which they go; a folder not yet written is an empty table."""
    own = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kept = StructType([*own.fields, StructField("upto", LongType()), StructField("slot", LongType())])
    try:
        return spark.read.schema(kept).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], kept)


def _write(folds: DataFrame, folder: str, batch_id: int) -> None:
    folds.withColumn("upto", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(folder)


def parts(spark: SparkSession, path: str, schema: Schema, before: int | None = None, closed: bool = True) -> DataFrame:
    """Folds of the newest base, of the deltas after it and of closed rows; of batches before ``before`` if that is given.

    The newest base's batch and slot are all that reaches the driver; the slot prunes the folders that are read."""
    old = F.lit(True) if before is None else F.col("upto") < before
    bases, deltas = (_read(spark, f"{path}/{kind}", schema).where(old) for kind in ("base", "delta"))
    newest = bases.agg(F.max(F.struct("upto", "slot")).alias("b")).first()["b"]
    if newest is None:
        return deltas.drop("upto", "slot")
    found = [bases.where(F.col("slot") == newest["slot"]), deltas.where(F.col("upto") > newest["upto"])]
    if closed:
        found.append(_read(spark, f"{path}/closed", schema).where(F.col("slot") <= newest["upto"]))
    return reduce(DataFrame.unionByName, found).drop("upto", "slot")


def put(folds: DataFrame, batch_id: int, path: str, schema: Schema, merge: Callable[[DataFrame], DataFrame], every: int = EVERY, settled: Callable[[DataFrame], Column] | None = None) -> None:
    """The fold of a batch goes into the state; ``merge`` makes folds one a key. An empty batch still takes its turn.

    ``settled`` gives the condition of the rows that leave a new base for good."""
    spark, delta = folds.sparkSession, f"{path}/delta/slot={batch_id % (2 * every)}"
    _write(folds, delta, batch_id)
    if batch_id % every != every - 1:
        return
    own = spark.read.schema(schema).parquet(delta)
    whole = merge(parts(spark, path, schema, before=batch_id, closed=False).unionByName(own))
    if settled is not None:
        done = F.coalesce(settled(whole), F.lit(False))
        _write(whole.where(done), f"{path}/closed/slot={batch_id}", batch_id)
        whole = whole.where(~done)
    _write(whole, f"{path}/base/slot={batch_id // every % 2}", batch_id)

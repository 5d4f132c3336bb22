"""Materialised tables, and numbering of all rows of a table in one order."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Makes Spark remove a plan's shuffle files when the plan has run.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The session's own folder below spark.checkpoint.dir, where driver and executors see the same files.

    A session without the setting gets a temporary folder if it runs on one machine; on a cluster that is an error, as
    executors do not see each other's disks."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="landlens-ckpt-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the folder that the session names in spark.checkpoint.dir, with its lineage cut and the shuffle
    files behind it removed, which nothing reads any more."""
    shared_folder(df.sparkSession)
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        held = df.select("*")  # a plan made while the setting holds
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return held.checkpoint(eager=True)


def measured(df: DataFrame, rows_a_task: int | None = None) -> DataFrame:
    """``checkpoint``, of whose size Spark knows; for tables that are made anew round by round.

    A checkpoint keeps the size that was estimated for the plan behind it, and a join's estimate is the product of its
    sides'. The digits of that number multiply in each round, until the driver takes seconds and hundreds of MB for the
    product alone. A cached table has the size it was found with, so the table is held on disk until it is written.

    With ``rows_a_task`` it is stored in as many partitions as its rows need and no more: a cached table keeps all those
    of its last shuffle, and each of them, however few rows it has, writes a file for every partition of the next."""
    held = df.persist(StorageLevel.DISK_ONLY)
    try:
        n = held.count()
        return checkpoint(held if rows_a_task is None else held.coalesce(1 + n // rows_a_task))
    finally:
        held.unpersist()


#: Bits of monotonically_increasing_id() that count the rows of a partition.
ROW_BITS = 33


def number_rows(rows: DataFrame, order: list[Column | str], name: str = "place") -> DataFrame:
    """``rows`` with their place (long, from 1) in ``order``, which must tell all rows apart to be repeatable.

    Rows are dealt to partitions by ranges of the order and sorted there, so places within a partition need no other
    partition; only the number of rows of each partition reaches the driver, from which each partition's first place
    follows. An empty table gives an empty one. The numbered table is materialised: a range's bounds come from a sample,
    and a repeated task must not see others."""
    local = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())
    held = checkpoint(local)
    part = F.shiftrightunsigned(F.col(name), ROW_BITS)
    sizes = sorted((r["part"], r["n"]) for r in held.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts, before = [], 1
    for p, n in sizes:
        starts += [F.lit(p), F.lit(before)]
        before += n
    if not starts:
        return held
    first = F.create_map(*starts)[part]
    return held.withColumn(name, (first + F.col(name).bitwiseAND(F.lit((1 << ROW_BITS) - 1))).cast("long"))

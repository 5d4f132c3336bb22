"""Captured posts folded into a stored state that can be merged, instead of a merge of all captures at each read.

A fold has one row for each base key and exact day ('' for rows without one): the first and last of each field as
``struct(seq, value)``, so that folds of parts, in any order, give the fold of the whole by ``min`` and ``max``. The date that
anchors a key (that of its first exact row) is known only when all folds are together, so days are joined to keys when the
state is read, over folded rows. How folds are stored: ``state``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import post_key, post_text
from . import state

LAST = ("platform", "account", "author", "role")
_FIELD = "struct<seq:bigint,v:string>"
SCHEMA = ", ".join(["base_key string, day string", *[f"{c} {_FIELD}" for c in LAST], "text struct<n:int,s:bigint,v:string>", f"url {_FIELD}", f"anchor {_FIELD}", f"dated {_FIELD}", "first_seen bigint, last_seen bigint, n bigint"])


def _folds(cols: dict[str, Column]) -> list[Column]:
    """Aggregates that fold rows or folds: ``cols`` give each part's value."""
    how = {**{c: F.max for c in (*LAST, "text", "last_seen")}, **{c: F.min for c in ("url", "anchor", "dated", "first_seen")}, "n": F.sum}
    return [how[c](v).alias(c) for c, v in cols.items()]


def fold(posts: DataFrame) -> DataFrame:
    """Folds of captures ``(seq, platform, account, author, role, text, url, date, exact)``; null fields count as empty."""
    seq, date = F.col("seq").cast("long"), F.coalesce("date", F.lit(""))
    exact = F.coalesce("exact", F.lit(False)) & (date != "")
    held = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct(seq.alias("seq"), F.col(c).alias("v")))
    text = post_text(F.col("text"))
    day = F.struct(seq.alias("seq"), date.alias("v"))
    cols = {c: held(c) for c in LAST}
    cols |= {"text": F.struct(F.length(text).alias("n"), (-seq).alias("s"), text.alias("v")), "url": held("url"), "anchor": F.when(exact, day), "dated": F.when(date != "", day)}
    cols |= {"first_seen": seq, "last_seen": seq, "n": F.lit(1).cast("long")}
    key = post_key(*[F.col(c) for c in ("platform", "url", "account", "author", "text")])
    return posts.groupBy(key.alias("base_key"), F.when(exact, date).otherwise("").alias("day")).agg(*_folds(cols))


def merge_folds(folds: DataFrame, keys: list[str]) -> DataFrame:
    """Folds of ``keys`` as one each."""
    return folds.groupBy(*keys).agg(*_folds({c: F.col(c) for c in (*LAST, "text", "url", "anchor", "dated", "first_seen", "last_seen", "n")}))


def resolve(folds: DataFrame) -> DataFrame:
    """One row a post from the folds of all captures: rows of the key's anchor day, and rows without an exact day, are the
    key's own; another exact day is a post of its own, ``key@day``. Fields as ``monitor.merge_posts`` gives them, with the first
    and last capture. The anchor comes from an aggregation over folds, of which a key has at most one a day."""
    anchors = folds.groupBy("base_key").agg(F.min("anchor")["v"].alias("first_day"))
    j = folds.join(anchors, "base_key")
    other = (F.col("day") != "") & (F.col("day") != F.col("first_day"))
    whole = merge_folds(j.withColumn("key", F.when(other, F.concat_ws("@", "base_key", "day")).otherwise(F.col("base_key"))), ["key"])
    value = lambda c: F.coalesce(F.col(c)["v"], F.lit("")).alias(c)
    date = F.coalesce(F.col("anchor.v"), F.col("dated.v"), F.lit("")).alias("date")
    return whole.select("key", *[value(c) for c in LAST], F.col("text.v").alias("text"), value("url"), date, F.col("anchor").isNotNull().alias("exact"), F.col("first_seen").alias("seq"), "n", "first_seen", "last_seen")


def fold_batch(path: str, every: int = state.EVERY):
    """foreachBatch function that keeps the state of ``path``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        state.put(fold(batch), batch_id, path, SCHEMA, lambda folds: merge_folds(folds, ["base_key", "day"]), every)

    return run


def inc_posts(posts: DataFrame, path: str, checkpoint: str, every: int = state.EVERY):
    """Captured posts as a stream, folded into the state of ``path``."""
    return posts.writeStream.foreachBatch(fold_batch(path, every)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def posts_state(spark: SparkSession, path: str) -> DataFrame:
    """The posts stored so far, from the newest base and the deltas after it, never from captures."""
    return resolve(state.parts(spark, path, SCHEMA))

"""Fixes of devices followed on a site's map: first fix, held heading, end at the first fix out of range, place on the map.

``follow`` is the batch form over a table, ``follow_stream`` the same with keyed state. A device's fixes come in the order of
``(ts, event_id)``; what is not later than its last fix is a repeat and is left out by the stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import geo as G
from ..operators import cover

FOLLOWED = "event_id long, device long, ts timestamp, x double, y double, direction double, first boolean"
_STATE = "ended boolean, ts timestamp, event_id long, compass double, moved double"


def positions(fixes: DataFrame, site_lat: float, site_lng: float, range_km: float, walking: float = 0.7) -> DataFrame:
    """``fixes(event_id, device, ts, lat, lng, speed, heading, compass)`` with local metres ``x, y``, ``in_range``, and
    ``moved``: the heading of movement, known above a walking speed. A fix without a position is out of range."""
    away = G.haversine_km(F.col("lat"), F.col("lng"), F.lit(site_lat), F.lit(site_lng))
    east, north = G.local_metres(F.col("lat"), F.col("lng"), F.lit(site_lat), F.lit(site_lng))
    near = F.coalesce(away <= range_km, F.lit(False))
    return fixes.select("event_id", "device", "ts", east.alias("x"), north.alias("y"), near.alias("in_range"), "compass", F.when(F.col("speed") > walking, F.col("heading")).alias("moved"))


def follow(at: DataFrame) -> DataFrame:
    """``positions`` before the device's first one out of range, with ``direction`` and ``first``.

    The direction is the last compass reading, for a device that has given none the last heading of movement; it holds until
    the next. Windows are those of a device and day; what earlier days leave comes from one row a device and day."""
    order = F.struct("ts", "event_id")
    left = at.where("not in_range").groupBy("device").agg(F.min(order).alias("left_at"))
    kept = at.join(left, "device", "left").where(F.col("left_at").isNull() | (order < F.col("left_at"))).withColumn("day", F.to_date("ts"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order))
    days = kept.groupBy("device", "day").agg(last("compass").alias("c"), last("moved").alias("m"), F.min(order).alias("begin"))
    before = Window.partitionBy("device").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    held = lambda c: F.last(c, ignorenulls=True).over(before)
    begin = F.min("begin").over(Window.partitionBy("device"))
    carried = days.select("device", "day", held("c").alias("c"), held("m").alias("m"), begin.alias("begin"))
    so_far = Window.partitionBy("device", "day").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    now = lambda c, old: F.coalesce(F.last(c, ignorenulls=True).over(so_far), F.col(old))
    j = kept.join(carried, ["device", "day"])
    return j.select("event_id", "device", "ts", "x", "y", F.coalesce(now("compass", "c"), now("moved", "m")).alias("direction"), (order == F.col("begin")).alias("first"))


def _step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """New fixes of a device in order, and what it leaves for the next batch. A batch's fixes of one device are few."""
    ended, last_ts, last_id, compass, moved = state.get if state.exists else (False, None, None, None, None)
    rows = pd.concat(list(chunks)).sort_values(["ts", "event_id"]).drop_duplicates(["ts", "event_id"])
    if last_ts is not None:
        seen = pd.Timestamp(last_ts)
        rows = rows[(rows.ts > seen) | ((rows.ts == seen) & (rows.event_id > last_id))]
    if ended or rows.empty:
        return
    out = (~rows.in_range.astype(bool)).to_numpy()
    kept = rows[out.cumsum() == 0]
    by_compass = kept.compass.astype(float).ffill().fillna(float("nan") if compass is None else compass)
    by_move = kept.moved.astype(float).ffill().fillna(float("nan") if moved is None else moved)
    value = lambda s, old: old if s.empty or pd.isna(s.iloc[-1]) else float(s.iloc[-1])
    state.update((bool(out.any()), rows.ts.iloc[-1].to_pydatetime(), int(rows.event_id.iloc[-1]), value(by_compass, compass), value(by_move, moved)))
    first = [last_ts is None and i == 0 for i in range(len(kept))]
    yield pd.DataFrame({"event_id": kept.event_id, "device": key[0], "ts": kept.ts, "x": kept.x, "y": kept.y, "direction": by_compass.fillna(by_move), "first": first})


def follow_stream(at: DataFrame) -> DataFrame:
    """``follow`` over a stream of positions: each device's end, last fix and headings are state."""
    return at.groupBy("device").applyInPandasWithState(_step, FOLLOWED, _STATE, "append", GroupStateTimeout.NoTimeout)


def place(followed: DataFrame, zones: DataFrame, boundary: Column, size: float) -> DataFrame:
    """Followed fixes with the ``zone`` that holds them, the distance ``outside`` to the site's boundary (0 within it) and the
    name ``toward`` of the direction. ``zones`` as in ``cover.points_in_zones``; the boundary is one literal ring."""
    points = followed.withColumnRenamed("event_id", "id")
    named = cover.points_in_zones(points, zones, size)
    x, y = F.col("x"), F.col("y")
    outside = F.when(G.in_ring(x, y, boundary), 0.0).otherwise(G.distance_to_ring(x, y, boundary))
    return named.withColumns({"outside": outside, "toward": G.compass_name(F.col("direction"))}).withColumnRenamed("id", "event_id")


def track(fixes: DataFrame, site: tuple[float, float, float], zones: DataFrame, boundary: Column, size: float, path: str, checkpoint: str):
    """A stream of fixes followed and placed; each batch writes its own folder whole, so a batch run again leaves the same rows."""

    def run(batch: DataFrame, batch_id: int) -> None:
        place(batch, zones, boundary, size).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return follow_stream(positions(fixes, *site)).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

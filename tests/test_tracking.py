"""Followed fixes: the stream against the batch form and against a walk, over splits and repeats of batches."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from landlens.streaming import tracking as K

SCHEMA = "event_id long, device long, ts timestamp, lat double, lng double, speed double, heading double, compass double"
SITE = (37.25, 126.95, 1.0)


def made():
    rng, rows, n = random.Random(8), [], 0
    for device in range(12):
        t = datetime(2024, 1, 1, 20, tzinfo=timezone.utc)
        for _ in range(40):
            n += 1
            t += timedelta(minutes=rng.choice([0, 1, 60]))  # equal times, and several days
            gone = device % 3 and rng.random() < 0.04
            compass = rng.uniform(0, 359) if device % 2 and rng.random() < 0.3 else None
            rows.append((n, device, t, None if gone and n % 2 else 37.25 + (0.5 if gone else rng.uniform(-0.003, 0.003)), 126.95 + rng.uniform(-0.003, 0.003), rng.choice([None, 0.5, 0.9]), rng.choice([None, 10.0, 200.0]), compass))
    return rows


def walk(rows):
    out, state = {}, {}
    for e, device, t, lat, _, speed, heading, compass in sorted(rows, key=lambda r: (r[2], r[0])):
        s = state.setdefault(device, {"gone": False, "c": None, "m": None, "n": 0})
        s["gone"] = s["gone"] or lat is None or abs(lat - 37.25) > 0.1
        if s["gone"]:
            continue
        s["c"] = compass if compass is not None else s["c"]
        s["m"] = heading if speed and speed > 0.7 and heading is not None else s["m"]
        s["n"] += 1
        out[e] = (s["c"] if s["c"] is not None else s["m"], s["n"] == 1)
    return out


def test_batch_equals_a_walk_and_the_stream_equals_the_batch(spark, tmp_path):
    rows = made()
    got = {r.event_id: (r.direction, r.first) for r in K.follow(K.positions(spark.createDataFrame(rows, SCHEMA), *SITE)).collect()}
    assert got == walk(rows) and 100 < len(got) < len(rows)

    ordered = sorted(rows, key=lambda r: (r[2], r[0]))
    cuts = [0, 1, 150, 290, len(rows)]
    parts = [ordered[a:b] for a, b in zip(cuts, cuts[1:])]
    for i, part in enumerate([parts[0], parts[1], parts[1] + parts[2], parts[0], parts[3]]):  # captures delivered again
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/p{i}"))
    zones = spark.createDataFrame([("east", 1, [[(0.0, -500.0), (500.0, -500.0), (500.0, 500.0), (0.0, 500.0)]])], "zone string, ord int, rings array<array<struct<x:double,y:double>>>")
    ring = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ((0.0, -100.0), (100.0, -100.0), (100.0, 100.0), (0.0, 100.0))])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    K.track(stream, SITE, zones, ring, 50.0, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(200)
    there = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(there) == len(got) and {r.event_id: (r.direction, r.first) for r in there} == got
    for r in there:
        assert (r.zone == "east") == (0 <= r.x < 500 and -500 <= r.y < 500) and (r.toward is None) == (r.direction is None)
        dx, dy = max(-r.x, 0, r.x - 100), max(-r.y - 100, 0, r.y - 100)
        assert abs(r.outside - (dx * dx + dy * dy) ** 0.5) < 1e-6

"""The stored portal records against a plain upsert, with months that close, late records and repeated batches."""

import random
from datetime import date, timedelta

from landlens.streaming import portal as P

SCHEMA = "id string, seq long, kwds array<string>, title string, produced date"


def upsert(batches):
    held, last = {}, max(i for i, b in enumerate(batches) if b)
    for i, batch in enumerate(batches):
        for key, _, kwds, title, produced in sorted(batch, key=lambda r: r[1]):
            first = held.setdefault(key, (title, produced, set(), i))
            first[2].update(kwds or [])
    return sorted((k, t, p, sorted(w), i == last) for k, (t, p, w, i) in held.items())


def test_closed_months_late_records_and_repeats(spark, tmp_path):
    rng, path = random.Random(4), str(tmp_path / "s")
    begin, seq, batches = date(2024, 1, 1), 0, []
    for i in range(8):
        rows = []
        for _ in range(60 if i != 5 else 0):
            seq += 1
            back = rng.choice([0, 10, 30, 45, 300])  # 300: later than the horizon
            n = rng.randrange(120)
            rows.append((f"N{n}", seq, rng.choice([None, [], ["a"], ["b", "c"], ["c"]]), f"t{seq}", None if n % 17 == 0 else begin + timedelta(days=40 * i - back)))
        batches.append(rows)
    put = P.portal_batch(path, every=2)
    for i, rows in enumerate(batches):
        batch = spark.createDataFrame(rows, SCHEMA)
        for _ in range(2 if i in (3, 4) else 1):
            put(batch, i)
        if i in (3, 4, 7):
            got = sorted((r.id, r.title, r.produced, r.kwds, r.added) for r in P.portal_state(spark, path).collect())
            assert got == upsert(batches[: i + 1])
    base = spark.read.parquet(f"{path}/base/slot=1").select("r.produced").where("produced is not null").collect()
    newest = max(r.produced for r in base)
    assert min(r.produced for r in base) >= (newest - timedelta(days=45)).replace(day=1)
    assert spark.read.parquet(f"{path}/closed").count() > 0 and len(list((tmp_path / "s" / "delta").iterdir())) == 4

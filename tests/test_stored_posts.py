"""The stored posts against a merge of all captures, over splits, orders and repeats of batches."""

import random

import pytest

from landlens.operators import monitor as M
from landlens.streaming import posts as P
from landlens.streaming import state

SCHEMA = "seq long, platform string, account string, author string, role string, text string, url string, date string, exact boolean"
FIELDS = ("key", "platform", "account", "author", "role", "text", "url", "date", "exact", "seq", "n")


@pytest.fixture(scope="module")
def captures(spark):
    rng = random.Random(9)
    one = lambda *of: rng.choice(of)
    rows = [(i, one("rss", "facebook", "blog", ""), one("A", "B", "", None), one("x", "", None), one("mayor", "", None), one("", "short", "a longer text", "the longest text … 더 보기", "same len a", "same len b", None), one("http://a/1", "http://a/2", "", None), one("2024-01-01", "2024-01-02", "2024-01-03", "", None), one(True, False)) for i in range(400)]
    return rows


def merged(spark, rows):
    return sorted(tuple(r[c] for c in FIELDS) for r in M.merge_posts(M.resolve_keys(spark.createDataFrame(rows, SCHEMA))).collect())


def stored(spark, path):
    return sorted(tuple(r[c] for c in FIELDS) for r in P.posts_state(spark, path).collect())


def test_any_split_and_repeats_give_the_merge_of_all(spark, captures, tmp_path):
    rows, path = random.Random(1).sample(captures, len(captures)), str(tmp_path / "s")
    put, cuts = P.fold_batch(path, every=2), [0, 1, 120, 120, 260, 261, 400]
    for i in range(6):  # the third batch is empty; bases follow batches 1, 3 and 5
        batch = spark.createDataFrame(rows[cuts[i] : cuts[i + 1]], SCHEMA)
        put(batch, i)
        if i in (3, 4):  # stopped before the commit, so run again: with a base and without
            put(batch, i)
        if i in (2, 4):
            assert stored(spark, path) == merged(spark, rows[: cuts[i + 1]])
    assert stored(spark, path) == merged(spark, rows)
    assert sorted(p.name for p in (tmp_path / "s" / "base").iterdir()) == ["slot=0", "slot=1"] and len(list((tmp_path / "s" / "delta").iterdir())) == 4


def test_a_base_that_was_not_finished_is_not_read(spark, captures, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    put, write = P.fold_batch(path, every=2), state._write
    parts = [spark.createDataFrame(captures[i * 100 : i * 100 + 100], SCHEMA) for i in range(4)]
    for i in range(3):
        put(parts[i], i)

    def lost(folds, folder, batch_id):
        if "/base/" in folder:
            raise RuntimeError("lost")
        write(folds, folder, batch_id)

    monkeypatch.setattr(state, "_write", lost)
    with pytest.raises(RuntimeError):
        put(parts[3], 3)
    monkeypatch.setattr(state, "_write", write)
    put(parts[3], 3)
    assert stored(spark, path) == merged(spark, captures)


def test_stream(spark, captures, tmp_path):
    for i in range(3):
        spark.createDataFrame(captures[i * 50 : i * 50 + 50], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/p{i}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    P.inc_posts(stream, str(tmp_path / "s"), str(tmp_path / "ck"), every=2).awaitTermination(120)
    assert stored(spark, str(tmp_path / "s")) == merged(spark, captures[:150])
    assert P.posts_state(spark, str(tmp_path / "none")).count() == 0

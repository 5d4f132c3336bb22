"""Mixing of sources: targets against a plain filling, transfers and copies against their laws."""

import random
import re
from collections import Counter, defaultdict

import pytest

from landlens.llm import mixing as M

RX = re.compile(r"[^\x20\x09-\x0D]+")


def filled(sizes):
    """Targets by giving out, stopping and giving out again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, rest, free = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while free and rest > 1e-9:
        w = sum(weight[s] for s in free)
        for s in free:
            target[s] += rest * weight[s] / w
        over = {s: target[s] - 2 * sizes[s] for s in free if target[s] >= 2 * sizes[s]}
        rest = sum(over.values())
        for s in over:
            target[s] = 2.0 * sizes[s]
        free -= set(over)
    return target


def sums(docs):
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len(RX.findall(r.text or ""))
    return sizes


def hold(docs, got):
    want, sizes, largest = filled(sums(docs)), sums(docs), defaultdict(int)
    source = {r.doc_id: r.source for r in docs.collect()}
    size = {r.doc_id: len(RX.findall(r.text or "")) for r in docs.collect()}
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.collect())
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r["size"] == size[r.doc_id] and r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        rate = want[s] / sizes[s] if sizes[s] else 0
        assert r.taken in (int(rate + 1e-9) * r["size"], -int(-rate // 1) * r["size"]) and r.taken <= 2 * r["size"]
        taken[s] += r.taken
        largest[s] = max(largest[s], r["size"])
    for s in want:
        assert abs(taken[s] - want[s]) < max(1, largest[s])


def test_targets_and_copies_of_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = M.mix_report(docs).collect()
    hold(docs, got)
    assert sorted(map(tuple, M.mix_report(docs.repartition(7)).collect())) == sorted(map(tuple, got))


def test_many_blocks_and_a_hot_source(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 8)
    rng = random.Random(5)
    rows = [(i, "w " * rng.choice([0, 1, 2, 3, 50, 400]), rng.choice(["hot"] * 20 + ["b", "é", "", None])) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    hold(docs, M.mix_report(docs).collect())


def test_odd_rows(spark):
    rows = [(1, None, "a", 1), (2, "", "a", 1), (None, "x y", None, 2), (None, "x y", None, 2), (3, "one two\x0bthree", "", 3), (3, "one two\x0bthree", "", 3), (4, "w " * 90000, "a", 1), (5, "x", "z", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, key int")
    got = M.mix_report(docs).collect()
    assert len(got) == 8 and {r["size"] for r in got if r.doc_id in (1, 2)} == {0} and all(r.taken == 0 for r in got if r["size"] == 0)
    mixed = M.mix(docs)
    assert mixed.columns == docs.columns
    count = Counter()
    for r in got:
        count[r.doc_id] += r.copies if r["size"] else 0
    assert Counter(r.doc_id for r in mixed.collect()) == +count
    assert M.mix_report(docs.limit(0)).count() == 0
    assert all(r.taken == 0 and r.target == 0 for r in M.mix_report(docs.where("doc_id < 3")).collect())


def test_transfers_keep_sum_and_expectation():
    rng = random.Random(1)
    for size_a, a, size_b, b in ((10, 3.0, 4, 3.0), (5, 2.5, 5, 2.5), (1, 0.25, 900, 899.5), (7, 6.5, 2, 0.5)):
        mean = 0.0
        for _ in range(20000):
            x, y = M.move(a, size_a, b, size_b, rng.random())
            assert x + y == pytest.approx(a + b) and (x in (0, size_a) or y in (0, size_b)) and 0 <= x <= size_a and 0 <= y <= size_b
            mean += x / 20000
        assert mean == pytest.approx(a, abs=0.03 * size_a)


def test_copies_are_unbiased(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 9), "abc"[i % 3]) for i in range(60)], "doc_id long, text string, source string")
    n, mean = 6, Counter()
    for seed in range(n):
        for r in M.mix_report(docs, seed=seed).collect():
            mean[r.doc_id] += r.copies / n
            rate = r.target / r.source_size
            mean["sum"] += (r.copies - rate) / n
    assert abs(mean["sum"]) < 4

"""Phrases against counting every phrase of every text."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from landlens.llm import phrases as P

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def by_hand(rows, least, top=2000):
    total, count = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, 6):
                count[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in count.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {q for p, b in cand.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * b >= 100 * f[q := p[i : i + k]]}
        best = []
        for p, a in cand.items():
            if p not in gone:
                score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def same(docs, least):
    got = sorted(map(tuple, P.collocations(docs).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))
    want = by_hand([(r.lang, r.text) for r in docs.collect()], least)
    assert got == want and want
    return got


def test_phrases_of_the_table(spark, sf_dir):
    same(spark.read.parquet(f"{sf_dir}/documents.parquet"), 100)


@pytest.fixture
def odd(spark, monkeypatch):
    monkeypatch.setattr(P, "MIN_COUNT", 3)
    rng = random.Random(2)
    words = "a b B é É ab aa x\x1cy 😀 the".split(" ")
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", "! ", "\x0b"]) for _ in range(rng.randrange(60))) for _ in range(60)]
    rows = [(i, t, rng.choice(["en", "en", "en", "und", None, ""]), 1) for i, t in enumerate(texts)] + [(1, None, "en", 2), (None, "", None, 3), (2, "no end " * 5000, "xx", 4), (2, "no end " * 5000, "xx", 4), (3, "w" * 300000 + " z " * 9, "xx", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n int")


def test_odd_texts(odd):
    same(odd, 3)
    assert P.collocations(odd.limit(0)).count() == 0


def test_small_slices_and_blocks(odd, monkeypatch):
    rows = [(r.text or "").encode() for r in odd.collect()]
    salt = np.arange(len(rows)).astype(np.uint64)
    whole = [P.Block(rows).grams(n, salt) for n in range(1, 6)]
    monkeypatch.setattr(P, "SLICE", 16)
    for n, (first, fp) in enumerate(whole, 1):
        at, h = P.Block(rows).grams(n, salt)
        assert (at == first).all() and (h == fp).all()
    for t in rows:
        parts = list(P.cut(t, 7))
        assert b"".join(parts) == t and all(P.END_RX.match(x, len(x) - 1) for x in parts[:-1])
        assert sum(len(P.Block([x]).grams(3, salt)[0]) for x in parts) == len(P.Block([t]).grams(3, salt)[0])
    monkeypatch.setattr(P, "HELD", 10)
    same(odd, 3)


@pytest.mark.parametrize("bits", [1, 9])
def test_phrases_of_one_fingerprint_are_counted_by_text(odd, bits):
    got, total = P.frequent_phrases(odd, bits=bits)
    want, want_total = P.frequent_phrases(odd)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and sorted(map(tuple, total.collect())) == sorted(map(tuple, want_total.collect()))


def test_colliding_fingerprints_are_told_apart():
    rng = random.Random(4)
    block = P.Block([" ".join(rng.choice(["a", "b", "cc", "dd", "é"]) for _ in range(300)).encode()])
    for n in (1, 2, 3):
        first = np.arange(300 - n + 1)
        for fp in (np.zeros(len(first), np.uint64), np.array([i % 3 for i in first], np.uint64)):
            got = Counter()
            for i, c in P.distinct_phrases(block, first, fp, n):
                got[block.phrase(i, n)] += c
            assert got == Counter(block.phrase(i, n) for i in first.tolist())


def test_fingerprints_follow_the_words():
    salt = np.array([1, 2], np.uint64)
    block = P.Block([b"One two  three.four ONE two\tthree", b"one two three"])
    for n in (1, 2, 3):
        first, fp = block.grams(n, salt)
        seen = defaultdict(set)
        for i, h in zip(first.tolist(), fp.tolist()):
            seen[int(block.row[i]), block.phrase(i, n)].add(h)
        assert all(len(v) == 1 for v in seen.values()) and len(set().union(*seen.values())) == len(seen)


def test_a_task_adds_up_in_bounded_memory():
    import tracemalloc

    import pyarrow as pa

    class Rows:
        def mapInArrow(self, run, schema):
            self.run = run
            raise StopIteration

    rows, rng = Rows(), np.random.default_rng(3)
    with pytest.raises(StopIteration):
        P.count_fingerprints(rows, [2], [], 64)
    texts = [" ".join(map(str, rng.integers(0, 100_000, 90_000))) for _ in range(30)]
    batches = [pa.RecordBatch.from_arrays([pa.array(["en"] * 10), pa.array(texts[i : i + 10])], names=["lang", "text"]) for i in range(0, 30, 10)]
    tracemalloc.start()
    try:
        total = sum(np.array(b.column(1)).sum() for b in rows.run(iter(batches)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert total == 30 * 89_999 and peak < 200 << 20, peak


def test_rows_of_one_fingerprint_with_other_polynomials_stay_apart():
    rng = np.random.default_rng(4)
    fp, tail = rng.integers(0, 40, 3000).astype(np.uint64), rng.integers(0, 12, 3000).astype(np.uint64) << np.uint64(14)
    fp[:1000], tail[:1000] = 100 + np.arange(1000) % 300, (np.arange(1000) % 300).astype(np.uint64) << np.uint64(16)
    n, want = rng.integers(1, 9, 3000), {}
    for f, c, t in zip(fp.tolist(), n.tolist(), tail.tolist()):
        c0, t0 = want.get((f, t >> 16), (0, t))
        want[f, t >> 16] = c0 + c, min(t0, t)
    got = P.added([(fp[:1700], n[:1700], tail[:1700]), (fp[1700:], n[1700:], tail[1700:])])
    assert sorted(zip(*(x.tolist() for x in got))) == sorted((f, c, t) for (f, _), (c, t) in want.items())

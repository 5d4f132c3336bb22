"""The filters' audit against running every order document by document, and potentials against marginal sums."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np

from landlens.llm import filter_audit as A


def fails(t, copied):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {f for f, x in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), any(c in "#$%&*|" for c in t), copied)) if x}


def by_hand(docs, labels):
    good = {r.doc_id for r in labels if r.quality == 1 and r.doc_id is not None}
    toxic = {r.doc_id for r in labels if r.toxic == 1 and r.doc_id is not None}
    first = {}
    for r in docs:
        if r.doc_id is not None:
            first[r.text or ""] = min(first.get(r.text or "", r.doc_id), r.doc_id)
    rows = [(r.source or "", fails(r.text or "", r.doc_id is not None and first[r.text or ""] < r.doc_id), r.doc_id in good, r.doc_id in toxic) for r in docs]
    out, share = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            whole = left
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in r[1] for r in whole) - len(gone), sum(r[1] == {f} for r in whole), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                share[part, f] += len(gone)
    return {(p, o, s, *v, share[p, o[s - 1]]) for (p, o, s), v in out.items()}


def same(docs, labels):
    got = list(map(tuple, A.filter_audit(docs, labels).collect()))
    assert len(set(got)) == len(got) and set(got) == by_hand(docs.select("doc_id", "text", "source").collect(), labels.collect())


def test_audit_of_the_table(spark, sf_dir):
    same(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def test_audit_of_odd_rows(spark):
    clean = " ".join(f"w{i}" for i in range(60))
    texts = [None, "", " ", "a b c", clean, clean, "word " * 80, clean.upper(), clean + " #", "x " * 100000, "A" * 9, clean + "|"]
    rows = [(i, t, "p" if i % 2 else None, 1) for i, t in enumerate(texts)] + [(4, clean, "q", 2), (None, clean, "p", 3), (None, clean, "p", 3), (3, "a b c", "p", None), (90, "", "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mask int")
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 1), (5, 1, None), (3, None, 1), (None, 1, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")
    same(docs, labels)
    same(docs, labels.limit(0))
    assert A.filter_audit(docs.limit(0), labels).count() == 0


def test_potentials_give_the_shapley_counts():
    rng = random.Random(3)
    counts = np.array([[rng.randrange(10**12) for _ in range(32)] for _ in range(3)], dtype=np.int64)
    worth = A.removed(counts)
    p = A.potentials(worth, 5)
    for f in range(5):
        want = np.zeros(3, dtype=np.int64)
        for order in permutations(range(5)):
            before = sum(1 << g for g in order[: order.index(f)])
            want += worth[:, before | 1 << f] - worth[:, before]
        assert (p[:, 31] - p[:, 31 ^ (1 << f)] == want).all()

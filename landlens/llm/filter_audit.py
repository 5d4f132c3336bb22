"""How filters share their work: coalitions, orders and Shapley counts of five document filters.

A document is kept or removed by a set of filters according to which of them it fails, so per part of the corpus the counts
of the 32 combinations of failures decide every order. The worth of a coalition is the number of documents that it removes;
its Hart-Mas-Colell potential is (worth + sum of the potentials without one member) / members, and a filter's Shapley count
is the potential of all filters minus the potential without that filter. The step of an order is a difference of two
coalitions. Only the counts of combinations leave the documents.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stable import checkpoint
from .common import words_column

FILTERS = "ABCDE"
MIN_WORDS = 50
MIN_DISTINCT_PCT = 65
MAX_CAPITAL_PCT = 5
SYMBOLS = r"[#$%&*|]"
KINDS = ("n", "good", "toxic")


def failures(docs: DataFrame, id_col="doc_id", text_col="text", part_col="source") -> DataFrame:
    """Per row: ``doc_id``, ``part`` (null: empty string), ``copy`` (SHA-256 of the text) and ``mask``, whose bit i is set if
    the row fails filter i of A to D.

    Null texts are empty: they fail A; of texts without a word or a character, B and C find nothing to fail."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("t"))
    rows = rows.withColumn("words", words_column(F.col("t")))
    n = F.size("words").cast("long")
    fails = [
        n < MIN_WORDS,
        100 * F.size(F.array_distinct("words")).cast("long") < MIN_DISTINCT_PCT * n,
        100 * F.regexp_count("t", F.lit("[A-Z]")).cast("long") > MAX_CAPITAL_PCT * F.length("t").cast("long"),
        F.col("t").rlike(SYMBOLS),
    ]
    mask = F.lit(0)
    for i, failed in enumerate(fails):
        mask = mask + F.when(failed, 1 << i).otherwise(0)
    return rows.select("doc_id", "part", F.unhex(F.sha2(F.col("t"), 256)).alias("copy"), mask.alias("mask"))


def with_copies(rows: DataFrame) -> DataFrame:
    """``rows`` of ``failures`` with the bit of filter E set where an equal text has a smaller doc_id.

    The smallest id of a text comes from an aggregation, so a text of any number of copies costs no task more than another;
    it then meets the rows by text and id, of which no group is large. A null id is never larger than another. Texts are
    compared by SHA-256."""
    first = rows.where("doc_id is not null").groupBy("copy").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copied = F.col("first").isNull() & F.col("doc_id").isNotNull()
    return rows.join(first, ["copy", "doc_id"], "left").select("doc_id", "part", (F.col("mask") + F.when(copied, 1 << 4).otherwise(0)).alias("mask"))


def combinations_of_failures(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", part_col="source") -> DataFrame:
    """``part``, ``mask``, and the documents with that mask: ``n``, ``good`` (quality 1) and ``toxic`` (toxic 1).

    Of several labels of an id, one that says so is enough; rows without an id have no label."""
    rows = with_copies(checkpoint(failures(docs, id_col, text_col, part_col)))
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    labelled = rows.where("doc_id is not null").join(said.where("good or toxic"), "doc_id", "left")
    bare = rows.where("doc_id is null").select("doc_id", "part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    both = labelled.select(*bare.columns).unionByName(bare)
    return both.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def removed(counts: np.ndarray) -> np.ndarray:
    """Documents that each coalition removes, from the counts of the combinations: both have the bit masks in the last axis."""
    masks = np.arange(counts.shape[-1])
    return counts @ ((masks[:, None] & masks[None, :]) != 0).astype(np.int64)


def potentials(worth: np.ndarray, players: int) -> np.ndarray:
    """players! times the potential of each coalition, in whole numbers: coalition after coalition from the smaller ones."""
    out = np.zeros_like(worth)
    for s in sorted(range(1, 1 << players), key=int.bit_count):
        inside = [s ^ (1 << i) for i in range(players) if s >> i & 1]
        out[..., s] = (factorial(players) * worth[..., s] + sum(out[..., t] for t in inside)) // len(inside)
    return out


#: All orders of the filters, and for each order and step the filter, the coalition before it and after it.
ORDERS = list(permutations(range(len(FILTERS))))
STEPS = [(f, sum(1 << g for g in order[:k]), sum(1 << g for g in order[: k + 1])) for order in ORDERS for k, f in enumerate(order)]
REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit_parts(counts: DataFrame, parts_at_once: int = 64) -> DataFrame:
    """The audit's rows from ``counts(part, mask, n, good, toxic)``: per part, every order and step."""
    sizes = 1 << len(FILTERS)
    sums = [F.sum(F.when(F.col("mask") == m, F.col(k)).otherwise(0)).alias(f"{k}{m}") for k in KINDS for m in range(sizes)]
    names = [f"{k}{m}" for k in KINDS for m in range(sizes)]
    filters, before, after = (np.array(x) for x in zip(*STEPS))
    orders = ["".join(FILTERS[f] for f in order) for order in ORDERS for _ in order]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, parts_at_once):
                b = batch.slice(at, parts_at_once)
                table = np.stack([np.asarray(c, dtype=np.int64) for c in b.columns[1:]], axis=1).reshape(b.num_rows, len(KINDS), sizes)
                gone = removed(table)
                n, (lost, good, toxic) = table[:, 0], (gone[:, k][:, after] - gone[:, k][:, before] for k in range(len(KINDS)))
                potential = potentials(gone[:, 0], len(FILTERS))
                shapley = np.stack([potential[:, -1] - potential[:, (sizes - 1) ^ (1 << f)] for f in range(len(FILTERS))], axis=1)
                alone = n[:, [1 << f for f in range(len(FILTERS))]]
                fails = gone[:, 0][:, [1 << f for f in range(len(FILTERS))]]
                kept = n.sum(axis=1, keepdims=True) - gone[:, 0][:, after]
                columns = [kept, lost, fails[:, filters] - lost, alone[:, filters], good, toxic, shapley[:, filters]]
                parts = [p for p in b.column(0).to_pylist() for _ in STEPS]
                steps = np.tile(np.arange(len(STEPS)) % len(FILTERS) + 1, b.num_rows).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(parts), pa.array(orders * b.num_rows), pa.array(steps), *(pa.array(c.ravel()) for c in columns)], names=[c.split()[0] for c in REPORT.split(", ")])

    return counts.groupBy("part").agg(*sums).select("part", *names).mapInArrow(run, REPORT)


def filter_audit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", part_col="source") -> DataFrame:
    """Per part, order of the five filters and step: ``kept`` documents after the step, ``removed`` here, ``redundant`` (fail
    its filter, removed earlier), ``unique_fails`` (fail no other), ``good_lost``, ``toxic_lost`` and ``shapley``.

    Null texts are empty, a null part is the empty string, null ids fail no comparison with copies, repeated rows with one
    id are no copies of each other but count each; an empty table gives no part; other columns are ignored. Texts are read
    once; what is shuffled has some 60 bytes a document."""
    return audit_parts(combinations_of_failures(docs, labels, id_col, text_col, part_col))

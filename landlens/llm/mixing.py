"""Mixing of sources to target weights by pivotal dependent rounding.

Every source gets a target number of words. Its documents all start with the same fractional number of copies, target over
size. Whole copies are given at once; the fractions left are rounded in pairs: words move between two documents at random,
without bias and without changing their sum, until one of them has a whole copy or none. What one block of documents leaves
open, one document at most, goes up a tree of blocks. So a source's words miss its target by less than one document.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stable import checkpoint, number_rows
from .common import fresh, join_skewed

WORD_RX = r"[^\x20\x09-\x0D]+"
#: Documents of a block at the leaves, and blocks of a block above.
BLOCK = 1024


def source_key(source):
    """A key that tells null from every string; nulls share one."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source``, ``key``, ``source_size``, ``n_docs``, ``target`` of each source in ``sizes(source, size)``.

    Sources in order of code points, null last, weigh ``weights`` in turn. ``share`` times all words are given out by
    weight; a source stops at ``most`` times its own words and what is over goes to the others by weight, until none is
    above. That is the level at which sum(min(most * size, level * weight)) is what is to be given, found by raising the
    level for as long as it stops further sources: one aggregation of the sources a step, of which two sums reach the
    driver. Sources are never collected. An empty table gives none; where no source has a word all targets are 0.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    placed = number_rows(per, [F.asc_nulls_last("source")], "_place")
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.col("_place") - 1, F.lit(len(weights))) + 1).cast("int"))
    held = checkpoint(placed.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most))))
    total = share * float(held.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    while True:
        full = F.col("_cap") < F.lit(level) * F.col("_w")
        s = held.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("_cap"))).alias("cap"), F.sum(F.when(~full, F.col("_w"))).alias("w")).first()
        if s["n"] == stopped or not s["w"]:
            break
        stopped, level = s["n"], (total - (s["cap"] or 0.0)) / s["w"]
    target = F.least("_cap", F.lit(level) * F.col("_w"))
    return held.select("source", source_key(F.col("source")).alias("key"), "source_size", "n_docs", target.alias("target"))


def move(a: float, size_a: int, b: float, size_b: int, u: float) -> tuple[float, float]:
    """Words of two documents after one transfer: 0 < a < size_a and 0 < b < size_b. Their sum stays, each keeps its
    expectation, and one of them at least ends at none or at its size. ``u`` is uniform in [0, 1)."""
    to_a, to_b = min(size_a - a, b), min(a, size_b - b)
    if u * (to_a + to_b) < to_b:
        a, b = (float(size_a), b - to_a) if size_a - a <= b else (a + b, 0.0)
    else:
        a, b = (0.0, a + b) if a <= size_b - b else (a - to_b, float(size_b))
    near = lambda x, size: 0.0 if x < 1e-9 * size else float(size) if x > size * (1 - 1e-9) else x
    return near(a, size_a), near(b, size_b)


ROW = "doc_id long, mark long, key string, size long, source_size long, target double, base long, block long, blocks long, words double"
COLUMNS = [c.split()[0] for c in ROW.split(", ")]


def settle(rows: DataFrame, level: int, seed: int) -> DataFrame:
    """``rows`` with all ``words`` at none or at ``size``, but for one document of each block of a source with more blocks.

    The documents of a block meet in one task, largest first, and only one is open at any time; the random numbers follow
    from seed, level, source and block alone, so that a repeated task or run decides alike. In the last block of a source
    what is left open is drawn with its own probability."""
    at_key, at_size, at_block, at_blocks, at_words = (COLUMNS.index(c) for c in ("key", "size", "block", "blocks", "words"))

    def run(batches):
        import pyarrow as pa

        here, held, rng = None, None, None

        def close(out):
            if held is not None:
                if held[at_blocks] == 1:
                    held[at_words] = float(held[at_size]) if rng.random() * held[at_size] < held[at_words] else 0.0
                out.append(held)

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], names=COLUMNS)

        kinds = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]] for c in ROW.split(", ")]
        for batch in batches:
            out = []
            for row in map(list, zip(*(c.to_pylist() for c in batch.columns))):
                if (row[at_key], row[at_block]) != here:
                    close(out)
                    here, held = (row[at_key], row[at_block]), None
                    rng = random.Random(f"{seed}/{level}/{row[at_key]}/{row[at_block]}")
                if held is None:
                    held = row
                    continue
                held[at_words], row[at_words] = move(held[at_words], held[at_size], row[at_words], row[at_size], rng.random())
                open_ = [x for x in (held, row) if 0 < x[at_words] < x[at_size]]
                out += [x for x in (held, row) if not 0 < x[at_words] < x[at_size]]
                held = open_[0] if open_ else None
            if out:
                yield batch_of(out)
        out = []
        close(out)
        if out:
            yield batch_of(out)

    dealt = rows.select(*COLUMNS).repartition("key", "block")
    return dealt.sortWithinPartitions("key", "block", F.desc("size"), "doc_id", "mark", "words").mapInArrow(run, ROW)


def copies(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=(3, 1, 2), share=1.5, most=2.0, seed=42) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``key``, ``mark`` (hash of the text), ``size``, ``source_size``, ``target`` of its
    source and ``copies``, the times the mix takes it.

    Size: words of the text; null texts have none, and documents without a word are never taken. Null sources are one
    source of their own; null ids are kept; repeated rows are rounded each; an empty table gives an empty one; other
    columns are ignored. Only ids, hashes and sizes are shuffled. Documents are dealt to blocks by a hash of id, text and
    size, so a source of any share is spread over as many blocks as it needs.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sizes = checkpoint(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD_RX)).cast("long").alias("size")))
    targets = source_targets(sizes, weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    rows = join_skewed(sizes.withColumn("key", source_key(F.col("source"))).drop("source"), targets.drop("source"), ["key"])
    blocks = F.ceil(F.col("n_docs") / F.lit(BLOCK)).cast("long")
    rows = rows.withColumns({"base": F.floor(rate).cast("long"), "words": (rate - F.floor(rate)) * F.col("size"), "blocks": blocks})
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "mark", "size", F.lit(seed)), F.col("blocks"))).select(*COLUMNS)
    rows = checkpoint(rows)
    open_ = (F.col("words") > 0) & (F.col("words") < F.col("size"))
    done, level = [rows.where(~open_)], 0
    rows = rows.where(open_)
    while True:
        settled = checkpoint(settle(rows, level, seed))
        done.append(settled.where(~open_))
        rows = settled.where(open_).withColumns({"block": F.floor(F.col("block") / BLOCK).cast("long"), "blocks": F.ceil(F.col("blocks") / BLOCK).cast("long")})
        level += 1
        if rows.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "key", "mark", "size", "source_size", "target", F.when(F.col("size") > 0, F.col("base") + (F.col("words") > 0).cast("long")).otherwise(0).alias("copies"))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``size``, ``source_size``, ``target``, ``taken`` words, ``copies``; see ``copies``."""
    c = F.col
    return copies(docs, **options).select("doc_id", "size", "source_size", "target", (c("copies") * c("size")).alias("taken"), "copies")


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", **options) -> DataFrame:
    """The mix itself: every document of ``docs`` as often as it is taken, with its columns. Rows with the same id, source
    and text are one document, of which one row stands for all; its copies are those of all of them."""
    n, key, mark, own = (fresh(x, docs.columns) for x in ("_copies", "_key", "_mark", "_id"))
    taken = copies(docs, id_col, text_col, source_col, **options).where("copies > 0").groupBy("doc_id", "key", "mark").agg(F.sum("copies").alias(n))
    taken = taken.select(F.col("doc_id").alias(own), F.col("key").alias(key), F.col("mark").alias(mark), n)
    once = docs.dropDuplicates([id_col, text_col, source_col])
    same = F.col(own).eqNullSafe(once[id_col].cast("long")) & (F.col(key) == source_key(once[source_col])) & (F.col(mark) == F.xxhash64(F.coalesce(once[text_col].cast("string"), F.lit(""))))
    joined = once.join(taken, same)
    return joined.withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*docs.columns)

"""SimHash near-duplicates by pigeonhole blocks."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Forest, checkpoint, components, fresh, join_skewed, small_batches

#: Widths of the six blocks of a 64-bit fingerprint.
WIDTHS = (11, 11, 11, 11, 10, 10)


def fingerprint_of(text: str | None, shingle: int = 4) -> int:
    """64-bit SimHash of word shingles; A-Z are lower-cased; no words: 0."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, 42)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[:-1].tolist()]
        hashes = [digest(joined[s:e], 42) for s, e in zip(starts, (ends[shingle - 1 :] - 1).tolist())]
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = np.array(hashes[i : i + (1 << 15)], dtype=np.uint64).astype(">u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``doc_id``, ``fp`` (signed 64-bit) for every row; null text counts as empty."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fps = np.array([fingerprint_of(t, shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _block_keys(fp, same: int = 2):
    """One key for each choice of ``same`` blocks of six: with 4 differing bits, two of six blocks are equal."""
    blocks, low = [], 0
    for w in WIDTHS:
        blocks.append(F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << w) - 1)))
        low += w
    keys = []
    for n, chosen in enumerate(combinations(range(len(WIDTHS)), same)):
        key = F.lit(n).cast("long")
        for c in chosen:
            key = F.shiftleft(key, WIDTHS[c]).bitwiseOR(blocks[c])
        keys.append(key)
    return F.array(*keys)


def link_fingerprints(reps: DataFrame, max_distance: int = 4, part: int = 2048) -> DataFrame:
    """Spanning edges ``a, b`` among ``reps(rep, fp)`` (distinct fingerprints) at Hamming distance <= 4.

    Two fingerprints that differ in at most four bits share two of six blocks, so every such pair meets
    under one of 15 block-pair keys. A key with more than ``part`` fingerprints is dealt into parts, and
    each pair of parts is its own group, so a hot key spreads over many tasks and stays whole. Inside a
    group all distances are computed, but only a spanning forest of the links is returned.
    """
    keyed = reps.select("rep", "fp", F.explode(_block_keys(F.col("fp"))).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    keyed = keyed.join(sizes, "key")
    n_parts = F.ceil(F.col("n") / F.lit(part)).cast("int")
    keyed = keyed.withColumn("parts", n_parts).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    spread = keyed.select("key", "rep", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    grouped = (
        spread.groupBy("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
        .agg(F.collect_list(F.struct("rep", "fp")).alias("items"))
        .where(F.size("items") > 1)
        .select(F.col("items.rep").alias("reps"), F.col("items.fp").alias("fps"))
    )

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            a, b = [], []
            for ids, fps in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i, j in _forest(np.array(fps, dtype=np.int64).view(np.uint64), max_distance):
                    a.append(ids[i])
                    b.append(ids[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return grouped.mapInArrow(run, "a long, b long").distinct()


def _forest(fps: np.ndarray, max_distance: int) -> list[tuple[int, int]]:
    if len(fps) == 2:
        return [(0, 1)] if int(fps[0] ^ fps[1]).bit_count() <= max_distance else []
    forest, out = Forest(len(fps)), []
    for i in range(len(fps) - 1):
        near = np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= max_distance) + i + 1
        out += [(i, int(j)) for j in near if forest.join(i, int(j))]
    return out


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = 4) -> DataFrame:
    """Per row: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` (smallest doc_id reachable).

    Texts with no words have fingerprint zero and link like any other. Rows with a null doc_id are kept;
    a group of only such rows has a null component_id. Repeated rows give repeated results, an empty table
    an empty one; further columns of ``docs`` are ignored.
    """
    prints = checkpoint(fingerprints(docs, id_col, text_col))
    reps = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    comp = components(link_fingerprints(reps.where("rep is not null").select("rep", "fp"), max_distance))
    known = reps.join(comp, reps.rep == comp.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return join_skewed(prints, known, ["fp"]).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def simhash_keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = 4) -> DataFrame:
    """Rows of ``docs`` whose id is the smallest of its group; of rows with the same id, that of the smallest text stays.

    Rows with a null id are kept, as no group can name them. Null texts count as empty; further columns may bear any
    name; an empty table gives an empty one."""
    groups = simhash_groups(docs, id_col, text_col, max_distance)
    win, copy = fresh("_win", docs.columns), fresh("_copy", docs.columns)
    winners = groups.where("doc_id = component_id").select(F.col("doc_id").alias(win)).distinct()
    rows = docs.where(F.col(id_col).isNotNull())
    kept = rows.join(winners, rows[id_col].cast("long") == F.col(win), "left_semi")
    first = Window.partitionBy(id_col).orderBy(F.col(text_col).asc_nulls_last())
    once = kept.withColumn(copy, F.row_number().over(first)).where(F.col(copy) == 1).drop(copy)
    return once.unionByName(docs.where(F.col(id_col).isNull()))

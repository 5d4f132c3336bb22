"""Helpers shared by the corpus operators: table reading, checkpoints, connected components."""

from __future__ import annotations

import gc
import os
import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stable import measured

#: ASCII white space, the only separators of words in these operators.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SPACE_RX = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Path of a public tokenizer's file; ``PUBLIC_TOKENIZERS`` may name another folder."""
    folder = os.environ.get("PUBLIC_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the folder that the session names in spark.checkpoint.dir.

    Only where the setting is absent, as in tests, a local folder is taken."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="landlens-ckpt-"))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished stages.

    Spark removes them only once the driver has collected the garbage of their plans, which a driver with little to do
    puts off; a job of many stages would hold the files of all of them on the executors' disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches of at most 8 MB from here on, so that a worker's memory does not follow the rows' width.

    Set for the session, as Spark reads the setting when a plan runs; a user's own smaller value stays."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20), ("spark.sql.execution.arrow.maxRecordsPerBatch", 4000)):
        now = str(conf.get(key)).lower().rstrip("b")
        if not now.isdigit() or int(now) > most or int(now) == 0:
            conf.set(key, str(most))
    return df


def words_column(text):
    """Array of the words of ``text`` (runs free of ASCII white space); null or blank: empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RX))


class Forest:
    """Union-find over 0..n-1 with the smallest member as root; used inside one task on one bounded block."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def fresh(name: str, taken) -> str:
    """``name``, or with underscores before it until no column of ``taken`` bears it (letter case aside)."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def join_skewed(rows: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of ``rows`` with ``side`` (each key once) on ``keys``, whatever the number of rows of one key.

    ``side`` often comes from an aggregation on the keys. Joined as it is, both would share one shuffle, which leaves
    all rows of a key in one task; checkpointed, it has a shuffle of its own, and the adaptive plan splits partitions
    of ``rows`` that are far larger than others."""
    return rows.join(checkpoint(side), keys)


#: Size of a bit filter; with more keys than it holds well it lets more through, and nothing is lost.
FILTER_BITS, FILTER_SLICES = 26, 64


def _filter_positions(h: np.ndarray) -> np.ndarray:
    u, mask = h.view(np.uint64), np.uint64((1 << FILTER_BITS) - 1)
    return np.concatenate((u & mask, (u >> np.uint64(FILTER_BITS)) & mask)).astype(np.int64)


def bit_filter(keys: DataFrame, hash_col: str):
    """Broadcast of a Bloom filter with the 64-bit hashes in ``hash_col``: 2^FILTER_BITS bits (8 MB) at any input.

    Each of FILTER_SLICES slices is put together in one task and sent to the driver once."""
    width = (1 << FILTER_BITS) // FILTER_SLICES

    def place(batches):
        import pyarrow as pa

        for b in batches:
            at = np.unique(_filter_positions(np.array(b.column(0), dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array((at // width).astype(np.int32)), pa.array(at % width)], names=["slice", "at"])

    def gather(batches):
        import pyarrow as pa

        held = {}
        for b in batches:
            slices, at = np.array(b.column(0)), np.array(b.column(1))
            for s in np.unique(slices).tolist():
                held.setdefault(s, np.zeros(width, bool))[at[slices == s]] = True
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.packbits(x).tobytes() for x in held.values()], pa.binary())], names=["slice", "bits"])

    placed = keys.select(F.col(hash_col).cast("long")).mapInArrow(place, "slice int, at long")
    sc = keys.sparkSession.sparkContext
    bits = np.zeros((FILTER_SLICES, width // 8), np.uint8)
    for r in placed.repartition(FILTER_SLICES, "slice").mapInArrow(gather, "slice int, bits binary").collect():
        bits[r["slice"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return sc.broadcast(bits.ravel())


def passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the filter; a hash that was put in always passes."""
    at = _filter_positions(np.ascontiguousarray(h, dtype=np.int64))
    hit = (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
    return (hit[: len(h)] & hit[len(h) :]).astype(bool)


#: Edges that a task of ``components`` reads at least, where there are so many.
EDGES_A_TASK = 50_000


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` (long ids): ``node``, ``component`` = smallest reachable id.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the edge set no longer
    changes; every round is a pair of keyed aggregations and joins, checkpointed, so no vertex list,
    component or edge set ever meets in one task or on the driver. The minima are checkpointed before they
    are joined, so that each join has shuffles of its own, which the adaptive plan splits at nodes with very
    many edges. Nodes without an edge (and self loops) give no row. Null ends are dropped. The number of tasks follows the
    edges, of which there are often few for the session's shuffle partitions.
    """
    cur = measured(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        EDGES_A_TASK,
    )
    before = None
    for _ in range(max_rounds):
        sig = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if sig == before or sig.n == 0:
            break
        before = sig
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = checkpoint(join_skewed(both, low, ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))
        small = join_skewed(large, large.groupBy("u").agg(F.min("v").alias("m")), ["u"]).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        cur = measured(small.select("e.u", "e.v").where("u <> v").distinct(), EDGES_A_TASK)
    else:
        raise RuntimeError("components did not converge")
    tops = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)

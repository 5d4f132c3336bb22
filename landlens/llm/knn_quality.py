"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms are byte bigrams (hashed to about a thousand buckets) and one for words said twice running, weighted by tf-idf; the space is the truncated SVD of a
bounded, documented sample of labelled rows. The sample's vectors are broadcast, every document's cosine to all
of them is computed exactly in blocks, and its nearest neighbours vote with their similarity as weight.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Parameters: labelled rows a class at most, hashed terms, latent dimensions, voters, decision threshold.
SAMPLE_PER_CLASS = 1200
TERMS = 1024
DIMENSIONS = 48
NEIGHBOURS = 15
THRESHOLD = 0.3
#: Weight of the last term, which stands for the share of words that repeat the word before.
REPEAT_WEIGHT = 6.0
#: Documents in one block of cosine products.
BLOCK = 512


def _buckets(terms: int) -> np.ndarray:
    """Hash bucket of each byte bigram."""
    code = np.arange(1 << 16, dtype=np.uint64)
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % (terms - 1)


_table = _buckets(TERMS)


def term_counts(text: str | None) -> np.ndarray:
    """Counts of the hashed byte bigrams of a whole text, and per cent of repeating words; null and one-byte texts have none."""
    data = (text or "").encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, dtype=np.uint8)
    if len(raw) < 2:
        return np.zeros(TERMS)
    counts = np.bincount(_table[(raw[:-1].astype(np.int64) << 8) | raw[1:]], minlength=TERMS).astype(np.float64)
    words = data.split()
    if len(words) > 1:
        counts[-1] = 100 * sum(map(eq, words, words[1:])) / (len(words) - 1)
    return counts


def nearest(cos: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest of each row, to nine decimals; of equals those that stand first."""
    cos = np.round(cos, 9)
    n = cos.shape[1]
    near = np.argpartition(cos, n - k, axis=1)[:, n - k :]
    least = np.take_along_axis(cos, near, axis=1).min(axis=1)
    for i in np.flatnonzero((cos >= least[:, None]).sum(axis=1) > k):  # equals at the border
        near[i] = np.argsort(-cos[i], kind="stable")[:k]
    return near


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, counts: np.ndarray) -> np.ndarray:
        """Unit vectors in the latent space; rows without terms stay zero."""
        x = np.log1p(counts) * self.idf
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0) @ self.basis
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest vectors, weighted by cosine; no terms or no neighbour: 0."""
        x = self.project(counts)
        if not len(self.labels):
            return np.zeros(len(x))
        cos = x @ self.vectors.T
        near = nearest(cos, min(NEIGHBOURS, len(self.labels)))
        weight = np.maximum(np.take_along_axis(cos, near, axis=1), 0)
        total = weight.sum(axis=1)
        votes = (weight * self.labels[near]).sum(axis=1)
        return np.clip(np.divide(votes, total, out=np.zeros(len(x)), where=total > 0), 0, 1)


def fit(counts: np.ndarray, labels: np.ndarray) -> Model:
    """Latent space and neighbour vectors of the labelled sample."""
    n = len(labels)
    df = (counts > 0).sum(axis=0)
    idf = np.log((1 + n) / (1 + df)) + 1
    idf[-1] = REPEAT_WEIGHT
    empty = Model(idf, np.zeros((TERMS, DIMENSIONS)), np.zeros((0, DIMENSIONS)), np.zeros(0))
    if not n:
        return empty
    x = np.log1p(counts) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    values, vectors = np.linalg.eigh(x.T @ x)  # the right singular vectors, without the larger left side
    model = Model(idf, vectors[:, ::-1][:, :DIMENSIONS], empty.vectors, labels.astype(np.float64))
    model.vectors = model.project(counts)
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Up to SAMPLE_PER_CLASS training rows of each class, chosen by the hash of their ids.

    Rows whose crc32(id) mod 5 is 0 are held out. Only the chosen ids (a few thousand at any input) are broadcast. Of several rows of one id the smallest text is
    taken, so the sample never has more than 2 x SAMPLE_PER_CLASS rows.
    """
    train = labels.where("quality in (0, 1)").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    pick = lambda q: train.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_PER_CLASS)
    chosen = pick(0).unionByName(pick(1)).select(F.col("doc_id").alias("_id"), "quality")
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("text"))
    met = rows.join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
    return met.groupBy(F.col("_id").alias("doc_id"), "quality").agg(F.min("text").alias("text")).select("doc_id", "text", "quality")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [term_counts(t).astype(np.float32) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "quality", "counts"])

    sample = labelled_sample(small_batches(docs), labels, id_col, text_col).mapInArrow(run, "doc_id long, quality int, counts binary")
    rows = sorted((r.doc_id, r.quality, bytes(r.counts)) for r in sample.collect())  # bounded: 2 x SAMPLE_PER_CLASS rows of 4 KB
    counts = np.array([np.frombuffer(r[2], np.float32) for r in rows], dtype=np.float64).reshape(len(rows), TERMS)
    return fit(counts, np.array([r[1] for r in rows]))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", score_as: str = "score", predicted_as: str = "predicted") -> DataFrame:
    """``docs`` with a score (0 to 1) and a prediction (1 if score >= 0.3) appended to every row; input columns of those names give way.

    Labels, language, source and id never enter a score. Null and empty texts score 0; without labelled rows
    every score is 0; repeated rows score alike; an empty table gives an empty one.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col))
    docs = docs.drop(score_as, predicted_as)
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts, scores = b.column(at), []
            for i in range(0, b.num_rows, BLOCK):
                counts = np.array([term_counts(t) for t in texts.slice(i, BLOCK).to_pylist()]).reshape(-1, TERMS)
                scores.append(model.value.score(counts))
            score = np.concatenate(scores) if scores else np.zeros(0)
            extra = [pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*names, score_as, predicted_as])

    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    fields = [StructField(f.name, f.dataType, True) for f in docs.schema.fields]
    return docs.mapInArrow(run, StructType([*fields, StructField(score_as, DoubleType()), StructField(predicted_as, IntegerType())]))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_quality(docs.select("doc_id", F.col("text").cast("string").alias("text")), labels)
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", "predicted")

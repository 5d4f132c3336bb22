"""Opinions matched to their source letters by character 3-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.helpers import nfc
from .stable import checkpoint


#: Opinions' grams up to which they are sent to all tasks; more meet the documents' grams by a shuffle.
BROADCAST_ROWS = 500_000
#: Rarest grams of an opinion that choose the document which its best has to beat.
SEED_GRAMS = 12


def _codes(text: str):
    """Distinct 3-grams of a text as sorted numbers of 63 bits; a shorter text is its own."""
    import numpy as np

    p = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if not len(p):
        return p
    p = np.concatenate((p, np.zeros(max(0, 3 - len(p)), np.int64)))
    return np.unique((p[:-2] << 42) | (p[1:-1] << 21) | p[2:])


def grams(texts: DataFrame, keys: list[str], id_col: str, text_col: str = "norm") -> DataFrame:
    """Distinct 3-grams of each text: a row (keys, id, gram) each. Null and empty texts have none."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                codes = [_codes(t or "") for t in part.column(part.num_columns - 1).to_pylist()]
                rows = pa.array(np.repeat(np.arange(len(codes)), [len(c) for c in codes]))
                yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in part.columns[:-1]), pa.array(np.concatenate(codes))], names=[*keys, id_col, "gram"])

    kinds = dict(texts.dtypes)
    named = texts.select(*keys, F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("_text"))
    return named.mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{id_col} long", "gram long"]))


def _best(asked: DataFrame, documents: DataFrame, keys: list[str]) -> DataFrame:
    """``opinion_id, doc_id, n``: documents of most common grams, a few for each opinion, of which one is its best.

    ``asked`` goes to all tasks as a table from gram to opinions, at most BROADCAST_ROWS numbers. A document is read once and
    its grams stay where they are made: it adds its opinions up by itself, and a batch gives its best for each opinion."""
    import numpy as np

    rows = asked.where(F.col("opinion_id").isNotNull()).select("gram", "opinion_id", *keys).toArrow()
    gram, opinion = (rows.column(i).to_numpy() for i in (0, 1))
    places = {}
    for i, k in enumerate(zip(*(c.to_pylist() for c in rows.columns[2:])) if keys else [()] * len(gram)):
        if None not in k:
            places.setdefault(k, []).append(i)
    index = {}
    for k, at in places.items():
        at = np.array(at)[np.argsort(gram[at], kind="stable")]
        own, group = np.unique(opinion[at], return_inverse=True)
        codes, start = np.unique(gram[at], return_index=True)
        index[k] = codes, np.append(start, len(at)), group, own
    held = asked.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            best = {}
            for doc, text, *key in zip(*(c.to_pylist() for c in b.columns)):
                if not text or (found := held.value.get(tuple(key))) is None:
                    continue
                codes, start, group, own = found
                have = _codes(text)
                at = np.searchsorted(codes, have)
                at[at == len(codes)] = 0
                at = at[codes[at] == have]
                if not len(at):
                    continue
                size = start[at + 1] - start[at]
                where = np.repeat(start[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
                n = np.bincount(group[where], minlength=len(own))
                top_n, top_doc = best.setdefault(tuple(key), (np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)))
                won = (n > top_n) | ((n == top_n) & (n > 0) & (doc < top_doc))
                top_n[won], top_doc[won] = n[won], doc
            for k, (top_n, top_doc) in best.items():
                some = top_n > 0
                yield pa.RecordBatch.from_arrays([pa.array(held.value[k][3][some]), pa.array(top_doc[some]), pa.array(top_n[some])], names=["opinion_id", "doc_id", "n"])

    return documents.select(F.col("doc_id").cast("long"), "norm", *keys).mapInArrow(run, "opinion_id long, doc_id long, n long")


def coverage(opinions: DataFrame, documents: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Per opinion with a text: share of its distinct 3-grams in its best document (first id on ties), among the documents
    with the same ``keys``, or among all. ``opinion_id, doc_id, score``; null and 0 where none shares a gram.

    Up to BROADCAST_ROWS grams, the opinions' go to all tasks and each document is compared with those it shares (``_best``), so
    the work grows with the documents. More are an exact search for the best by an inverted index, rarest grams first. The documents that share most of an opinion's
    rarest grams give it a document to beat, with ``low`` grams in common. A document as good has at least half of ``low``
    outside the opinion's ``low / 2`` most common grams: these, whose lists are the longest, are looked up for the documents
    only that pass. The plan has the same length for any number of opinions; grams meet by joins on the gram. The documents'
    grams are made again for each of the passes, which costs less than writing several times their text, and for the documents to
    beat and those that pass from these alone. Document ids tell the documents of a key apart; null keys meet nothing."""
    keys, at = list(keys), [*keys, "gram"]
    asked = checkpoint(grams(opinions, keys, "opinion_id"))
    checked = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df
    n_asked = asked.count()
    first = lambda n: F.struct(F.col(n), -F.col("doc_id"))
    totals = asked.groupBy("opinion_id").agg(F.count("*").alias("total"))

    def scored(whole: DataFrame) -> DataFrame:
        best = whole.groupBy("opinion_id").agg(F.max_by(F.struct("doc_id", "n"), first("n")).alias("b"))
        return totals.join(best, "opinion_id", "left").select("opinion_id", F.col("b.doc_id").alias("doc_id"), F.round(F.coalesce(F.col("b.n"), F.lit(0)) / F.col("total"), 6).alias("score"))

    if n_asked <= BROADCAST_ROWS:
        return scored(_best(asked, documents, keys))
    small = lambda df: checked(df, n_asked)
    there = grams(documents, keys, "doc_id")
    found = there.join(small(asked.select(*at).distinct()), at, "left_semi").groupBy(*at).agg(F.count("*").alias("df"))
    own = Window.partitionBy("opinion_id")
    ranked = asked.join(found, at).withColumns({"rank": F.row_number().over(own.orderBy("df", "gram")), "known": F.count("*").over(own)})
    ranked = checkpoint(ranked.select(*at, "opinion_id", "rank", "known"))

    def shared(some: DataFrame, *more: str) -> DataFrame:
        return there.join(small(some), at).groupBy("opinion_id", "doc_id", *more).agg(F.count("*").alias("n"))

    def shared_by(pairs: DataFrame, n_pairs: int, some: DataFrame) -> DataFrame:
        """Of ``some`` grams of the opinions, those that the documents of ``pairs`` have: only these documents are read again."""
        own = grams(documents.join(checked(pairs.select("doc_id").distinct(), n_pairs), "doc_id", "left_semi"), keys, "doc_id")
        return own.join(small(some), at).join(checked(pairs.select("opinion_id", "doc_id"), n_pairs), ["opinion_id", "doc_id"]).groupBy("opinion_id", "doc_id").agg(F.count("*").alias("n"))

    seeds = checkpoint(shared(ranked.where(F.col("rank") <= SEED_GRAMS)).groupBy("opinion_id").agg(F.max_by("doc_id", first("n")).alias("doc_id")))
    low = shared_by(seeds, n_asked, ranked.select(*at, "opinion_id")).select("opinion_id", F.col("n").alias("low"))
    spared = F.floor(F.col("low") / 2)
    bound = checkpoint(ranked.join(low, "opinion_id").select(*at, "opinion_id", (F.col("rank") > F.col("known") - spared).alias("common"), (F.col("low") - spared).alias("need")))
    passed = checkpoint(shared(bound.where("not common"), "need").where("n >= need").drop("need"))
    rest = shared_by(passed, passed.count(), bound.where("common").select(*at, "opinion_id")).withColumnRenamed("n", "more")
    whole = passed.join(rest, ["opinion_id", "doc_id"], "left").select("opinion_id", "doc_id", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
    return scored(whole)


def agency_key(group: Column, org: Column, dept: Column) -> Column:
    """What joins opinions to letters: group, agency and department, composed (NFC)."""
    return nfc(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in (group, org, dept)]))


def candidates(opinions: DataFrame, documents: DataFrame) -> DataFrame:
    """Per opinion the number of letters with its ``key``; 0 where none has it."""
    per_key = documents.groupBy("key").agg(F.count("*").alias("n"))
    return opinions.join(per_key, "key", "left").select("opinion_id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def verdict(score: Column, opinion: Column, status: Column, trivial: Column) -> Column:
    """Outcome of a match; what cannot be scored comes first."""
    return (
        F.when(status == "미회신", "미회신").when(score.isNull(), "원문없음").when(opinion == "", "의견 공란").when(score >= 0.85, "일치").when(score >= 0.60, "부분일치").when(trivial, "의견없음").otherwise("상이")
    )

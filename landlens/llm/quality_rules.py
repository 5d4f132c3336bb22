"""Host-level quality rules, native DataFrame expressions only.

Every document is held to a few rules. Failures are summed by host (``source``), each host's failure rate
is shrunk towards the mean of all hosts with a beta prior fitted by the method of moments, and the host's
verdict is joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, checkpoint, join_skewed, words_column

WINDOW = 8

#: Fixed limits of the rules, all in whole numbers so that any engine decides alike.
MIN_WORDS = 20
MAX_REPEAT_PCT = 30
MAX_SYMBOLS_PER_100_WORDS = 50
MAX_DUP_LINE_PCT = 50
MIN_MEAN_WORD, MAX_MEAN_WORD = 2, 15
MAX_HOST_FAIL_RATE = 0.5


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The base counts of each row; null text counts as empty.

    ``n_repeat_words`` compares 8-word windows by 64-bit hashes of their words; with n windows two different
    ones fall together with a chance of n^2/2^65.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), text.alias("t"))
    rows = rows.withColumn("words", words_column(F.col("t")))
    rows = rows.withColumn("n_words", F.size("words").cast("long"))
    windows = F.when(
        F.col("n_words") > WINDOW,
        F.transform(F.sequence(F.lit(1), (F.col("n_words") - (WINDOW - 1)).cast("int")), lambda i: F.xxhash64(F.slice(F.col("words"), i, WINDOW))),
    ).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    rows = rows.select(
        "doc_id",
        "host",
        "n_words",
        F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        windows.alias("win"),
    )
    rows = rows.withColumn("n_lines", F.size("lines").cast("long"))
    rows = rows.withColumn("n_dup_lines", (F.col("n_lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    repeated = F.size(F.array_distinct("win")) < F.size("win")
    # Only texts with a repeated window sort their windows; equal neighbours then give the repeated positions.
    tagged = F.when(repeated, F.array_sort(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.withColumn("s", tagged).drop("win")
    at = lambda i: F.try_element_at(F.col("s"), i)["h"]
    twice = F.filter("s", lambda x, i: x["h"].eqNullSafe(at(i + 2)) | ((i > 0) & x["h"].eqNullSafe(at(F.greatest(i, F.lit(1))))))
    rows = rows.withColumn("p", F.array_sort(F.transform(twice, lambda x: x["i"]))).drop("s")
    steps = F.zip_with(F.slice("p", 2, F.size("p")), F.slice("p", 1, F.size("p") - 1), lambda b, a: F.least(b - a, F.lit(WINDOW)))
    covered = F.when(F.size("p") > 0, F.aggregate(steps, F.lit(WINDOW).cast("long"), lambda a, d: a + d)).otherwise(F.lit(0).cast("long"))
    return rows.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"), "n_lines")


def judge(counts: DataFrame) -> DataFrame:
    """``counts`` with the document's own verdict and its host's, and ``kept``.

    A host's rate of failed documents f/n becomes (f + a)/(n + a + b), where a and b fit the mean and variance
    of the rates of all hosts; a host above the limit is rejected. Documents without a host share one. The variance
    is that of the observed rates: where most hosts are small it includes their sampling noise, so the prior is
    then weaker than the hosts' own spread would make it.
    """
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    soft_failed = (
        (100 * F.col("n_symbols") > MAX_SYMBOLS_PER_100_WORDS * F.col("n_words"))
        | (100 * F.col("n_dup_lines") > MAX_DUP_LINE_PCT * F.col("n_lines"))
        | (F.col("word_chars") < MIN_MEAN_WORD * F.col("n_words"))
        | (F.col("word_chars") > MAX_MEAN_WORD * F.col("n_words"))
    )
    rows = counts.withColumn("base_failed", base_failed).withColumn("rule_failed", F.col("base_failed") | soft_failed)
    rows = rows.withColumn("host_key", F.coalesce("host", F.lit("")))
    hosts = rows.groupBy("host_key").agg(F.count("*").alias("n_docs"), F.count_if("rule_failed").alias("n_failed"))
    rates = hosts.agg(F.avg(F.col("n_failed") / F.col("n_docs")).alias("m"), F.var_pop(F.col("n_failed") / F.col("n_docs")).alias("v"))
    m = F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.col("m")))
    v = F.greatest(F.lit(1e-6), F.least(F.col("v"), m * (1 - m) * 0.5))
    strength = m * (1 - m) / v - 1
    prior = rates.select((m * strength).alias("alpha"), ((1 - m) * strength).alias("beta"))
    verdicts = hosts.crossJoin(F.broadcast(prior)).select(  # one row of prior
        "host_key", "n_docs", "n_failed", ((F.col("n_failed") + F.col("alpha")) / (F.col("n_docs") + F.col("alpha") + F.col("beta"))).alias("host_fail_rate")
    )
    return join_skewed(rows, verdicts, ["host_key"]).withColumn("kept", ~F.col("rule_failed") & (F.col("host_fail_rate") <= MAX_HOST_FAIL_RATE))


def host_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: counts, ``base_failed``, ``host_fail_rate``, ``kept``.

    Null and empty texts have zero words and fail; null and empty hosts are one host; an empty table gives none;
    repeated rows are judged each; other columns are ignored. The counts are checkpointed (some 80 bytes a row),
    so the texts are read once for the host rates and the verdicts.
    """
    judged = judge(checkpoint(text_counts(docs, id_col, text_col, host_col)))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host", F.round("host_fail_rate", 6).alias("host_fail_rate"))

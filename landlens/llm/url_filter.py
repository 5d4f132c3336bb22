"""URL filter: path rules, host-word segmentation and naive Bayes.

Longest-match rules decide first. For the rest, host labels are split into words by unigram Viterbi, and a
multinomial naive Bayes scores the words of host and path.
"""

from __future__ import annotations

from math import log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, join_skewed

#: Rules as (host, path prefix, verdict). A rule fits its host and all subdomains; the longest rule wins.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: Fixed words that mark unwanted hosts, and everyday words of harmless ones; they label the rows that train the model.
BLOCK_WORDS = ("ad", "ads", "adult", "bet", "bets", "betting", "bonus", "casino", "cheap", "click", "escort", "farm", "free", "gambling", "jackpot", "loan", "loans", "malware", "phishing", "pills", "poker", "porn", "pharmacy", "replica", "sex", "slots", "spam", "track", "tracker", "viagra", "warez", "win", "xxx")
COMMON_WORDS = ("archive", "art", "blog", "book", "books", "city", "data", "docs", "edu", "forum", "garden", "guide", "health", "help", "history", "home", "journal", "lab", "library", "mail", "map", "maps", "media", "museum", "music", "news", "open", "page", "pages", "park", "photo", "press", "school", "science", "shop", "sport", "store", "times", "town", "travel", "university", "weather", "wiki", "world")
#: Words whose presence in a host labels a row as unwanted even when joined to others.
SEEDS = ("adult", "ads", "bets", "casino", "gambling", "jackpot", "pills", "poker", "porn", "spam", "viagra", "warez", "xxx")
#: A word of a host is at most a whole label, which has at most 63 letters; parts of a joined name have at least three.
MAX_WORD, LEAST_PART = 63, 3
#: Log probability of a letter outside all words.
UNKNOWN = -12.0
#: Tokens of the whole table that each class is smoothed with, so that what is common in both weighs little in either.
BACKGROUND = 10.0


def url_parts(df: DataFrame, url_col: str = "url") -> DataFrame:
    """``df`` with ``host`` (after the first ``://`` up to / ? # or the end, A-Z lower-cased) and ``path`` (up to ? or #)."""
    rest = F.when(F.instr(F.col(url_col), "://") > 0, F.expr(f"substr({url_col}, instr({url_col}, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return df.withColumn("host", F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).withColumn("path", path)


def rule_column(host, path, rules=RULES):
    """The longest fitting rule and its verdict, as a struct; null without one."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for domain, prefix, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(domain + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def best_split(name: str, spans, unknown: float = UNKNOWN) -> list[str]:
    """Most likely split of a run of letters, by Viterbi over ``spans(start, end, log probability)`` of known words.

    A letter outside all words costs ``unknown``; neighbouring letters of that kind join. Of equal splits the one whose
    last word starts first counts."""
    ends: dict[int, list[tuple[int, float]]] = {}
    for start, end, p in sorted(spans):
        ends.setdefault(end, []).append((start, p))
    best, back = [0.0], [(0, False)]
    for end in range(1, len(name) + 1):
        top, at = best[end - 1] + unknown, (end - 1, False)
        for start, p in ends.get(end, ()):
            if best[start] + p > top:
                top, at = best[start] + p, (start, True)
        best.append(top)
        back.append(at)
    cuts, end = [], len(name)
    while end:
        start, known = back[end]
        if cuts and not known and not cuts[-1][2]:
            cuts[-1] = (start, cuts[-1][1], False)
        else:
            cuts.append((start, end, known))
        end = start
    return [name[i:j] for i, j, _ in reversed(cuts)]


def fewest_parts(name: str, spans) -> list[str] | None:
    """``name`` as the fewest words laid end to end, from ``spans(start, end)`` of known words; None if they don't cover it."""
    ends: dict[int, list[int]] = {}
    for start, end in sorted(spans):
        ends.setdefault(end, []).append(start)
    size, back = [0] + [len(name) + 1] * len(name), [0] * (len(name) + 1)
    for end in range(1, len(name) + 1):
        for start in ends.get(end, ()):
            if size[start] + 1 < size[end]:
                size[end], back[end] = size[start] + 1, start
    if size[-1] > len(name):
        return None
    out, end = [], len(name)
    while end:
        out.append(name[back[end] : end])
        end = back[end]
    return out[::-1]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _best_split(run: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([best_split(r, [] if s is None else [(x["start"], x["end"], x["p"]) for x in s]) for r, s in zip(run, spans)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _fewest_parts(run: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([fewest_parts(r, [(x["start"], x["end"]) for x in s]) for r, s in zip(run, spans)], dtype=object)


def _key(text):
    """``text``, or its SHA-256 after a ``#`` where it is long, so that rows made from it stay short."""
    return F.when(F.length(text) <= MAX_WORD, text).otherwise(F.concat(F.lit("#"), F.sha2(text, 256)))


def host_runs(host):
    """Letter runs of all labels of a host but the last, which is its suffix (a single label counts)."""
    return F.regexp_extract_all(F.when(host.contains("."), F.regexp_replace(host, r"\.[^.]*$", "")).otherwise(host), F.lit("[a-z]+"), F.lit(0))


def path_runs(path):
    return F.regexp_extract_all(F.lower(path), F.lit("[a-z]+"), F.lit(0))


def substrings(runs: DataFrame, least: int) -> DataFrame:
    """``key, start, end, w`` of each substring of ``least`` to MAX_WORD letters of ``runs(key, run)``."""
    starts = runs.where(F.length("run") >= least).select("key", F.length("run").alias("n"), "run", F.explode(F.sequence(F.lit(0), F.length("run") - least)).alias("start"))
    tails = starts.select("key", "n", "start", F.substr("run", F.col("start") + 1, F.lit(MAX_WORD)).alias("tail"))
    ends = tails.select("key", "start", "tail", F.explode(F.sequence(F.col("start") + least, F.least("n", F.col("start") + MAX_WORD))).alias("end"))
    return ends.select("key", "start", "end", F.substr("tail", F.lit(1), F.col("end") - F.col("start")).alias("w"))


def word_counts(hosts: DataFrame) -> DataFrame:
    """``w, n``: how often each word stands in ``hosts(host, n)``, the fixed words once more.

    A name that is whole words of at least three letters joined together would else stand as a word of its own and
    never be split; its count goes to the fewest words that make it up."""
    fixed = hosts.sparkSession.createDataFrame([(w, 1, True) for w in (*BLOCK_WORDS, *COMMON_WORDS)], "w string, n long, fixed boolean")
    seen = hosts.select(F.explode(host_runs(F.col("host"))).alias("w"), "n", F.lit(False).alias("fixed")).where(F.length("w").between(2, MAX_WORD))
    words = checkpoint(seen.unionByName(fixed).groupBy("w").agg(F.sum("n").alias("n"), F.bool_or("fixed").alias("fixed")))
    inner = substrings(words.where("not fixed").select(F.col("w").alias("key"), F.col("w").alias("run")), LEAST_PART).where("w <> key")
    inner = checkpoint(inner.join(words.select("w"), "w"))
    spans = F.collect_list(F.struct("start", "end")).alias("spans")
    # A part that is itself a joined name can be split on, so any cover by known words tells a joined name.
    joined = inner.groupBy("key").agg(spans).where(_fewest_parts("key", "spans").isNotNull())
    joined = checkpoint(joined.select(F.col("key").alias("w")))
    whole = inner.join(joined.withColumnRenamed("w", "key"), "key", "left_semi").join(joined, "w", "left_anti")
    parts = whole.groupBy("key").agg(spans).select(F.col("key").alias("w"), _fewest_parts("key", "spans").alias("parts"))
    parts = parts.join(words.select("w", "n"), "w").select(F.explode("parts").alias("w"), "n")
    return words.join(joined, "w", "left_anti").select("w", "n").unionByName(parts).groupBy("w").agg(F.sum("n").alias("n"))


def segment(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """``key, words``: each of ``runs(key, run)`` split by the probabilities of ``counts(w, n)``."""
    counts = checkpoint(counts)
    total, size = counts.agg(F.sum("n"), F.count("*")).first()
    p = F.log((F.col("n") + 1) / F.lit(float(total + size)))
    floor = F.when(F.col("w").isin(*BLOCK_WORDS, *COMMON_WORDS), -6.0 - 0.1 * F.length("w"))
    known = counts.select("w", F.greatest(p, floor).alias("p"))
    spans = substrings(runs, 2).join(known, "w").groupBy("key").agg(F.collect_list(F.struct("start", "end", "p")).alias("spans"))
    return runs.join(spans, "key", "left").select("key", _best_split("run", "spans").alias("words"))


def token_weights(tokens: DataFrame) -> DataFrame:
    """``token, weight``: log likelihood ratio of block to allow, from ``tokens(token, bad, good)``, by multinomial naive
    Bayes. Each class is smoothed with BACKGROUND tokens dealt as in both together; the fixed words count once more in
    their class."""
    fixed = [("h:" + w, 1, 0) for w in BLOCK_WORDS] + [("h:" + w, 0, 1) for w in COMMON_WORDS]
    tokens = tokens.unionByName(tokens.sparkSession.createDataFrame(fixed, "token string, bad long, good long")).groupBy("token").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    tokens = checkpoint(tokens)
    bad, good = tokens.agg(F.sum("bad"), F.sum("good")).first()
    share = F.lit(BACKGROUND) * (F.col("bad") + F.col("good")) / F.lit(float(bad + good))
    weight = F.log((F.col("bad") + share) / F.lit(bad + BACKGROUND)) - F.log((F.col("good") + share) / F.lit(good + BACKGROUND))
    return tokens.select("token", weight.alias("weight"))


def url_scores(parts: DataFrame) -> DataFrame:
    """``host, path, score``: log odds of block against allow for each different host and path of ``parts``.

    Urls whose segmented host holds a seed word are labelled block, all others allow; the words of all rows count.
    Words, runs, tokens and their weights are tables joined by key, none is held whole anywhere."""
    pair = _key(F.concat("host", "path"))  # a host has no slash and a path starts with one
    urls = checkpoint(parts.groupBy("host", "path").agg(F.count("*").alias("n")).withColumn("pair", pair).withColumn("hk", _key(F.col("host"))))
    hosts = checkpoint(urls.groupBy("hk").agg(F.first("host").alias("host"), F.sum("n").alias("n")))
    in_hosts = hosts.select("hk", "n", F.explode(host_runs(F.col("host"))).alias("run")).withColumn("key", _key(F.col("run")))
    in_paths = urls.select("pair", "hk", "n", F.explode(path_runs(F.col("path"))).alias("run")).withColumn("key", _key(F.col("run")))
    runs = checkpoint(in_hosts.select("key", "run").unionByName(in_paths.select("key", "run")).groupBy("key").agg(F.first("run").alias("run")))
    words = checkpoint(segment(runs, word_counts(hosts)))

    seeded = words.where(F.arrays_overlap("words", F.array(*[F.lit(w) for w in SEEDS]))).select("key")
    bad_hosts = checkpoint(in_hosts.join(seeded, "key", "left_semi").select("hk").distinct().withColumn("is_bad", F.lit(1)))
    label = lambda df: df.join(bad_hosts, "hk", "left").withColumn("is_bad", F.coalesce("is_bad", F.lit(0)))
    votes = [F.sum(F.col("n") * F.col("is_bad")).alias("bad"), F.sum(F.col("n") * (1 - F.col("is_bad"))).alias("good")]
    by_run = label(in_hosts).groupBy(F.lit("h:").alias("kind"), "key").agg(*votes).unionByName(label(in_paths).groupBy(F.lit("p:").alias("kind"), "key").agg(*votes))
    split = checkpoint(by_run.join(words, "key").select("kind", "key", "bad", "good", F.explode("words").alias("w")).withColumn("token", F.concat("kind", "w")))
    weights = checkpoint(token_weights(split.groupBy("token").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))))
    by_run = checkpoint(split.join(weights, "token").groupBy("kind", "key").agg(F.sum("weight").alias("weight")))

    of = lambda kind: by_run.where(F.col("kind") == kind).select("key", "weight")
    host_score = checkpoint(in_hosts.join(of("h:"), "key").groupBy("hk").agg(F.sum("weight").alias("host_score")))
    path_score = checkpoint(in_paths.join(of("p:"), "key").groupBy("pair").agg(F.sum("weight").alias("path_score")))
    docs = label(hosts).agg(*votes).first()
    prior = log(((docs.bad or 0) + 1) / ((docs.good or 0) + 1))
    total = F.lit(prior) + F.coalesce("host_score", F.lit(0.0)) + F.coalesce("path_score", F.lit(0.0))
    return urls.join(host_score, "hk", "left").join(path_score, "pair", "left").select("host", "path", F.round(total, 9).alias("score"))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """One row per page: id, ``host``, ``path``, ``rule``, ``verdict``, ``score``.

    Null urls and urls without ``://`` have empty host and path, fit no rule and score by the prior alone (allow
    unless most rows are unwanted). Repeated rows are judged alike, other columns are ignored, an empty table gives none.
    Counts, segmentation and scores cover all words of all urls, each different host, path, run and token once.
    """
    parts = url_parts(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))).select("page_id", "host", "path")
    ruled = join_skewed(parts, url_scores(parts), ["host", "path"]).withColumn("r", rule_column(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("score") > 0, "block").otherwise("allow")
    return ruled.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", method).alias("verdict"), "score")

"""Registration of queries, and the driver tables seen as the library's inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Catalog:
    """Queries by name, with the SQL that gives the same rows where SQL can."""

    def __init__(self):
        self.QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.ORACLE: dict[str, str] = {}

    def add(self, sql: str | None = None):
        def keep(f):
            self.QUERIES[f.__name__] = f
            if sql:
                self.ORACLE[f.__name__] = sql
            return f

        return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def news_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as captured news: title and description from the text, one date a day over 400 days."""
    d = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    return d.select(
        F.substring_index(text, "\n", 1).alias("title"),
        F.substring(text, 1, 300).alias("desc"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(400)).cast("int")), "yyyy-MM-dd").alias("date"),
        F.when(F.pmod("doc_id", F.lit(3)) == 0, "").otherwise(F.col("source")).alias("source"),
        F.col("source").alias("query"),
        F.concat(F.lit("http://news.example/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("link"),
        "lang",
        F.col("doc_id").alias("seq"),
    )


NEWS_SQL = """news AS (
  SELECT split_part(coalesce(text, ''), chr(10), 1) AS title, substr(coalesce(text, ''), 1, 300) AS "desc",
         strftime(DATE '2024-01-01' + CAST(doc_id % 400 AS INTEGER), '%Y-%m-%d') AS date,
         CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS source, source AS query,
         'http://news.example/' || source || '/' || doc_id AS link, lang, doc_id AS seq
  FROM documents)"""

#: Rules of the sample bindings: words of the tables' invented prose.
ORG_ANY = ("th tion", "ungung", "tionré", "ciónra")
ORG_QUERIES = ("src3", "src7")
SITE_PLACE = ("andthe", "isthe", "derein", "dela")
SITE_WITH = ("of", "und", "le", "os")
TOPICS = {"org": (("money", ("ertion", "enheit")), ("people", ("hea", "ver"))), "site": (("roads", ("thtion", "ung")), ("plans", ("ing", "ment")), ("water", ("ou", "ch")))}

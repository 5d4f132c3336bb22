"""Readers and writers of the library's records: JSON stores, feeds, GeoJSON, CSV, status files and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import feed_when, split_title, strip_html, strip_html_spaced

def read_records(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON arrays of objects, absent fields null."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def _kinds_of(items, item: str, kinds: tuple[str, ...]):
    """The rows of all kinds of a store's ``items``, each with its kind."""

    def marked(kind: str):
        rows = F.coalesce(items[kind], F.array().cast(f"array<struct<{item}>>"))
        return F.transform(rows, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("r")))

    return F.flatten(F.array(*[marked(k) for k in kinds]))


def _items_ddl(item: str, kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:array<struct<{item}>>" for k in kinds)


def read_nested_store(spark: SparkSession, path: str, item: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """``{"posts": [...]}`` stores, or ``{"items": {kind: [...]}}`` stores with a ``kind`` column; ``item`` is the DDL of a row."""
    if kinds is None:
        return spark.read.option("multiLine", True).schema(f"posts array<struct<{item}>>").json(path).select(F.inline("posts"))
    store = spark.read.option("multiLine", True).schema(f"items struct<{_items_ddl(item, kinds)}>").json(path)
    return store.select(F.explode(_kinds_of(F.col("items"), item, kinds)).alias("p")).select("p.kind", "p.r.*")


def parse_nested_store(stores: DataFrame, raw: str, item: str, kinds: tuple[str, ...]) -> DataFrame:
    """The same from a column of captured stores, other columns kept."""
    rest = [c for c in stores.columns if c != raw]
    parsed = F.from_json(F.col(raw), f"items struct<{_items_ddl(item, kinds)}>")["items"]
    return stores.select(*rest, parsed.alias("items")).select(*rest, F.explode(_kinds_of(F.col("items"), item, kinds)).alias("p")).select(*rest, "p.kind", "p.r.*")


def parse_feeds(payloads: DataFrame, raw: str = "raw") -> DataFrame:
    """Entries of captured RSS 2.0 and Atom payloads: ``text`` (title and description, 400 at most), ``iso``, ``href`` and ``pos``; RSS items before Atom entries."""
    rss = F.from_xml(F.col(raw), "channel struct<item:array<struct<title:string,link:string,description:string,pubDate:string>>>")
    atom = F.from_xml(F.col(raw), "entry array<struct<title:string,`media:group`:struct<`media:description`:string>,updated:string,published:string,link:array<struct<_href:string>>>>")
    text = lambda title, body: F.substring(F.trim(F.concat(F.trim(F.coalesce(title, F.lit(""))), F.lit(" "), strip_html_spaced(body))), 1, 400)
    items = F.transform(F.coalesce(rss["channel"]["item"], F.array().cast("array<struct<title:string,link:string,description:string,pubDate:string>>")), lambda i: F.struct(text(i["title"], i["description"]).alias("text"), i["pubDate"].alias("iso"), i["link"].alias("href")))
    entries = F.transform(F.coalesce(atom["entry"], F.array().cast("array<struct<title:string,`media:group`:struct<`media:description`:string>,updated:string,published:string,link:array<struct<_href:string>>>>")), lambda e: F.struct(text(e["title"], e["media:group"]["media:description"]).alias("text"), F.coalesce(e["published"], e["updated"]).alias("iso"), F.try_element_at(e["link"], F.lit(1))["_href"].alias("href")))
    rest = [c for c in payloads.columns if c != raw]
    rows = payloads.select(*rest, F.posexplode(F.concat(items, entries)).alias("pos", "e")).select(*rest, "pos", "e.*")
    return rows.withColumn("when", feed_when(F.col("iso")))


def parse_news_feeds(payloads: DataFrame, raw: str = "raw") -> DataFrame:
    """News items of captured RSS payloads: title and source split, KST date, description without tags."""
    rss = F.from_xml(F.col(raw), "channel struct<item:array<struct<title:string,link:string,source:string,description:string,pubDate:string>>>")
    rest = [c for c in payloads.columns if c != raw]
    rows = payloads.select(*rest, F.posexplode(rss["channel"]["item"]).alias("pos", "i"))
    title, source = split_title(F.col("i.title"), F.coalesce("i.source", F.lit("")))
    from ..functions.text import rfc822_date

    return rows.select(*rest, "pos", title.alias("title"), F.col("i.link").alias("link"), source.alias("source"), rfc822_date(F.col("i.pubDate")).alias("date"), strip_html(F.col("i.description")).alias("desc"))


def _features(properties: str) -> str:
    return f"features array<struct<properties:struct<{properties}>,geometry:struct<type:string,coordinates:string>>>"


def _polygons(geometry):
    ring = "array<array<array<double>>>"
    return F.when(geometry["type"] == "MultiPolygon", F.from_json(geometry["coordinates"], f"array<{ring}>")).when(geometry["type"] == "Polygon", F.array(F.from_json(geometry["coordinates"], ring)))


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """One row a feature: its properties and its polygons as poly -> ring -> [x, y]; a Polygon counts as one polygon."""
    rows = spark.read.option("multiLine", True).schema(_features(properties)).json(path).select(F.posexplode("features").alias("feature_id", "f"))
    return rows.select("feature_id", "f.properties.*", _polygons(F.col("f.geometry")).alias("polys"))


def parse_geojson(collections: DataFrame, raw: str, properties: str) -> DataFrame:
    """The same from a column of captured collections, other columns kept."""
    rest = [c for c in collections.columns if c != raw]
    rows = collections.select(*rest, F.posexplode(F.from_json(F.col(raw), _features(properties))["features"]).alias("feature_id", "f"))
    return rows.select(*rest, "feature_id", "f.properties.*", _polygons(F.col("f.geometry")).alias("polys"))


POINTS = "label string, lat double, lng double, note string"


def read_points_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(POINTS).csv(path)


def parse_points_csv(lines: DataFrame, raw: str) -> DataFrame:
    rest = [c for c in lines.columns if c != raw]
    return lines.select(*rest, F.from_csv(F.col(raw), POINTS).alias("p")).select(*rest, "p.*")


#: Options of the two CSV forms.
QUOTED = {"quoteAll": "true", "escape": '"'}
MINIMAL = {"escape": '"'}


def csv_line(columns, options: dict):
    """One row as it stands in the file."""
    return F.to_csv(F.struct(*columns), options)


def write_snapshot(rows: DataFrame, path: str, updated: str) -> None:
    """Rows as JSON beside a one-row file of ``updated`` and ``total``."""
    rows.write.mode("overwrite").json(f"{path}/rows")
    rows.agg(F.lit(updated).alias("updated"), F.count("*").alias("total")).write.mode("overwrite").json(f"{path}/meta")


def status(rows: DataFrame, key: str, title: str, updated: str, metrics: dict[str, tuple]) -> DataFrame:
    """One row ``key, title, updated, metrics``; ``metrics`` maps a label to (aggregate, unit)."""
    made = F.array(*[F.struct(F.lit(label).alias("label"), value.cast("long").alias("value"), F.lit(unit).alias("unit")) for label, (value, unit) in metrics.items()])
    return rows.agg(made.alias("metrics")).select(F.lit(key).alias("key"), F.lit(title).alias("title"), F.lit(updated).alias("updated"), "metrics")


def write_csv_quoted(rows: DataFrame, path: str) -> None:
    """All fields quoted, quotes doubled, CRLF line ends."""
    rows.write.mode("overwrite").option("header", True).options(**QUOTED).option("lineSep", "\r\n").csv(path)


def write_csv_minimal(rows: DataFrame, path: str) -> None:
    """Quotes only where needed; list cells become lines."""
    rows.select(*joined_lists(rows)).write.mode("overwrite").option("header", True).options(**MINIMAL).csv(path)


def joined_lists(rows: DataFrame) -> list:
    """The columns of ``rows``, lists of strings as lines of one cell."""
    return [F.array_join(c, "\n").alias(c) if t.startswith("array<string") else F.col(c) for c, t in rows.dtypes]


def write_sheets(sheets: dict[str, DataFrame], path: str) -> None:
    """One Parquet table a sheet."""
    for name, rows in sheets.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")

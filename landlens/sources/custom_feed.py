"""User-supplied feeds as a Spark data source: ``fetch(account) -> rows`` of a fixed shape, one partition an account."""

from __future__ import annotations

import importlib

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "account string, text string, iso string, url string"


class Account(InputPartition):
    def __init__(self, name: str):
        self.name = name


class FeedReader(DataSourceReader):
    def __init__(self, options):
        self.module, self.accounts = options["module"], [a for a in options.get("accounts", "").split(",") if a]

    def partitions(self):
        return [Account(a) for a in self.accounts]

    def read(self, partition):
        fetch = importlib.import_module(self.module).fetch
        for row in fetch(partition.name):
            yield (partition.name, row.get("text", ""), row.get("iso", ""), row.get("url", ""))


class CustomFeed(DataSource):
    """``spark.dataSource.register(CustomFeed)``, then ``spark.read.format("custom_feed").option("module", ...)``."""

    @classmethod
    def name(cls):
        return "custom_feed"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FeedReader(self.options)

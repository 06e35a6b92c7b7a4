"""A paged REST feed as a Spark data source: one partition for each calendar month, read on executors."""

from __future__ import annotations

import calendar
import datetime as dt
import json
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def add_months(day: dt.date, months: int) -> dt.date:
    """The same day some months on, or the month's last day if it has no such day."""
    n = day.year * 12 + day.month - 1 + months
    year, month = divmod(n, 12)
    return dt.date(year, month + 1, min(day.day, calendar.monthrange(year, month + 1)[1]))


def months(start: dt.date, end: dt.date) -> Iterator[tuple[dt.date, dt.date]]:
    """(first day, last day) of the calendar months that start to end, both included, lies in."""
    while start <= end:
        last = dt.date(start.year, start.month, calendar.monthrange(start.year, start.month)[1])
        yield start, min(last, end)
        start = last + dt.timedelta(days=1)


def pages(url: str, get=None) -> Iterator[dict]:
    """Items of a feed's pages: {"items": [...], "links": [{"rel": "next", "href": ...}]}, until no page names a next one."""
    get = get or (lambda u: json.load(urllib.request.urlopen(u, timeout=60)))
    while url:
        page = get(url)
        yield from page.get("items") or []
        url = next((x.get("href") for x in page.get("links") or [] if x.get("rel") == "next"), None)


class Month(InputPartition):
    def __init__(self, first: dt.date, last: dt.date):
        super().__init__(f"{first}..{last}")
        self.first, self.last = first, last


class FeedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.options = schema.names, options

    def partitions(self) -> list[Month]:
        return [Month(a, b) for a, b in months(dt.date.fromisoformat(self.options["start"]), dt.date.fromisoformat(self.options["end"]))]

    def read(self, partition: Month) -> Iterator[tuple]:
        asked = urllib.parse.urlencode({self.options.get("from", "from"): partition.first, self.options.get("to", "to"): partition.last})
        for item in pages(f"{self.options['url']}{'&' if '?' in self.options['url'] else '?'}{asked}"):
            yield tuple(None if item.get(n) is None else str(item[n]) for n in self.names)


class Feed(DataSource):
    """Options: url, start, end (ISO days), from and to (parameter names). All columns are text; cast what you need."""

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return "datetime string"

    def reader(self, schema: StructType) -> FeedReader:
        return FeedReader(schema, dict(self.options))


def read_feed(spark: SparkSession, url: str, schema: str, start: str, end: str, **names: str) -> DataFrame:
    """Distinct rows of the feed from start to end."""
    spark.dataSource.register(Feed)
    return spark.read.format("feed").schema(schema).options(url=url, start=start, end=end, **names).load().distinct()

"""Records and their comments: landed pages, and a data source that pages through an HTTP interface.

The data source plans its pages from the total that the first request reports and deals them to partitions, so they are
fetched in parallel by the executors; a retry policy sits inside the reader, as a task retry would fetch the pages anew.
"""

from __future__ import annotations

import json
import urllib.parse
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions import fixed
from .fetching import Server, auth_header

RECORD = "issue_key string, id string, fields string"


def landed_pages(spark: SparkSession, path: str) -> DataFrame:
    """Records of search pages kept as JSON files (one page per file); fields stay JSON text, as they have no fixed shape."""
    whole = spark.read.text(path, wholetext=True)
    issues = F.from_json(F.get_json_object("value", "$.issues"), "array<string>")
    one = whole.select(F.explode(issues).alias("issue"))
    return one.select(F.get_json_object("issue", "$.key").alias("issue_key"), F.get_json_object("issue", "$.id").alias("id"), F.get_json_object("issue", "$.fields").alias("fields"))


def landed_comments(spark: SparkSession, path: str) -> DataFrame:
    """issue_key, pos, comment (JSON text) of comment pages kept as JSON files below folders ``issue_key=<key>``."""
    whole = spark.read.text(path, wholetext=True)
    each = F.from_json(F.get_json_object("value", "$.comments"), "array<string>")
    start = F.coalesce(F.get_json_object("value", "$.startAt").cast("long"), F.lit(0))
    return whole.select(F.col("issue_key").cast("string").alias("issue_key"), start.alias("start"), F.posexplode(each).alias("at", "comment")).select("issue_key", (F.col("start") + F.col("at")).alias("pos"), "comment")


def field_list(text: str) -> list[str]:
    """Field names of a comma-separated list."""
    return [name.strip() for name in text.split(",") if name.strip()]


class Pages(InputPartition):
    """Pages that one task asks for, one after the other: (start, records wanted) each; a stream's also have the query of their batch."""

    def __init__(self, pages: list[tuple[int, int]], query: str = ""):
        self.pages, self.query = pages, query


class RecordReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url = options["url"].rstrip("/")
        self.query, self.size = options.get("query", ""), int(options.get("pageSize", "50"))
        self.most, self.tasks = int(options.get("maxRecords", "0")), int(options.get("concurrency", "0"))
        self.names = field_list(options.get("fields", ""))
        self.server = Server(self.url, auth_header(options.get("token", ""), options.get("email", "")), proxy=options.get("noProxy", "false") != "true")

    def page_url(self, start: int, size: int) -> str:
        asked = {"jql": self.query, "startAt": start, "maxResults": size, **({"fields": ",".join(self.names)} if self.names else {})}
        return f"{self.url}?{urllib.parse.urlencode(asked)}"

    def partitions(self) -> list[Pages]:
        total = int(self.server.json(self.page_url(0, 1)).get("total", 0))
        wanted = min(total, self.most) if self.most else total
        pages = [(start, min(self.size, wanted - start)) for start in range(0, wanted, self.size)]
        tasks = min(self.tasks or len(pages), len(pages))
        return [Pages(pages[i::tasks]) for i in range(tasks)]

    def read(self, part: Pages | None) -> Iterator[tuple]:
        for start, take in part.pages if part else ():  # without records there are no partitions, which Spark reads as a single None
            for issue in self.server.json(self.page_url(start, self.size)).get("issues", [])[:take]:
                yield issue.get("key", ""), str(issue.get("id", "")), json.dumps(issue.get("fields", {}), sort_keys=True)


MINUTE = "%Y-%m-%d %H:%M"


class RecordStream(DataSourceStreamReader):
    """Records as a stream: an offset is the minute up to which their updates were asked for.

    A micro-batch asks for those updated since a few minutes before its start, as a server may show a record late; so records come
    more than once, with the same time of update. ``since`` is where a first batch begins, ``clock`` a minute that stands for now.
    """

    def __init__(self, options: dict):
        self.options = {**options}
        self.since, self.clock = options.get("since", "1970-01-01 00:00"), options.get("clock", "")

    def initialOffset(self) -> dict:
        return {"minute": self.since}

    def latestOffset(self) -> dict:
        return {"minute": self.clock or f"{datetime.now(UTC):{MINUTE}}"}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        if start["minute"] >= end["minute"]:
            return []
        back = datetime.strptime(start["minute"], MINUTE) - timedelta(minutes=fixed.OVERLAP_MINUTES)
        query = f'({self.options.get("query", "")}) AND updated >= "{back:{MINUTE}}" AND updated < "{end["minute"]}"'
        return [Pages(part.pages, query) for part in RecordReader({**self.options, "query": query}).partitions()]

    def read(self, part: Pages) -> Iterator[tuple]:
        return RecordReader({**self.options, "query": part.query}).read(part)

    def commit(self, end: dict) -> None:
        """Nothing is kept on the server."""


class RecordSource(DataSource):
    """``spark.read.format("paged-records").option("url", ...)`` after ``spark.dataSource.register(RecordSource)``.

    ``concurrency`` bounds the requests in flight: the pages are dealt to as many partitions. Without it, each page is a partition.
    ``spark.readStream`` reads the same source as a stream of updates.
    """

    @classmethod
    def name(cls) -> str:
        return "paged-records"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options)

    def streamReader(self, schema) -> RecordStream:
        return RecordStream(self.options)

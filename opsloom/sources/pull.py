"""Rows of an HTTP API that is read by a cursor, as a batch and as a stream.

The API gives JSON rows in ascending order of a field, those after a given value,
a page at a time; asked in descending order it tells the newest value. An offset
is a value of that field. Tasks ask for ranges between offsets themselves, so a
batch that is run again asks for the same range, and the driver only ever asks
for the newest value.

    spark.dataSource.register(PullSource)
    spark.readStream.format("pull").option("url", "http://host/rows").option("cursor", "id").load()
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Rows of a page, ranges that an integer cursor is split into, and seconds that a request may take.
PAGE, RANGES, SECONDS = 1000, 8, 30
#: Names of the parameters of a request, as options: the value after which rows are wanted, how many, and the order.
NAMES = {"after": "after", "limit": "limit", "order": "order"}
SCHEMA = "cursor string, body string"


class Range(InputPartition):
    """Rows after `low` up to and with `high`; null is no bound below."""

    def __init__(self, low, high):
        super().__init__(None)
        self.low, self.high = low, high


def dig(document, path: str):
    """What lies at a dotted path of a JSON document; numbers are places of a list."""
    for part in [p for p in path.split(".") if p]:
        document = document[int(part)] if isinstance(document, list) else document[part]
    return document


class _Api:
    """One source: how it is asked and what its rows are."""

    def __init__(self, options: dict):
        self.url, self.cursor, self.rows = options["url"], options["cursor"], options.get("rows", "")
        self.page, self.ranges = int(options.get("page", PAGE)), int(options.get("ranges", RANGES))
        self.names = {k: options.get(k, v) for k, v in NAMES.items()}
        self.token = options.get("authorization")
        if urllib.parse.urlsplit(self.url).scheme not in ("http", "https"):
            raise ValueError("a source is asked by http or https")

    def ask(self, after, limit: int, order: str = "asc") -> list:
        fields = {self.names["limit"]: limit, self.names["order"]: order} | ({} if after is None else {self.names["after"]: after})
        request = urllib.request.Request(f"{self.url}{'&' if '?' in self.url else '?'}{urllib.parse.urlencode(fields)}", headers={"Authorization": self.token} if self.token else {})
        with urllib.request.urlopen(request, timeout=SECONDS) as answer:
            return dig(json.load(answer), self.rows)

    def at(self, row):
        return dig(row, self.cursor)

    def newest(self):
        """The greatest value of the cursor; null while there are no rows."""
        found = self.ask(None, 1, "desc")
        return self.at(found[0]) if found else None

    def between(self, low, high) -> Iterator[tuple]:
        """Rows after `low` up to `high`, page by page.

        A full page may end inside a group of rows with one value, of which the
        next page would give none: that group is left to the next page, and a page
        that holds nothing else is asked for twice as long.
        """
        limit = self.page
        while high is not None:
            rows = self.ask(low, limit)
            full = len(rows) >= limit
            last = self.at(rows[-1]) if rows else None
            whole = [r for r in rows if self.at(r) != last] if full else rows
            if full and not whole:
                limit *= 2
                continue
            for r in whole:
                if self.at(r) <= high:
                    yield str(self.at(r)), json.dumps(r, ensure_ascii=False)
            if not full or self.at(whole[-1]) >= high:
                return
            low, limit = self.at(whole[-1]), self.page

    def split(self, low, high) -> list[Range]:
        """Ranges that tasks ask for side by side: equal ones of an integer cursor with a known beginning, else one."""
        if high is None or low == high:
            return []
        if isinstance(low, int) and isinstance(high, int) and high - low > self.ranges:
            edges = [low + (high - low) * k // self.ranges for k in range(self.ranges + 1)]
            return [Range(a, b) for a, b in zip(edges, edges[1:])]
        return [Range(low, high)]


class _Batch(DataSourceReader):
    def __init__(self, api: _Api, start):
        self.api, self.start = api, start

    def partitions(self):
        return self.api.split(self.start, self.api.newest())

    def read(self, partition):
        yield from self.api.between(partition.low, partition.high) if partition else ()


class _Stream(DataSourceStreamReader):
    def __init__(self, api: _Api, start):
        self.api, self.start = api, start

    def initialOffset(self):
        return {"cursor": self.start}

    def latestOffset(self):
        return {"cursor": self.api.newest()}

    def partitions(self, start, end):
        return self.api.split(start["cursor"], end["cursor"])

    def read(self, partition):
        yield from self.api.between(partition.low, partition.high)


class PullSource(DataSource):
    """Rows (cursor, body) of an API.

    Options: url, cursor (path of the ordered field in a row), rows (path of the
    list in an answer), page, ranges, start (an integer or a text), authorization,
    and after, limit and order for the names of the request's parameters. Rows
    that appear later with a value that has been passed aren't seen: the field must
    grow with arrival.
    """

    @classmethod
    def name(cls):
        return "pull"

    def schema(self):
        return SCHEMA

    def _start(self):
        value = self.options.get("start")
        return int(value) if value is not None and value.lstrip("-").isdigit() else value

    def reader(self, schema):
        return _Batch(_Api(dict(self.options)), self._start())

    def streamReader(self, schema):
        return _Stream(_Api(dict(self.options)), self._start())

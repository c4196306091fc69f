"""Polling sources as Python data sources: a relational query, a key of a key-value store, a search index.

The client is not built here: options name a factory as "module:function", which the reading task imports and calls
with the other options; so credentials and drivers stay outside. Factories return objects with the methods noted at
each source.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader


def client_of(options: dict):
    module, _, name = options["client"].partition(":")
    return getattr(importlib.import_module(module), name)(dict(options))


class _Poll(SimpleDataSourceStreamReader):
    """One poll a trigger; what a poll gave is kept until it is committed.

    After a restart nothing is kept, and a range of offsets is read again as one query between its ends: `replay`.
    """

    def __init__(self, options: dict):
        self.options, self.given = options, {}

    def initialOffset(self) -> dict:
        return {"poll": 0, "after": self.options.get("after", "")}

    def poll(self, start: dict) -> tuple[list[tuple], str]:
        raise NotImplementedError

    def replay(self, start: dict, end: dict) -> list[tuple]:
        """What lies between two offsets; sources that keep no history give what they hold now, once."""
        return self.poll(start)[0]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        found, after = self.poll(start)
        end = {"poll": start["poll"] + 1, "after": after}
        self.given[start["poll"]] = found
        return iter(found), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        wanted = range(start["poll"], end["poll"])
        if all(n in self.given for n in wanted):
            return iter([row for n in wanted for row in self.given[n]])
        return iter(self.replay(start, end) if wanted else [])

    def commit(self, end: dict) -> None:
        self.given = {k: v for k, v in self.given.items() if k >= end["poll"]}


class TablePoll(_Poll):
    def order(self, row: tuple) -> tuple:
        """Numbers by size, before texts by their characters; null is before all."""
        value = row[int(self.options.get("incremental_index", 0))]
        return ordered(value)

    def poll(self, start):
        client, column = client_of(self.options), self.options.get("incremental")
        if column is None:
            return [tuple(r) for r in client.query(self.options["query"], None)], ""
        found = [tuple(r) for r in client.query(self.options["query"], start["after"] or None)]
        at = int(self.options.get("incremental_index", 0))
        return found, str(max(found, key=self.order)[at]) if found else start["after"]

    def replay(self, start, end):
        found = self.poll(start)[0]
        if self.options.get("incremental") is None:
            return found
        if not end["after"] or end["after"] == start["after"]:
            return []
        return [r for r in found if self.order(r) <= ordered(end["after"])]


def ordered(value) -> tuple:
    """A key that orders values, and offsets written as text, alike."""
    if value is None or value == "":
        return (0, 0, "")
    try:
        return (1, float(value), "")
    except (TypeError, ValueError):
        return (2, 0, str(value))


class PollingTable(DataSource):
    """format("polling_table"): options client, query, schema; with `incremental` (a column) and `incremental_index`, only rows beyond the last poll.

    Client: query(sql, after) -> rows; `after` is the largest value seen, or None. Without `incremental` every poll gives all rows.
    """

    @classmethod
    def name(cls):
        return "polling_table"

    def schema(self):
        return self.options["schema"]

    def simpleStreamReader(self, schema):
        return TablePoll(dict(self.options))


class KeyPoll(_Poll):
    def poll(self, start):
        value = client_of(self.options).get(self.options.get("key", "user"))
        if value is None:
            if self.options.get("missing", "error") == "error":
                raise KeyError(self.options.get("key", "user"))
            return [], ""
        return [(self.options.get("key", "user"), value.decode() if isinstance(value, bytes) else str(value))], ""


class PollingKey(DataSource):
    """format("polling_key"): options client, key, missing (error or skip). Client: get(key) -> text, bytes or None."""

    @classmethod
    def name(cls):
        return "polling_key"

    def schema(self):
        return "key string, value string"

    def simpleStreamReader(self, schema):
        return KeyPoll(dict(self.options))


class _Slice(InputPartition):
    pass


class SearchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [_Slice(i) for i in range(int(self.options.get("slices", 1)))]

    def read(self, partition):
        size, slices = int(self.options.get("size", 1000)), int(self.options.get("slices", 1))
        client = client_of(self.options)
        for hit in client.search(self.options["index"], json.loads(self.options.get("query", "{}")), size, partition.value, slices):
            yield (json.dumps(hit, sort_keys=True),)


class SearchIndex(DataSource):
    """format("search_index"): options client, index, query (JSON), size, slices. Each hit is one JSON text.

    Client: search(index, query, size, slice, slices) -> hits; `size` bounds the hits of a slice.
    """

    @classmethod
    def name(cls):
        return "search_index"

    def schema(self):
        return "value string"

    def reader(self, schema):
        return SearchReader(dict(self.options))


def register(spark: SparkSession) -> None:
    for source in (PollingTable, PollingKey, SearchIndex):
        spark.dataSource.register(source)

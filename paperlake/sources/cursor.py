"""A paged source with a cursor: batch and stream readers over any fetch function, resumable by Spark's checkpoint.

``fetch(cursor, filters, per_page)`` returns (records, next cursor or None). The cursor is the stream's offset, so a
restart goes on where the last committed page ended; another filter is another offset log.
"""

from __future__ import annotations

import importlib
import json

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, SimpleDataSourceStreamReader

FIRST, PER_PAGE, COUNT = "*", 25, 1000
BASE_FILTER = "has_doi:true,type:article"
#: Parameters that are sent by name; all others become terms of the filter.
NAMED = ("search", "sort", "mailto", "select", "sample", "seed")


def parameters(options: dict) -> dict:
    """Request parameters: known names as they are, the rest appended to the base filter as name:value."""
    own = {k: v for k, v in options.items() if k in NAMED}
    terms = [BASE_FILTER, *[f"{k}:{v}" for k, v in sorted(options.items()) if k not in NAMED]]
    return own | {"filter": ",".join(terms)}


def synthetic(cursor: str, filters: dict, per_page: int):
    """Made-up works, 60 of them, for tests and demonstrations."""
    start = 0 if cursor == FIRST else int(cursor)
    rows = [{"id": f"W{n}", "title": f"Work {n}", "cited_by_count": n % 7} for n in range(start, min(start + per_page, 60))]
    return rows, str(start + per_page) if start + per_page < 60 else None


def _fetch(path: str):
    module, _, name = path.rpartition(".")
    return getattr(importlib.import_module(module), name)


class _Pages:
    def __init__(self, options: dict):
        o = {k.lower(): v for k, v in options.items()}
        self.fetch = _fetch(o.pop("fetch")) if "fetch" in o else synthetic
        self.per_page, self.count = int(o.pop("perpage", PER_PAGE)), int(o.pop("count", COUNT))
        o.pop("path", None)
        o.pop("pushdown", None)
        self.filters = parameters(o)

    def rows(self, records):
        return [(r.get("id"), r.get("title"), r.get("cited_by_count"), json.dumps(r)) for r in records]


class _Batch(DataSourceReader, _Pages):
    def read(self, partition):
        cursor, n = FIRST, 0
        while cursor is not None and n < self.count:
            records, cursor = self.fetch(cursor, self.filters, self.per_page)
            for row in self.rows(records)[: self.count - n]:
                n += 1
                yield row


class _PushingBatch(_Batch):
    """For sessions with spark.sql.python.filterPushdown.enabled, by the option pushdown=true."""

    def pushFilters(self, filters):
        """Equality tests on a column go to the request; all are checked again by Spark."""
        for f in filters:
            if isinstance(f, EqualTo):
                self.filters["filter"] += f",{'.'.join(f.attribute)}:{f.value}"
            yield f


class _Stream(SimpleDataSourceStreamReader, _Pages):
    def initialOffset(self):
        return {"cursor": FIRST, "fetched": 0}

    def read(self, start):
        if start["cursor"] is None or start["fetched"] >= self.count:
            return iter([]), start
        records, following = self.fetch(start["cursor"], self.filters, self.per_page)
        records = records[: self.count - start["fetched"]]
        return iter(self.rows(records)), {"cursor": following, "fetched": start["fetched"] + len(records)}

    def readBetweenOffsets(self, start, end):
        out = []
        while start != end:
            rows, start = self.read(start)
            out += list(rows)
        return iter(out)


class CursorSource(DataSource):
    @classmethod
    def name(cls):
        return "paged"

    def schema(self):
        return "id string, title string, cited_by_count bigint, raw string"

    def reader(self, schema):
        pushing = self.options.get("pushdown", "false").lower() == "true"
        return _PushingBatch(self.options) if pushing else _Batch(self.options)

    def simpleStreamReader(self, schema):
        return _Stream(self.options)

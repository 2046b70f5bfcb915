"""A data source of listing pages: one JSON file a page in one folder a stock; a page is a partition.

    spark.dataSource.register(ListingPages)
    spark.read.format("listing_pages").option("pages_per_stock", 3).load(folder)

Equality and membership filters on stock_code, and bounds on page, choose the pages
that are read, and Spark checks all filters again; the session must have
``spark.sql.python.filterPushdown.enabled`` on.  All executors see the folder.  A stock is read up to its first missing page or its limit; a page
that isn't a JSON list of objects gives one row with ``error``.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Fields of a row, in the page's own names, and the columns that they become.
FIELDS = {"stockCode": "found_code", "indexId": "question_id", "pubDate": "published", "detailCode": "detail_code", "questionDate": "detail_date", "questionContent": "question", "replyContent": "reply"}
SCHEMA = "stock_code string, page int, place int, " + ", ".join(f"{c} string" for c in FIELDS.values()) + ", error string"


class Page(InputPartition):
    def __init__(self, stock: str, page: int, path: str):
        self.stock, self.page, self.path = stock, page, path


class ListingPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "listing_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options["path"], int(self.options.get("pages_per_stock", 0)))


class PageReader(DataSourceReader):
    def __init__(self, folder: str, limit: int):
        self.folder, self.limit, self.stocks, self.first, self.last = folder, limit, None, 1, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute if hasattr(f, "attribute") else None
            if column == ("stock_code",) and isinstance(f, (EqualTo, In)):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.stocks = asked if self.stocks is None else self.stocks & asked
            elif column == ("page",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                low = f.value + isinstance(f, GreaterThan) if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)) else self.first
                high = f.value - isinstance(f, LessThan) if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)) else self.last
                self.first, self.last = max(self.first, low), high if self.last is None else min(self.last, high)
            yield f  # Spark checks it again

    def partitions(self) -> list[Page]:
        out = []
        for stock in sorted(os.listdir(self.folder)) if self.stocks is None else sorted(s for s in self.stocks if isinstance(s, str) and os.path.isdir(os.path.join(self.folder, s))):
            page = 1
            while os.path.exists(path := os.path.join(self.folder, stock, f"{page}.json")) and (not self.limit or page <= self.limit):
                if page >= self.first and (self.last is None or page <= self.last):
                    out.append(Page(stock, page, path))
                page += 1
        return out

    def read(self, partition: Page) -> Iterator[tuple]:
        try:
            with open(partition.path, encoding="utf-8") as f:
                rows = json.load(f)
            if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
                raise ValueError("no list of objects")
        except (OSError, ValueError) as e:
            yield (partition.stock, partition.page, None, *[None] * len(FIELDS), f"{type(e).__name__}: {e}")
            return
        text = lambda x: x if x is None or isinstance(x, str) else json.dumps(x, ensure_ascii=False)
        for place, r in enumerate(rows):
            yield (partition.stock, partition.page, place, *[text(r.get(k)) for k in FIELDS], None)

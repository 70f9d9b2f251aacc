"""Ordered scans of live keys: ranges, prefixes, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewell.functions.ordering import row_numbers
from brinewell.operators.versions import snapshot


def range_scan(ops: DataFrame, low: str, high: str) -> DataFrame:
    """Live rows with low <= key <= high; the bounds reach the scan, for the key is what versions are resolved by."""
    if high < low:
        raise ValueError("the upper bound lies below the lower one")
    return snapshot(ops.where(F.col("key").between(low, high))).select("key", "value")


def prefix_scan(ops: DataFrame, prefix: str) -> DataFrame:
    return snapshot(ops.where(F.col("key").startswith(prefix))).select("key", "value")


def page(live: DataFrame, number: int, size: int) -> DataFrame:
    """The page of that number, from 1, in key order; a bounded heap in every task, no sort of the table."""
    return live.orderBy("key").offset((number - 1) * size).limit(size)


def next_page(live: DataFrame, last_key: str | None, size: int) -> DataFrame:
    """The page after a key: its cost doesn't grow with the number of pages before."""
    return (live if last_key is None else live.where(F.col("key") > last_key)).orderBy("key").limit(size)


def numbered_pages(live: DataFrame, size: int) -> DataFrame:
    """All live rows with their page number."""
    return row_numbers(live, "key", "rn").withColumn("page", F.floor((F.col("rn") - 1) / size) + 1).drop("rn")


class Pager:
    """Forward and back through a scan; the pages nearest to the present one are kept, at most so many.

    A page that is kept isn't read again; the next one begins after the last key of the present one, and going back
    beyond the pages kept runs the scan again. Only pages reach the driver.
    """

    def __init__(self, live: DataFrame, size: int, cache: int) -> None:
        self.live, self.size, self.cache = live, size, max(1, cache)
        self.number, self.pages = 0, {}

    def _show(self, number: int, rows: list) -> list:
        self.number = number
        self.pages[number] = rows
        while len(self.pages) > self.cache:
            del self.pages[max(self.pages, key=lambda n: abs(n - number))]
        return rows

    def next(self) -> list:
        kept = self.pages.get(self.number + 1)
        if kept is None:
            last = self.pages[self.number][-1]["key"] if self.number else None
            kept = next_page(self.live, last, self.size).collect()
        return self._show(self.number + 1, kept) if kept else []

    def back(self) -> list:
        if self.number <= 1:
            return []
        kept = self.pages.get(self.number - 1)
        return self._show(self.number - 1, page(self.live, self.number - 1, self.size).collect() if kept is None else kept)

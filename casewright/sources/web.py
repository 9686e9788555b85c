"""Paged metadata and documents from a service, read by partitions of pages; any URL that the standard library opens, ``file:`` among them."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: What is tried again, and how large an answer may be.
AGAIN = (408, 429, 500, 502, 503, 504)
MOST_BYTES = 32 << 20


def fetch(url: str, attempts: int = 4, timeout: float = 30.0, wait: float = 0.5, most: int = MOST_BYTES) -> bytes:
    """An answer of bounded size; transient failures are tried again, after twice the time, and no others."""
    for attempt in range(attempts):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as answer:
                data = answer.read(most + 1)
            if len(data) > most:
                raise ValueError(f"{url}: more than {most} bytes")
            return data
        except urllib.error.HTTPError as e:
            if e.code not in AGAIN or attempt + 1 == attempts:
                raise
        except (TimeoutError, urllib.error.URLError) as e:
            if isinstance(getattr(e, "reason", None), FileNotFoundError | PermissionError) or attempt + 1 == attempts:
                raise
        time.sleep(wait * 2**attempt)
    raise AssertionError


def page(payload: bytes) -> tuple[int, list[dict]]:
    """The total and the rows of a page ``{"resultcount": n, "results": [{"columns": {...}}]}``; anything else is an error. Ranks, which vary, are left out."""
    value = json.loads(payload)
    total, results = (value.get("resultcount"), value.get("results")) if isinstance(value, dict) and not value.get("message") else (None, None)
    if isinstance(total, bool) or not isinstance(total, int) or total < 0 or not isinstance(results, list):
        raise ValueError("the answer is no page of results")
    rows = []
    for r in results:
        if not isinstance(r, dict) or not isinstance(r.get("columns"), dict) or not str(r["columns"].get("itemid") or "").strip():
            raise ValueError("a result lacks its columns or its id")
        rows.append({k: v for k, v in r["columns"].items() if k != "rank"})
    return total, rows


class Page(InputPartition):
    def __init__(self, start: int):
        self.start = start


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.size = options["url"], int(options.get("pageSize", "500"))

    def _page(self, start: int) -> tuple[int, list[dict]]:
        return page(fetch(self.url.replace("{start}", str(start)).replace("{length}", str(self.size))))

    def partitions(self) -> list[Page]:
        total, _ = self._page(0)
        return [Page(s) for s in range(0, max(1, total), self.size)]

    def read(self, partition: Page) -> Iterator[tuple]:
        total, rows = self._page(partition.start)
        if len(rows) > self.size or partition.start + len(rows) > total or (not rows and partition.start < total):
            raise ValueError(f"page at {partition.start} does not fit its total {total}")
        for i, row in enumerate(rows):
            yield str(row["itemid"]), partition.start + i, total, json.dumps(row, sort_keys=True, ensure_ascii=False)


class PagedSource(DataSource):
    """Format ``paged_json``: options ``url`` with ``{start}`` and ``{length}``, and ``pageSize``. A page is a partition; retried tasks read theirs again."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "itemid string, place long, total long, record string"

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)


def paged(spark: SparkSession, url: str, page_size: int = 500) -> DataFrame:
    """``itemid, place, total, record`` of all pages."""
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged_json").option("url", url).option("pageSize", str(page_size)).load()


def valid_document(payload: bytes, kind: str) -> str | None:
    """Why a payload is no document of its kind; nothing if it is one."""
    if not payload:
        return "empty"
    if kind == "docx":
        return None if payload[:4] == b"PK\x03\x04" and b"word/document.xml" in payload else "no word-processing document"
    if kind == "html":
        return None if b"<html" in payload[:4096].lower() or b"<!doctype html" in payload[:4096].lower() else "no HTML page"
    return f"unknown kind {kind}"


def downloads(wanted: DataFrame, kind: str) -> DataFrame:
    """``itemid, status, detail, bytes, sha256, content`` of documents named by ``itemid, url``: a ledger of what was fetched, with what failed and why."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for itemid, url in zip(rows["itemid"], rows["url"], strict=True):
                try:
                    data = fetch(url)
                except (OSError, ValueError) as e:
                    yield pd.DataFrame([(itemid, "failed", str(e)[:200], 0, None, None)], columns=names)
                    continue
                fault = valid_document(data, kind)
                yield pd.DataFrame([(itemid, "invalid" if fault else "success", fault, len(data), hashlib.sha256(data).hexdigest(), None if fault else data)], columns=names)

    names = ["itemid", "status", "detail", "bytes", "sha256", "content"]
    return wanted.select("itemid", "url").mapInPandas(run, "itemid string, status string, detail string, bytes long, sha256 string, content binary")

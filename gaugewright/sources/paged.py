"""Recorded answers of a paged content interface as a Spark data source: posts, then pages, under one budget a site."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .stored import qualified, store

SCHEMA = "site string, kind string, id long, url string, title string, excerpt string, modified string, categories array<long>, tags array<long>, page int, kept boolean"
COLLECTIONS = {"post": "posts", "page": "pages"}


def _plain(field: object) -> str:
    text = field.get("rendered") if isinstance(field, dict) else None
    return re.sub(r"\s+", " ", re.sub(r"<[^>]*>", "", text)).strip() if isinstance(text, str) else ""


def _whole(values: object) -> list[int]:
    return [x for x in values if isinstance(x, int) and not isinstance(x, bool)] if isinstance(values, list) else []


def _entry(raw: object) -> tuple | None:
    """(id, url, title, excerpt, modified, categories, tags) of an item; null without a whole id and an address."""
    if not isinstance(raw, dict) or not isinstance(raw.get("id"), int) or isinstance(raw["id"], bool) or not isinstance(raw.get("link"), str):
        return None
    modified = raw.get("modified")
    return raw["id"], raw["link"], _plain(raw.get("title")), _plain(raw.get("excerpt")), modified if isinstance(modified, str) else "", _whole(raw.get("categories")), _whole(raw.get("tags"))


class Sites(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.budget, self.per_page = options["path"], int(options.get("budget", 5000)), int(options.get("perPage", 100))
        self.parts = int(options.get("partitions", 8))

    def partitions(self) -> list[Sites]:
        """Sites, dealt out; of the answers nothing is listed or read here."""
        files, folder = store(self.path)
        names = sorted(x.base_name for x in files.get_file_info(fs.FileSelector(folder)) if x.type == fs.FileType.Directory)
        return [Sites(names[k :: self.parts]) for k in range(min(self.parts, len(names)))]

    def _answer(self, name: str) -> list | None:
        """The list that a recorded answer holds; null where there is none."""
        files, folder = store(self.path)
        if files.get_file_info(f"{folder}/{name}").type == fs.FileType.NotFound:
            return None
        with files.open_input_stream(f"{folder}/{name}", compression=None) as source:
            try:
                found = json.loads(source.read())
            except ValueError:
                return None
        return found if isinstance(found, list) else None

    def read(self, partition: Sites) -> Iterator[tuple]:
        for site in partition.names:
            had = 0
            for kind, collection in COLLECTIONS.items():
                page = 0
                while had < self.budget:
                    page += 1
                    items = self._answer(f"{site}/{collection}/{page}.json")
                    for entry in filter(None, map(_entry, items or [])):
                        had += 1
                        yield site, kind, *entry, page, had <= self.budget
                    if items is None or len(items) < self.per_page:
                        break


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recorded_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


def paged(spark: SparkSession, folder: str, budget: int, per_page: int = 100, partitions: int | None = None) -> DataFrame:
    """Items of recorded answers ``folder``/site/posts|pages/n.json -> a row per item, ``kept`` if within its site's ``budget``.

    Answers are read one after the other and only while the budget lasts: posts first, then pages. A collection ends with
    an answer that is missing, no JSON list, or shorter than ``per_page``. Items without a whole id or an address are passed over
    and use no budget; items of an answer that was read but lie beyond the budget are rows with ``kept`` false.
    """
    spark.dataSource.register(PagedSource)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spark.read.format("recorded_pages").option("path", qualified(spark, folder)).option("budget", budget).option("perPage", per_page).option("partitions", n).load()

"""A data source over numbered pages of JSON records, as a paged service returns them.

Option ``pages`` is how many there are and ``template`` a path with ``{page}``; a reader partition takes a run of pages,
so pages are fetched in parallel and a lost task fetches its own again. ``fetch`` can be replaced to read a service.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from urllib.request import urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class Pages(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = [f.name for f in schema.fields]
        self.template, self.pages = options["template"], int(options["pages"])
        self.per_partition, self.tries = int(options.get("per_partition", "4")), int(options.get("tries", "3"))

    def partitions(self) -> list[InputPartition]:
        return [Pages(a, min(a + self.per_partition, self.pages)) for a in range(0, self.pages, self.per_partition)]

    def fetch(self, page: int) -> list[dict]:
        for attempt in range(self.tries):
            try:
                with urlopen(self.template.format(page=page)) as answer:  # noqa: S310  the caller names the service
                    return json.load(answer)
            except OSError:
                if attempt + 1 == self.tries:
                    raise
                time.sleep(0.1 * 2**attempt)
        return []

    def read(self, partition: Pages) -> Iterator[tuple]:
        for page in range(partition.first, partition.last):
            for record in self.fetch(page):
                yield tuple(record.get(name) for name in self.names)


class PagedSource(DataSource):
    """``spark.dataSource.register(PagedSource)``, then ``spark.read.format("quern_paged")`` with a schema."""

    @classmethod
    def name(cls) -> str:
        return "quern_paged"

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(schema, self.options)

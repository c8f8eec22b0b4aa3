"""The connector contract as a Spark data source: pages after a cursor, in batch and as a stream.

A connector is resumable. It names the pages behind a cursor (``poll``) or all
of them (``crawl``), without reading any, and reads one page wherever Spark asks
for it. Spark plans a task for each page, and a stream's checkpoint keeps the
cursor, so a run that stops goes on behind the last page it committed and a
page is taken once.

``PageSource`` is the source over a folder of immutable pages whose names sort in
the order in which they were written: a page is a Parquet file or a folder of
them. Names that begin with a dot or an underscore are not pages, so one that is
still being written is not seen.

    spark.dataSource.register(PageSource)
    spark.read.format("pages").schema(EVENTS).load(folder)                        # all of them
    spark.read.format("pages").schema(EVENTS).option("cursor", c).load(folder)    # those behind a cursor
    spark.readStream.format("pages").schema(EVENTS).load(folder)

Content whose sharing a connector cannot map is not resolvable: ``admitted``
keeps it apart, so it is never indexed.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Facts (field, value) and documents (content, mime_type, version) of a source, each with whom it is shared with.
EVENTS = (
    "kind string, source string, entity_id string, field string, value string, valid_from long, content string, mime_type string, version string, "
    "resolvable boolean, principals array<string>, groups array<string>, tags array<string>"
)
#: Before the first page.
START = ""


@dataclass
class Page(InputPartition):
    name: str


class Connector(ABC):
    """What a source has to offer. Cursors are names of pages; START is before all."""

    @abstractmethod
    def crawl(self) -> list[str]:
        """All pages, in order."""

    @abstractmethod
    def read(self, page: str) -> Iterator[pa.RecordBatch]:
        """The rows of a page. Runs in a task."""

    def poll(self, cursor: str, end: str | None = None) -> tuple[list[str], str]:
        """Pages behind the cursor (up to ``end``), and the cursor behind them."""
        pages = [p for p in self.crawl() if p > cursor and (end is None or p <= end)]
        return pages, pages[-1] if pages else cursor


class Folder(Connector):
    """Pages of a folder on any store that pyarrow opens (a path, file:, hdfs:, s3:)."""

    def __init__(self, path: str, schema: StructType):
        self.path, self.names = path, schema.fieldNames()
        from pyspark.sql.pandas.types import to_arrow_schema

        self.schema = to_arrow_schema(schema)

    def _open(self):
        from pyarrow import fs

        if "://" in self.path or self.path.startswith("file:"):
            return fs.FileSystem.from_uri(self.path.replace("file:/", "file:///", 1) if self.path.startswith("file:/") and not self.path.startswith("file://") else self.path)
        return fs.LocalFileSystem(), self.path

    def crawl(self) -> list[str]:
        from pyarrow import fs

        store, base = self._open()
        return sorted(f.base_name for f in store.get_file_info(fs.FileSelector(base)) if not f.base_name.startswith((".", "_")))

    def read(self, page: str) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        store, base = self._open()
        rows = ds.dataset(f"{base}/{page}", filesystem=store, format="parquet", schema=self.schema)
        for batch in rows.to_batches(columns=self.names):
            if batch.num_rows:
                yield batch


class _Batch(DataSourceReader):
    def __init__(self, connector: Connector, cursor: str):
        self.connector, self.cursor = connector, cursor

    def partitions(self) -> list[Page]:
        # Spark asks at least one task to read; a page without a name has no rows
        return [Page(p) for p in self.connector.poll(self.cursor)[0]] or [Page(START)]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        return self.connector.read(partition.name) if partition.name else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, connector: Connector, cursor: str):
        self.connector, self.cursor = connector, cursor

    def initialOffset(self) -> dict:
        return {"cursor": self.cursor}

    def latestOffset(self) -> dict:
        pages = self.connector.crawl()
        return {"cursor": max(pages[-1], self.cursor) if pages else self.cursor}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return [Page(p) for p in self.connector.poll(start["cursor"], end["cursor"])[0]]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        return self.connector.read(partition.name)

    def commit(self, end: dict) -> None:
        """Nothing is held for pages that were taken: they are the folder's own."""


class PageSource(DataSource):
    """Options: path; cursor, behind which reading begins (all pages without one)."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return EVENTS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(Folder(self.options["path"], schema), self.options.get("cursor", START))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(Folder(self.options["path"], schema), self.options.get("cursor", START))


def pages(spark: SparkSession, path: str, cursor: str = START, stream: bool = False, schema: str = EVENTS) -> DataFrame:
    """The pages of a folder behind a cursor."""
    spark.dataSource.register(PageSource)
    reader = spark.readStream if stream else spark.read
    return reader.format("pages").schema(schema).option("cursor", cursor).load(path)


def write_pages(rows: DataFrame, page: str, path: str) -> None:
    """Adds pages to a folder, one for each value of the column ``page``, a number; pages of later calls must have greater ones."""
    named = rows.withColumn("page", F.lpad(F.col(page).cast("string"), 12, "0"))
    # dealt by page and a salt, so that a page of any size is written by several tasks
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(8))
    named.repartition("page", salt).write.mode("append").partitionBy("page").parquet(path)


def admitted(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what may be indexed, what is held in quarantine): a row whose sharing could not be mapped is never seen."""
    ok = F.coalesce(F.col("resolvable"), F.lit(False))
    return events.where(ok), events.where(~ok)

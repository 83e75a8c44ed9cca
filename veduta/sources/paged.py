"""A table read page by page: a data source whose pages are the row groups of Parquet files.

Filters on numbers, texts and dates are pushed to the pages' statistics, so pages outside a range are never opened;
as a stream, the source reads the pages that are new and its offset is the number of pages read."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType


@dataclass
class Page(InputPartition):
    """One row group of one file, and the bounds that its rows must satisfy."""

    file: str
    group: int
    bounds: tuple = ()


@dataclass(frozen=True)
class Bound:
    """A lower or upper bound of a column; ``strict`` leaves the value itself out."""

    column: str
    low: Any = None
    high: Any = None
    strict: bool = False

    def may_hold(self, least: Any, most: Any) -> bool:
        if self.low is not None:
            return most > self.low if self.strict else most >= self.low
        return least < self.high if self.strict else least <= self.high

    def expression(self) -> ds.Expression:
        field = ds.field(self.column)
        if self.low is not None:
            return field > self.low if self.strict else field >= self.low
        return field < self.high if self.strict else field <= self.high


def bounds_of(filter_: Filter) -> list[Bound] | None:
    """A pushed filter as bounds; None if it is of another kind."""
    column = filter_.attribute[0] if len(getattr(filter_, "attribute", ())) == 1 else None
    value = getattr(filter_, "value", None)
    if column is None or value is None:
        return None
    kinds = {EqualTo: [Bound(column, low=value), Bound(column, high=value)], GreaterThanOrEqual: [Bound(column, low=value)], GreaterThan: [Bound(column, low=value, strict=True)], LessThanOrEqual: [Bound(column, high=value)], LessThan: [Bound(column, high=value, strict=True)]}
    return kinds.get(type(filter_))


def files_of(path: str) -> list[str]:
    """The Parquet files at a path (one file or a folder), by name."""
    return sorted(ds.dataset(path, format="parquet").files)


def pages_of(files: Iterable[str], bounds: tuple = ()) -> list[Page]:
    """The pages that may hold rows within all bounds, by their statistics; pages without statistics stay."""
    out = []
    for file in files:
        meta = pq.ParquetFile(file).metadata
        place = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
        for g in range(meta.num_row_groups):
            fits = True
            for b in bounds:
                stats = meta.row_group(g).column(place[b.column]).statistics if b.column in place else None
                fits = fits and (stats is None or not stats.has_min_max or b.may_hold(stats.min, stats.max))
            if fits:
                out.append(Page(file, g, bounds))
    return out


def read_page(page: Page, columns: list[str]) -> Iterator[pa.RecordBatch]:
    table = pq.ParquetFile(page.file).read_row_group(page.group, columns=columns)
    for b in page.bounds:
        table = table.filter(b.expression())
    yield from table.combine_chunks().to_batches()


class PagedReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.columns, self.bounds = path, schema.fieldNames(), ()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            bounds = bounds_of(f)
            if bounds is None:
                yield f
            else:
                self.bounds += tuple(bounds)

    def partitions(self) -> list[Page]:
        return pages_of(files_of(self.path), self.bounds)

    def read(self, partition: Page | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # Spark asks for one without pages where none fits
            yield from read_page(partition, self.columns)


class PagedStream(DataSourceStreamReader):
    """Reads the pages that have come since the last batch; files are taken by name, so new ones need later names."""

    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.columns = path, schema.fieldNames()

    def initialOffset(self) -> dict:
        return {"pages": 0}

    def latestOffset(self) -> dict:
        return {"pages": len(pages_of(files_of(self.path)))}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return pages_of(files_of(self.path))[start["pages"] : end["pages"]]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        yield from read_page(partition, self.columns)

    def commit(self, end: dict) -> None:
        pass


class PagedTable(DataSource):
    """``spark.read.format("paged").load(path)``; option ``columns`` (comma-separated) names those to read.
    The path is one that Python can open on all executors."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> StructType:
        whole = ds.dataset(self.options["path"], format="parquet").schema
        names = [c.strip() for c in self.options["columns"].split(",")] if self.options.get("columns") else whole.names
        return from_arrow_schema(pa.schema([whole.field(n) for n in names]))

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(self.options["path"], schema)

    def streamReader(self, schema: StructType) -> PagedStream:
        return PagedStream(self.options["path"], schema)


def register_paged(spark: SparkSession) -> None:
    """Makes the format known to a session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedTable)

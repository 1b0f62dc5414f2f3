"""A provider's folder of bars as a Spark data source, for batch and stream.

Files are ``<folder>/day=YYYY-MM-DD/series_id=ID/*.csv`` with a header (time, open, high, low,
close, volume): what a provider delivered on a day. Filters on ``day`` and ``series_id`` decide
which files are opened at all; the stream's offset is the last day delivered, and a day's files
come at once, so a day must be complete before its folder appears. Folders may be in any file
system that Arrow opens by its address. Register with ``register(spark)``, then
``spark.read.format("provider").load(folder)``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.csv
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "time timestamp, open double, high double, low double, close double, volume long, series_id string, day date"
_VALUES = [("time", pa.timestamp("us", "UTC")), *[(x, pa.float64()) for x in ("open", "high", "low", "close")], ("volume", pa.int64())]
#: What each filter asks of a value; a filter of another kind is left to Spark.
TESTS = {
    EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v,
}


class Files(InputPartition):
    """Files that one task reads: (path, day, series)."""

    def __init__(self, files: list[tuple[str, dt.date, str]]) -> None:
        super().__init__(files)


def _listed(folder: str) -> list[tuple[int, str, dt.date, str]]:
    """Files of a folder as (size, path, day, series), in order."""
    system, root = pyarrow.fs.FileSystem.from_uri(folder)
    found = []
    for info in system.get_file_info(pyarrow.fs.FileSelector(root, recursive=True, allow_not_found=True)):
        parts = dict(x.split("=", 1) for x in info.path.split("/") if "=" in x)
        if info.extension == "csv" and {"day", "series_id"} <= parts.keys():
            found.append((info.size, info.path, dt.date.fromisoformat(parts["day"]), unquote(parts["series_id"])))
    return sorted(found, key=lambda x: (x[2], x[3], x[1]))


def _dealt(files: list[tuple[int, str, dt.date, str]], most: int) -> list[Files]:
    """Files in as few tasks as hold ``most`` bytes each; a larger file has one of its own."""
    out, held, size = [], [], 0
    for bytes_, *file in files:
        if held and size + bytes_ > most:
            out.append(Files(held))
            held, size = [], 0
        held.append(tuple(file))
        size += bytes_
    return [*out, Files(held)] if held else out


def _rows(folder: str, partition: Files) -> Iterator[pa.RecordBatch]:
    """A file's rows in batches, never a whole file at once."""
    system, _ = pyarrow.fs.FileSystem.from_uri(folder)
    convert = pyarrow.csv.ConvertOptions(column_types=dict(_VALUES), include_columns=[x for x, _ in _VALUES])
    for path, day, series in partition.value:
        with system.open_input_stream(path) as stream:
            for batch in pyarrow.csv.open_csv(stream, convert_options=convert):
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([series] * n, pa.string()), pa.array([day] * n, pa.date32())], names=[*batch.schema.names, "series_id", "day"])


class ProviderReader(DataSourceReader):
    def __init__(self, folder: str, most: int) -> None:
        self.folder, self.most, self.kept = folder, most, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in TESTS and f.attribute in (("day",), ("series_id",)):
                self.kept.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        def wanted(day: dt.date, series: str) -> bool:
            return all(TESTS[type(f)]({"day": day, "series_id": series}[f.attribute[0]], f.value) for f in self.kept)

        return _dealt([x for x in _listed(self.folder) if wanted(x[2], x[3])], self.most) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _rows(self.folder, partition)


class ProviderStreamReader(DataSourceStreamReader):
    """Offsets are days: {"day": "YYYY-MM-DD"}, before the first "0001-01-01"."""

    def __init__(self, folder: str, most: int) -> None:
        self.folder, self.most = folder, most

    def initialOffset(self) -> dict:
        return {"day": dt.date.min.isoformat()}

    def latestOffset(self) -> dict:
        return {"day": max((x[2] for x in _listed(self.folder)), default=dt.date.min).isoformat()}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        after, last = dt.date.fromisoformat(start["day"]), dt.date.fromisoformat(end["day"])
        return _dealt([x for x in _listed(self.folder) if after < x[2] <= last], self.most)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _rows(self.folder, partition)


class ProviderSource(DataSource):
    """Options: ``path``, and ``task_bytes`` (64 MB), what a task reads at most."""

    @classmethod
    def name(cls) -> str:
        return "provider"

    def schema(self) -> str:
        return SCHEMA

    def _given(self) -> tuple[str, int]:
        folder = self.options["path"].removeprefix("file:")
        return ("/" + folder.lstrip("/") if folder.startswith("/") else folder), int(self.options.get("task_bytes", 64 << 20))

    def reader(self, schema) -> ProviderReader:
        return ProviderReader(*self._given())

    def streamReader(self, schema) -> ProviderStreamReader:
        return ProviderStreamReader(*self._given())


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ProviderSource)

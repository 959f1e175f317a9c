"""Touchstone files as a Spark data source: ``spark.read.format("touchstone")`` and ``df.write.format("touchstone")``.

The scan is planned from a listing: files in the order of their paths, which gives each its sample id without a sort, in
partitions of bounded bytes and number. Filters on ``path``, ``n_ports`` and ``sample_id`` leave files out before any is
opened. A schema without frequencies and matrices reads headers alone. The writer stages files and moves them when all
tasks have ended, so a failed job leaves none behind.

Folders are paths or URIs that pyarrow opens; for stores that only Spark reads there is ``read_touchstone``.
"""

from __future__ import annotations

import fnmatch
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sweeplane.operators.network import NETWORK_SCHEMA, network_fields
from sweeplane.sources.touchstone import GLOB, PORTS, format_touchstone, parse_touchstone

#: Files and bytes of one partition of a scan.
PARTITION_FILES = 256
PARTITION_BYTES = 64 << 20
#: Files that are one Arrow batch, and bytes that a header is read by.
BATCH_FILES = 64
HEADER_READ = 1 << 14
#: Columns that need a file's data lines.
DATA_COLUMNS = {"f_hz", "s_re", "s_im"}


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters reach it."""
    spark.dataSource.register(TouchstoneSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)


@dataclass(frozen=True)
class TouchstoneFile:
    sample_id: int
    path: str
    n_ports: int
    size: int


@dataclass
class Files(ds.InputPartition):
    files: list[TouchstoneFile]


@dataclass
class Written(ds.WriterCommitMessage):
    moves: list[tuple[str, str]]


def _folder(options: dict) -> str:
    folder = (options.get("path") or "").rstrip("/")
    if not folder:
        raise ValueError("a path is needed")
    return folder


class TouchstoneSource(ds.DataSource):
    """Options: ``path``, ``pathGlobFilter``; for writing ``form`` (RI, MA or DB)."""

    @classmethod
    def name(cls) -> str:
        return "touchstone"

    def schema(self) -> str:
        return NETWORK_SCHEMA

    def reader(self, schema: StructType) -> ds.DataSourceReader:
        return TouchstoneReader(_folder(self.options), self.options.get("pathGlobFilter", GLOB), schema)

    def writer(self, schema: StructType, overwrite: bool) -> ds.DataSourceWriter:
        return TouchstoneWriter(_folder(self.options), self.options.get("form", "RI"), overwrite)


_TESTS = {
    ds.EqualTo: lambda v, f: v == f.value, ds.In: lambda v, f: v in f.value, ds.GreaterThan: lambda v, f: v > f.value,
    ds.GreaterThanOrEqual: lambda v, f: v >= f.value, ds.LessThan: lambda v, f: v < f.value, ds.LessThanOrEqual: lambda v, f: v <= f.value,
    ds.StringStartsWith: lambda v, f: v.startswith(f.value), ds.StringEndsWith: lambda v, f: v.endswith(f.value), ds.StringContains: lambda v, f: f.value in v,
    ds.IsNotNull: lambda v, f: True,
}


class TouchstoneReader(ds.DataSourceReader):
    def __init__(self, folder: str, glob: str, schema: StructType) -> None:
        odd = set(schema.names) - {name for name, _ in network_fields()}
        if odd:
            raise ValueError(f"a Touchstone file has no {sorted(odd)}")
        self.folder, self.glob, self.schema, self.filters = folder, glob, schema, []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        """Keeps what a file's name decides; gives back the others."""
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("path",), ("n_ports",), ("sample_id",)):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        out, size = [Files([])], 0
        for one in self.listing():
            if all(_TESTS[type(f)](getattr(one, f.attribute[0]), f) for f in self.filters):
                if out[-1].files and (len(out[-1].files) >= PARTITION_FILES or size + one.size > PARTITION_BYTES):
                    out.append(Files([]))
                    size = 0
                out[-1].files.append(one)
                size += one.size
        return out

    def listing(self) -> list[TouchstoneFile]:
        """All files below the folder by path; none raises FileNotFoundError."""
        fs, root = _open(self.folder)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
        hidden = lambda path: any(part.startswith((".", "_")) for part in posixpath.relpath(path, root).split("/"))
        names = sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and fnmatch.fnmatchcase(f.base_name, self.glob) and not hidden(f.path))
        if not names:
            raise FileNotFoundError(f"no Touchstone file below {self.folder}")
        return [TouchstoneFile(n, path, int(PORTS.search(path)[1]), size or 0) for n, (path, size) in enumerate(names)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(self.folder)
        arrow, whole = to_arrow_schema(self.schema), bool(DATA_COLUMNS & set(self.schema.names))
        for at in range(0, len(partition.files), BATCH_FILES):
            rows = []
            for one in partition.files[at : at + BATCH_FILES]:
                with fs.open_input_stream(one.path) as f:
                    text = f.read().decode("utf-8", "replace") if whole else header_of(f)
                row = {"sample_id": one.sample_id, "path": one.path, **parse_touchstone(text, one.n_ports)}
                rows.append({c: list(row[c].items()) if isinstance(row[c], dict) else row[c] for c in self.schema.names})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)


def header_of(f: pa.NativeFile) -> str:
    """The lines of a file ahead of its first data line; hardly more than these is read."""
    lines, rest, option = [], b"", False
    while True:
        more = f.read(HEADER_READ)
        whole, _, rest = (rest + more).rpartition(b"\n") if more else (rest, b"", b"")
        for raw in whole.splitlines():
            line = raw.decode("utf-8", "replace")
            data = line.partition("!")[0].strip()
            option = option or data.startswith("#")
            if option and data and not data.startswith(("#", "[")):
                return "\n".join(lines)
            lines.append(line)
        if not more:
            return "\n".join(lines)


class TouchstoneWriter(ds.DataSourceWriter):
    def __init__(self, folder: str, form: str, overwrite: bool) -> None:
        self.folder, self.form, self.overwrite, self.staging = folder, form, overwrite, f".staging-{uuid.uuid4().hex}"
        # Made here alone: a task that is still running when its job is aborted finds no folder to write in.
        fs, root = _open(folder)
        fs.create_dir(f"{root}/{self.staging}", recursive=True)

    def write(self, rows: Iterator) -> Written:
        fs, root = _open(self.folder)
        staging, moves = f"{root}/{self.staging}", []
        for row in rows:
            one = row.asDict()
            name = f"sample_{one['sample_id']:06d}.s{one['n_ports']}p"
            part = f"{staging}/{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(part) as f:
                f.write(format_touchstone(one, self.form).encode())
            moves.append((part, f"{root}/{name}"))
        return Written(moves)

    def commit(self, messages: list[Written | None]) -> None:
        """Files of committed attempts take their names; with ``overwrite`` those of before go first."""
        fs, root = _open(self.folder)
        moves = [move for m in messages if m for move in m.moves]
        if len({to for _, to in moves}) < len(moves):
            self.abort(messages)
            raise ValueError("sample ids repeat")
        if self.overwrite and fs.get_file_info(root).type == pafs.FileType.Directory:
            for f in fs.get_file_info(pafs.FileSelector(root)):
                if f.type == pafs.FileType.File and PORTS.search(f.path):
                    fs.delete_file(f.path)
        for part, to in moves:
            fs.move(part, to)
        self._clear(fs, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_open(self.folder))

    def _clear(self, fs: pafs.FileSystem, root: str) -> None:
        if fs.get_file_info(f"{root}/{self.staging}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.staging}")

"""Snapshots of a folder of files: objects named by their content, a manifest for each snapshot, increments, restoring.

``<home>/objects/<sha256>`` are the files' bytes, each content once whatever its names; ``<home>/manifests/<name>`` is a table
of path (below the folder), length, changed (time of the last change, in ns) and sha256. Files are listed, read, hashed and
copied by tasks in pieces of ``PIECE`` bytes, so a file may have any size. A manifest is written last: a job that fails
leaves objects that no manifest names, and the next one uses them.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweeplane.functions.tables import cut, is_local

PIECE = 1 << 22
#: Bytes that a task reads, about, and most tasks of a job.
TASK_BYTES = 256 << 20
TASKS = 100_000
LISTED = "path string, length long, changed long"
FILES = f"{LISTED}, sha256 string"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def _checked(spark: SparkSession, *places: str) -> list[str]:
    for place in places:
        if "://" not in place and not place.startswith("file:") and not is_local(spark):
            raise ValueError("on a cluster a folder is a URI, for a plain path is each machine's own")
    return [place.rstrip("/") for place in places]


def _spread(files: DataFrame, key: str) -> DataFrame:
    """Files dealt over tasks by their bytes; rows are short, so a shuffle that Spark sizes by them would be one task."""
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(max(1, min(n, TASKS, max(cores, -(-size // TASK_BYTES)))), key)


def _digest(fs: pafs.FileSystem, path: str, out=None) -> str:
    """SHA-256 of a file, which is copied to ``out`` on the way."""
    sha = hashlib.sha256()
    with fs.open_input_stream(path) as f:
        while piece := f.read(PIECE):
            sha.update(piece)
            if out is not None:
                out.write(piece)
    return sha.hexdigest()


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """path below the folder, length, changed, of all files: hidden and empty ones too, but none below a ``_temporary``.

    The driver lists the folder itself; the folders in it are listed by tasks.
    """
    fs, root = _open(folder)
    top = fs.get_file_info(pafs.FileSelector(root))
    row = lambda i, base: (posixpath.relpath(i.path, base), i.size, i.mtime_ns)
    files = spark.createDataFrame([row(i, root) for i in top if i.type == pafs.FileType.File], LISTED)
    folders = [posixpath.relpath(i.path, root) for i in top if i.type == pafs.FileType.Directory]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, base = _open(folder)
        for pdf in batches:
            for name in pdf["name"]:
                below = source.get_file_info(pafs.FileSelector(posixpath.join(base, name), recursive=True))
                yield pd.DataFrame([row(i, base) for i in below if i.type == pafs.FileType.File], columns=["path", "length", "changed"])

    if folders:
        dealt = spark.createDataFrame([(f,) for f in folders], "name string").repartition(min(len(folders), TASKS), "name")
        files = files.unionByName(dealt.mapInPandas(run, LISTED))
    return files.where(~F.array_contains(F.split("path", "/"), "_temporary"))


def _name(name: str) -> str:
    if not name or "/" in name or name[0] in "._":
        raise ValueError(f"no name of a snapshot: {name!r}")
    return name


def manifest(spark: SparkSession, home: str, name: str) -> DataFrame:
    return spark.read.schema(FILES).parquet(f"{home.rstrip('/')}/manifests/{_name(name)}")


def take_snapshot(spark: SparkSession, folder: str, home: str, name: str, since: str | None = None) -> DataFrame:
    """Store a folder's files under a new name; returns the manifest.

    Bytes that ``home`` holds already are not written again. With ``since``, the name of an earlier snapshot, files of the same
    path, length and time of change are taken over from it unread, as suits files that are never rewritten in place. An empty
    folder gives an empty manifest; a name in use raises.
    """
    folder, home = _checked(spark, folder, home)
    target = f"{home}/manifests/{_name(name)}"
    files = cut(list_files(spark, folder))
    known = None
    if since is not None:
        known = files.join(manifest(spark, home, since), ["path", "length", "changed"])
        files = files.join(known.select("path"), "path", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (source, root), (store, base) = _open(folder), _open(home)
        objects = f"{base}/objects"
        store.create_dir(objects, recursive=True)
        for pdf in batches:
            digests = []
            for path in pdf["path"]:
                part = f"{objects}/.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    digests.append(_digest(source, posixpath.join(root, path), out))
                final = f"{objects}/{digests[-1]}"
                if store.get_file_info(final).type == pafs.FileType.NotFound:
                    store.move(part, final)
                else:
                    store.delete_file(part)
            yield pdf.assign(sha256=digests)

    stored = _spread(files, "path").mapInPandas(run, FILES)
    if known is not None:
        stored = stored.unionByName(known)
    stored.write.mode("errorifexists").parquet(target)
    return manifest(spark, home, name)


def verify(spark: SparkSession, home: str, name: str) -> DataFrame:
    """sha256, paths (how many files have this content), state: ``ok``, ``missing`` or ``damaged``. Each object is read once."""
    (home,) = _checked(spark, home)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _open(home)
        for pdf in batches:
            states = []
            for want in pdf["sha256"]:
                at = f"{base}/objects/{want}"
                there = store.get_file_info(at).type == pafs.FileType.File
                states.append("missing" if not there else "ok" if _digest(store, at) == want else "damaged")
            yield pdf.assign(state=states)

    contents = manifest(spark, home, name).groupBy("sha256").agg(F.count("*").alias("paths"), F.max("length").alias("length"))
    return _spread(contents, "sha256").select("sha256", "paths").mapInPandas(run, "sha256 string, paths long, state string")


def restore(spark: SparkSession, home: str, name: str, folder: str) -> int:
    """Write a snapshot's files to a folder that is not there yet; returns their number.

    Files go to a folder beside it, which takes its name when all have been written and their digests agree; else it is
    removed, and what was found is raised.
    """
    home, folder = _checked(spark, home, folder)
    fs, place = _open(folder)
    if fs.get_file_info(place).type != pafs.FileType.NotFound:
        raise FileExistsError(folder)
    staged = f"{folder}.{uuid.uuid4().hex}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (store, base), (sink, root) = _open(home), _open(staged)
        for pdf in batches:
            for path, want in zip(pdf["path"], pdf["sha256"], strict=True):
                final = posixpath.join(root, path)
                sink.create_dir(posixpath.dirname(final), recursive=True)
                part = posixpath.join(posixpath.dirname(final), f".{uuid.uuid4().hex}")
                with sink.open_output_stream(part) as out:
                    got = _digest(store, f"{base}/objects/{want}", out)
                if got != want:
                    raise OSError(f"{path}: its object is damaged ({want})")
                sink.move(part, final)
            yield pdf[["path"]]

    sink, root = _open(staged)
    sink.create_dir(root, recursive=True)
    try:
        files = _spread(manifest(spark, home, name), "path")
        n = files.select("path", "sha256").mapInPandas(run, "path string").agg(F.count("path")).first()[0]
        sink.move(root, place)
    except BaseException:
        sink.delete_dir(root)
        raise
    return n


def changes(spark: SparkSession, home: str, old: str, new: str) -> DataFrame:
    """path, change (``added``, ``removed`` or ``changed``) from one snapshot to another."""
    side = lambda name, c: manifest(spark, home, name).select("path", F.col("sha256").alias(c))
    both = side(old, "a").join(side(new, "b"), "path", "full").where(~F.col("a").eqNullSafe(F.col("b")))
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    return both.select("path", kind.alias("change"))

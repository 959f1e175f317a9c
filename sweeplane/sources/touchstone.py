"""Touchstone files: a distributed scan, a parser for one file's text, and a writer."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweeplane.functions.complexcols import UNITS, scale_of
from sweeplane.functions.params import PATTERN, split_params
from sweeplane.functions.tables import cut, is_local, ordered_rank
from sweeplane.operators.network import network_fields

GLOB = "*.[sS][0-9]*[pP]"
#: Paths, with their numbers, that are broadcast to the rows parsed; more meet them in a shuffled join.
BROADCAST_PATHS = 1 << 16
#: Files, and bytes if all were as long as the longest, that one task parses.
TASK_FILES, TASK_BYTES = 512, 128 << 20
#: Tasks for each core of work that is counted in files, whose bytes alone would leave most cores idle.
TASKS_A_CORE = 4
#: First lines of a file in which parameters may stand outside of comments, up to its option line.
HEADER_LINES = 100
PORTS = re.compile(r"\.s(\d+)p$", re.IGNORECASE)


def parse_touchstone(text: str, n_ports: int) -> dict:
    """One file's network: grid in Hz, matrices row-major, parameters from its comments."""
    unit, kind, form, z0 = "GHz", "S", "MA", 50.0
    comments, numbers, header, options = [], [], None, False
    for at, line in enumerate(text.splitlines()):
        data, mark, comment = line.partition("!")
        if not (mark or options or header) and at < HEADER_LINES and "parameters" in line.lower() and (header := re.search(PATTERN, line)):
            continue  # parameters in a header that is no comment
        if mark:
            comments.append(comment.strip())
        data = data.strip()
        if data.startswith("#"):
            options = True
            words = data[1:].split()
            upper = [w.upper() for w in words]
            unit = next((w for w in words if w.lower() in UNITS), unit)
            form = next((w for w in upper if w in ("RI", "MA", "DB")), form)
            kind = next((w for w in upper if w in ("S", "Y", "Z", "G", "H")), kind)
            if "R" in upper:
                z0 = float(words[upper.index("R") + 1])
        elif data and not data.startswith("["):
            numbers.extend(map(float, data.split()))
    if kind != "S":
        raise ValueError(f"{kind} parameters are not read")
    width = 1 + 2 * n_ports * n_ports
    if len(numbers) % width:
        raise ValueError("the number of values does not fit the ports")
    table = np.array(numbers).reshape(-1, width)
    a, b = table[:, 1::2], table[:, 2::2]
    size = 10 ** (a / 20) if form == "DB" else a
    s = a + 1j * b if form == "RI" else size * np.exp(1j * np.radians(b))
    if n_ports == 2:
        s = s[:, [0, 2, 1, 3]]  # two-port files go down the columns
    found = re.search(PATTERN, " ".join(comments)) or header
    params, texts = split_params(found[1]) if found else ({}, {})
    return {
        "n_ports": n_ports, "unit": next(u for u in ("Hz", "kHz", "MHz", "GHz") if u.lower() == unit.lower()), "s_def": "power",
        "z0_re": [z0] * n_ports, "z0_im": [0.0] * n_ports, "comments": comments, "params": params, "params_str": texts,
        "f_hz": (table[:, 0] * scale_of(unit)).tolist(), "s_re": s.real.ravel().tolist(), "s_im": s.imag.ravel().tolist(),
    }


def _fewer(files: DataFrame, tasks: int) -> DataFrame:
    """A scan of files in ``tasks`` tasks, or some a core if that is more; Spark counts 4 MB for the smallest file, which makes a task of 32."""
    tasks = max(tasks, TASKS_A_CORE * files.sparkSession.sparkContext.defaultParallelism)
    return files.coalesce(tasks)


def read_touchstone(spark: SparkSession, folder: str, glob: str = GLOB) -> DataFrame:
    """All files below a folder as packed networks; sample_id is the rank of the path. No file raises FileNotFoundError.

    Files are listed and read by Spark's binary source, so any store and any number of them will do.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    # Read once, without contents; a file's row costs a look at it each time that its scan runs.
    paths = cut(_fewer(files.select("path", "length"), 0))
    count, longest = paths.agg(F.count("*"), F.max("length")).first()
    if not count:
        raise FileNotFoundError(f"no Touchstone file below {folder}")
    tasks = max(math.ceil(count / TASK_FILES), math.ceil(count * longest / TASK_BYTES))
    files = _fewer(files.select("path", "content"), tasks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                one = parse_touchstone(content.decode("utf-8", "replace"), int(PORTS.search(path)[1]))
                rows.append({"path": path, **one})
            yield pd.DataFrame(rows, columns=names)

    fields = network_fields()[1:]
    names = [name for name, _ in fields]
    parsed = files.mapInPandas(run, ", ".join(" ".join(f) for f in fields))
    # Paths alone are sorted, without their contents; each file is read and parsed once.
    ranks = cut(ordered_rank(paths.select("path"), "path", "sample_id"))
    few = count <= BROADCAST_PATHS
    return parsed.join(F.broadcast(ranks) if few else ranks, "path").select("sample_id", *names)


def format_touchstone(row: dict, form: str = "RI") -> str:
    """A file's text: comments, the parameters line, the option line in the network's unit, the data."""
    scale = scale_of(row["unit"])
    lines = [f"! {c}" for c in row["comments"] or () if not re.search(r"(?i)parameters\s*=", c)]
    params = {**dict(row["params"] or {}), **dict(row["params_str"] or {})}
    if params:
        lines.append("! Parameters = {" + "; ".join(f"{k}={v}" for k, v in params.items()) + "}")
    z0 = row["z0_re"][0] if row["z0_re"] is not None and len(row["z0_re"]) else 50.0
    lines.append(f"# {row['unit']} S {form} R {z0}")
    p = row["n_ports"]
    s = (np.asarray(row["s_re"]) + 1j * np.asarray(row["s_im"])).reshape(-1, p * p)
    if p == 2:
        s = s[:, [0, 2, 1, 3]]
    with np.errstate(divide="ignore"):
        first, second = {
            "RI": (s.real, s.imag), "MA": (np.abs(s), np.degrees(np.angle(s))), "DB": (20 * np.log10(np.abs(s)), np.degrees(np.angle(s))),
        }[form]
    for f, a, b in zip(np.asarray(row["f_hz"]) / scale, first, second, strict=True):
        values = [f"{x!r} {y!r}" for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        per_line = 4 if p <= 2 else p
        rows = [" ".join(values[at : at + per_line]) for at in range(0, len(values), per_line)]
        lines.append(f"{float(f)!r} " + "\n".join(rows))
    return "\n".join(lines) + "\n"


def write_touchstone(networks: DataFrame, folder: str | None, form: str = "RI") -> DataFrame:
    """Write sample_<id>.sNp files below a folder or URI that all executors can reach; returns sample_id, path.

    A file is written under another name and then moved, so a task that runs again leaves one whole file.
    """
    if not folder:
        raise ValueError("a target folder is needed")
    folder = folder.rstrip("/")
    if "://" not in folder and not is_local(networks.sparkSession):
        raise ValueError("on a cluster the target is a URI, for a plain path is each machine's own")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
        fs.create_dir(root, recursive=True)
        for pdf in batches:
            names = []
            for row in pdf.to_dict("records"):
                names.append(f"sample_{row['sample_id']:06d}.s{row['n_ports']}p")
                part = f"{root}/{names[-1]}.{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as f:
                    f.write(format_touchstone(row, form).encode())
                fs.move(part, f"{root}/{names[-1]}")
            yield pd.DataFrame({"sample_id": pdf["sample_id"], "path": [f"{folder}/{n}" for n in names]})

    # A row is a file, which takes far longer than its bytes tell: rows are dealt anew, so that every core writes.
    tasks = TASKS_A_CORE * networks.sparkSession.sparkContext.defaultParallelism
    return networks.repartition(tasks, "sample_id").mapInPandas(run, "sample_id long, path string")


def append_touchstone(networks: DataFrame, folder: str, form: str = "RI") -> DataFrame:
    """Write more files into a folder, with numbers behind those its files have; returns sample_id, path."""
    files = networks.sparkSession.read.format("binaryFile").option("pathGlobFilter", GLOB).load(folder)
    number = F.regexp_extract("path", r"sample_(\d+)\.[^/]*$", 1)
    stored = _fewer(files.select("path"), 0).select(F.when(number != "", number).cast("long").alias("sample_id"))
    return write_touchstone(append_ids(stored, networks), folder, form)


def append_ids(existing: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` with sample ids behind those of ``existing``, in the order of its own."""
    top = existing.agg(F.coalesce(F.max("sample_id"), F.lit(-1)).alias("__top"))
    return new.join(F.broadcast(top)).withColumn("sample_id", F.col("sample_id") + F.col("__top") + 1).drop("__top")

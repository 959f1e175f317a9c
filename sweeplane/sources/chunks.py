"""Networks of one grid as a chunked array over sample, frequency and port pair: a band or a pair is read without the rest.

A chunk is a row of ``<path>/data``: the ids of its samples and their values in the order sample, frequency, pair. Samples of
``[c * S, (c + 1) * S)`` are chunk c of ``shape`` (S, K, Q); files hold ``SPAN`` chunks of samples of one chunk of frequencies
and pairs, and lie in folders of these numbers. ``<path>/meta`` (the grid and the shape) is written last, so a store whose
writing failed is not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: Chunks of samples in one file.
SPAN = 64


def _pieces(length: int, size: int) -> list[tuple[int, int, int]]:
    """(number, start, length) of the chunks of one axis."""
    return [(n, at, min(size, length - at)) for n, at in enumerate(range(0, length, size))]


def _check_grid(networks: DataFrame) -> tuple[list[float], int]:
    """The shared grid and port count; raises where samples differ or an id is null or repeated."""
    one = networks.agg(
        F.min("f_hz").alias("lo"), F.max("f_hz").alias("hi"), F.min("n_ports").alias("p"), F.max("n_ports").alias("q"),
        F.bool_and(F.coalesce(F.col("sample_id").isNotNull() & (F.size("s_re") == F.size("f_hz") * F.col("n_ports") * F.col("n_ports")) & (F.size("s_im") == F.size("s_re")), F.lit(False))).alias("whole"),
    ).first()
    if one["lo"] is None:
        raise ValueError("a grid is needed: there is no sample")
    if one["lo"] != one["hi"] or one["p"] != one["q"] or not one["whole"]:
        raise ValueError("samples must have ids, whole matrices, and one grid and port count")
    return list(one["lo"]), one["p"]


def write_chunks(networks: DataFrame, path: str, shape: tuple[int, int, int] = (1024, 16, 4)) -> None:
    """Packed networks as chunks. Ids must be unique, which bounds a chunk: a chunk with a repeated id raises.

    One exchange, of the values: rows go to their file's task, which gathers its chunks.
    """
    if min(shape) < 1:
        raise ValueError("a chunk has at least one element along each axis")
    path = path.rstrip("/")
    f_hz, ports = _check_grid(networks)
    pairs = ports * ports
    boxes = [(fc, k0, kn, pc, q0, qn) for fc, k0, kn in _pieces(len(f_hz), shape[1]) for pc, q0, qn in _pieces(pairs, shape[2])]
    grid = F.from_json(F.lit(str([list(b) for b in boxes])), "array<array<int>>")

    def values(name: str, b: Column) -> Column:
        rows = F.sequence(b[1], b[1] + b[2] - 1)
        return F.flatten(F.transform(rows, lambda k: F.slice(name, k * pairs + b[4] + 1, b[5])))

    piece = F.explode(F.transform(grid, lambda b: F.struct(b[0].alias("f_chunk"), b[3].alias("p_chunk"), values("s_re", b).alias("re"), values("s_im", b).alias("im"))))
    number = lambda size: F.expr(f"(sample_id - pmod(sample_id, {size})) div {size}")
    rows = networks.select("sample_id", number(shape[0]).alias("s_chunk"), number(shape[0] * SPAN).alias("s_file"), piece.alias("c")).select("sample_id", "s_chunk", "s_file", "c.*")
    place = ("s_file", "f_chunk", "p_chunk")
    one = F.array_sort(F.collect_list(F.struct("sample_id", "re", "im")))
    chunks = rows.repartition(*place).groupBy(*place, "s_chunk").agg(one.alias("c"))
    along = lambda name: F.transform("c", lambda x: x[name])
    once = F.when(F.size(F.array_distinct(along("sample_id"))) == F.size("c"), along("sample_id")).otherwise(F.raise_error(F.lit("a sample id is repeated")).cast("array<long>"))
    stored = chunks.select(*place, "s_chunk", once.alias("ids"), F.flatten(along("re")).alias("re"), F.flatten(along("im")).alias("im"))
    stored.sortWithinPartitions(*place, "s_chunk").write.mode("errorifexists").partitionBy(*place).option("compression", "zstd").parquet(f"{path}/data")
    meta = networks.sparkSession.range(1, numPartitions=1).select(
        F.from_json(F.lit(str(f_hz)), "array<double>").alias("f_hz"), F.lit(ports).alias("n_ports"), F.array(*map(F.lit, shape)).alias("shape")
    )
    meta.write.mode("errorifexists").parquet(f"{path}/meta")


def read_chunks(
    spark: SparkSession, path: str, band_hz: tuple[float, float] | None = None, pairs: list[tuple[int, int]] | None = None, samples: tuple[int, int] | None = None
) -> DataFrame:
    """Points (sample_id, k, f_hz, i, j, re, im) of a band, of port pairs (from 0), of samples lo to hi (all with both ends).

    Only folders of chunks that the selection touches are opened; within files, chunks of samples are found by their numbers.
    """
    path = path.rstrip("/")
    try:
        meta = spark.read.parquet(f"{path}/meta").first()
    except AnalysisException as gone:
        raise FileNotFoundError(f"{path} is no complete array store") from gone
    f_hz, ports, (size, k_size, q_size) = list(meta["f_hz"]), meta["n_ports"], meta["shape"]
    n_pairs = ports * ports
    ks = [k for k, f in enumerate(f_hz) if band_hz is None or band_hz[0] <= f <= band_hz[1]]
    if pairs is not None and any(not (0 <= i < ports and 0 <= j < ports) for i, j in pairs):
        raise ValueError(f"port pairs must be of {ports} ports, from 0")
    qs = list(range(n_pairs)) if pairs is None else sorted({i * ports + j for i, j in pairs})
    chunks = spark.read.schema("ids array<long>, re array<double>, im array<double>, s_chunk long, s_file long, f_chunk int, p_chunk int").parquet(f"{path}/data")
    chunks = chunks.where(F.col("f_chunk").isin(sorted({k // k_size for k in ks})) & F.col("p_chunk").isin(sorted({q // q_size for q in qs})))
    if samples is not None:
        lo, hi = samples[0] // size, samples[1] // size
        chunks = chunks.where(F.col("s_file").between(lo // SPAN, hi // SPAN) & F.col("s_chunk").between(lo, hi))
    kn = F.least(F.lit(k_size), len(f_hz) - F.col("f_chunk") * k_size)
    qn = F.least(F.lit(q_size), n_pairs - F.col("p_chunk") * q_size)
    rows = chunks.select("ids", "f_chunk", "p_chunk", kn.alias("kn"), qn.alias("qn"), F.posexplode(F.arrays_zip("re", "im")).alias("e", "v"))
    k = F.col("f_chunk") * k_size + F.floor(F.col("e") / F.col("qn")) % F.col("kn")
    q = F.col("p_chunk") * q_size + F.col("e") % F.col("qn")
    out = rows.select(
        F.get("ids", F.floor(F.col("e") / (F.col("kn") * F.col("qn"))).cast("int")).alias("sample_id"), k.cast("long").alias("k"), q.cast("long").alias("q"), "v.re", "v.im"
    )
    out = out.where(F.col("k").isin(ks) & F.col("q").isin(qs))
    if samples is not None:
        out = out.where(F.col("sample_id").between(*samples))
    axis = F.from_json(F.lit(str(f_hz)), "array<double>")
    pair = lambda c, name: F.floor(c).cast("long").alias(name)
    return out.select("sample_id", "k", F.get(axis, F.col("k").cast("int")).alias("f_hz"), pair(F.col("q") / ports, "i"), pair(F.col("q") % ports, "j"), "re", "im")

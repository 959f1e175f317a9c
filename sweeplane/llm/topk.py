"""Exact top-k search by distributed histogram selection.

Every query is scored against every candidate in blocks of bounded bytes. No scores are kept: each pass counts, for each
query, how many scores fall into each of BINS equal bins of the range in which its kth highest score must lie. The counts
of all blocks are added up, the bin that holds the kth value becomes the next range, and the pass is made again for the
queries that are still open. A query is settled when its bin holds just what is wanted, or is one score wide. Then the
rows at or above the threshold are filtered; where a score is tied at the threshold, each block keeps the smallest ids.

A block tells only its bins from the top down to where it has as many scores as are wanted: the global kth value cannot
lie below a block's own, so no lower bin can matter. That is at most k bins a query and block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sweeplane.llm.common import map_arrow, materialize, prepare

#: Bins of a pass. A range of R scores takes log R / log BINS passes at most.
BINS = 1024
#: Bytes of one block's vectors in double precision: 8192 vectors of 64 dimensions.
VECTOR_BYTES = 4 << 20
#: Scores that a task holds at once.
SCORES = 1 << 19
#: Parts in which a query's filtered rows are cut to k before they meet.
MEETINGS = 256
#: Below this bound sums of products are exact in double precision; up to the second, which leaves ranges in 63 bits, in integers.
EXACT_DOUBLE, EXACT_LONG = 2.0**53, 2.0**61


def quantized(vectors: DataFrame, scale: float, id_col: str, vector_col: str, queries: Column) -> DataFrame:
    """uid, id, is_query, dims, width (bytes a component), norm, vec: the rows that take part, with floor(scale * x) for each x."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.coalesce(queries, F.lit(False)).alias("is_query"), F.col(vector_col).alias("v"))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, dims, width, norm, packed = [], [], [], [], []
        for n, vector in enumerate(batch.column("v")):
            values = vector.values
            if values is None or values.null_count:
                continue
            x = np.floor(scale * values.to_numpy(zero_copy_only=False).astype(np.float64))
            if not np.isfinite(x).all():
                continue
            most = np.abs(x).max(initial=0.0)
            if most >= EXACT_LONG:
                raise OverflowError("a scaled component does not fit a long")
            kind = np.int16 if most < 2**15 else np.int64
            at.append(n)
            dims.append(len(x))
            width.append(np.dtype(kind).itemsize)
            norm.append(float(np.linalg.norm(x)))
            packed.append(x.astype(kind).tobytes())
        kept = batch.take(pa.array(at, pa.int64()))
        return pa.RecordBatch.from_arrays(
            [kept.column("id"), kept.column("is_query"), pa.array(dims, pa.int32()), pa.array(width, pa.int32()), pa.array(norm, pa.float64()), pa.array(packed, pa.binary())],
            names=["id", "is_query", "dims", "width", "norm", "vec"],
        )

    schema = "id long, is_query boolean, dims int, width int, norm double, vec binary"
    return map_arrow(rows.where("id IS NOT NULL"), kernel, schema).withColumn("uid", F.monotonically_increasing_id())


def _matrix(pdf: pd.DataFrame, dims: int) -> np.ndarray:
    out = np.zeros((len(pdf), dims), dtype=np.int64)
    for width in (2, 8):
        at = np.flatnonzero(pdf["width"].to_numpy() == width)
        if len(at) and dims:
            out[at] = np.frombuffer(b"".join(pdf["vec"].iloc[at]), dtype=f"i{width}").reshape(len(at), dims)
    return out


def _scores(left: pd.DataFrame, right: pd.DataFrame):
    """(queries' places, their integer scores against all of ``right``, which of these count), in slices of bounded size."""
    dims = int(left["dims"].iloc[0])
    a, b = _matrix(left, dims), _matrix(right, dims)
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * dims
    if bound >= EXACT_LONG:
        raise OverflowError("an inner product may not fit a long")
    if bound < EXACT_DOUBLE:
        a, b = a.astype(np.float64), b.astype(np.float64)
    mine, theirs = left["uid"].to_numpy(), right["uid"].to_numpy()
    step = max(1, SCORES // max(1, len(b)))
    for at in range(0, len(a), step):
        s = (a[at : at + step] @ b.T).astype(np.int64)
        yield at, s, mine[at : at + step, None] != theirs[None, :]


def count_scores(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """One block's part of the histograms: uid, bin, n, from the top down as far as it can matter."""
    out: list[pd.DataFrame] = []
    if len(left) and len(right):
        lo, hi, bin_width, need, uid = (left[c].to_numpy() for c in ("lo", "hi", "bin_width", "need", "uid"))
        for at, s, counts in _scores(left, right):
            part = slice(at, at + len(s))
            counts &= (s >= lo[part, None]) & (s <= hi[part, None])
            row, col = np.nonzero(counts)
            place = row * BINS + (s[row, col] - lo[part][row]) // bin_width[part][row]
            n = np.bincount(place, minlength=len(s) * BINS).reshape(len(s), BINS)
            above = n[:, ::-1].cumsum(axis=1)[:, ::-1] - n
            row, col = np.nonzero((n > 0) & (above < need[part, None]))
            out.append(pd.DataFrame({"uid": uid[part][row], "bin": col, "n": n[row, col]}))
    return pd.concat(out) if out else pd.DataFrame({"uid": [], "bin": [], "n": []}).astype("int64")


def take_rows(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """One block's rows above each query's threshold, and the smallest ids, as many as are wanted, of those at it."""
    out: list[pd.DataFrame] = []
    if len(left) and len(right):
        right = right.sort_values(["id", "uid"], kind="stable")
        lo, need, ties, query, uid = (left[c].to_numpy() for c in ("lo", "need", "ties", "id", "uid"))
        ids, block = right["id"].to_numpy(), right["b"].to_numpy()
        for at, s, counts in _scores(left, right):
            part = slice(at, at + len(s))
            tied = counts & (s == lo[part, None]) & ties[part, None]
            first = tied & (tied.cumsum(axis=1) <= need[part, None])
            take = counts & (s >= lo[part, None]) & (~tied | first)
            row, col = np.nonzero(take)
            out.append(pd.DataFrame({"uid": uid[part][row], "query_id": query[part][row], "vec_id": ids[col], "score": s[row, col], "b": block[col]}))
    return pd.concat(out) if out else pd.DataFrame({"uid": [], "query_id": [], "vec_id": [], "score": [], "b": []}).astype("int64")


def _meet(queries: DataFrame, rows: DataFrame, kernel, schema: str) -> DataFrame:
    """``kernel`` over each block of queries with each block of candidates; vectors of one length meet.

    Blocks hold about VECTOR_BYTES. Candidates are dealt once for each block of queries, so a pass shuffles them once for
    every 8192 queries of 64 dimensions.
    """
    size = F.ceil(F.col("n") * F.greatest(F.col("dims"), F.lit(1)) * 8 / VECTOR_BYTES)
    parts = lambda df, name: df.groupBy("dims").agg(F.count("*").alias("n")).select("dims", size.alias(name))
    sizes = parts(queries, "qs").join(parts(rows, "cs"), "dims")
    block = lambda n: F.pmod(F.xxhash64("uid"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = queries.join(sizes, "dims").withColumns({"a": block("qs"), "b": every("cs")})
    right = rows.join(sizes, "dims").withColumns({"b": block("cs"), "a": every("qs")}).select("dims", "a", "b", "uid", "id", "width", "vec")
    at = ("dims", "a", "b")
    return left.groupBy(*at).cogroup(right.groupBy(*at)).applyInPandas(kernel, schema)


def _open(state: DataFrame) -> DataFrame:
    return state.where("NOT settled")


def refine(state: DataFrame, rows: DataFrame) -> DataFrame:
    """One pass: the open queries' ranges shrink to the bin that holds their kth highest score."""
    bin_width = F.expr(f"(hi - lo) div {BINS} + 1")
    asked = _open(state).withColumn("bin_width", bin_width)
    counted = _meet(asked, rows, count_scores, "uid long, bin long, n long").groupBy("uid", "bin").agg(F.sum("n").alias("n"))
    # At most BINS rows a query from here on.
    down = Window.partitionBy("uid").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    summed = counted.withColumn("through", F.sum("n").over(down))
    met = summed.join(asked.select("uid", "need"), "uid").where((F.col("through") >= F.col("need")) & (F.col("through") - F.col("n") < F.col("need")))
    found = met.select("uid", "bin", "n", (F.col("need") - F.col("through") + F.col("n")).alias("left"))
    now = state.join(found, "uid", "left").withColumn("bin_width", bin_width)
    lo = F.col("lo") + F.col("bin") * F.col("bin_width")
    hi = F.least(lo + F.col("bin_width") - 1, F.col("hi"))
    hit = F.col("bin").isNotNull()
    # An open query without a bin has fewer candidates than are wanted: all of them are taken.
    return now.select(
        *(c for c in state.columns if c not in ("lo", "hi", "need", "ties", "settled")), F.when(hit, lo).otherwise(F.col("lo")).alias("lo"),
        F.when(hit, hi).otherwise(F.col("hi")).alias("hi"), F.coalesce("left", "need").alias("need"),
        F.coalesce(F.col("n") > F.col("left"), "ties").alias("ties"), (~hit | (F.col("n") == F.col("left")) | (lo == hi)).alias("settled"),
    )


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: float = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's ``k`` highest inner products of floor(scale * x), ties to the smaller id.

    ``queries`` tells the rows that ask; every row but the query's own answers. Rows whose vector is null or holds null or
    non-finite components, and rows without an id, take no part. Only vectors of equal length are compared; empty ones score
    0. A repeated row answers and asks as often as it stands there, so a repeated query has its ranks once for each row. A
    query with fewer than ``k`` candidates has them all, one without any has no row, and an empty table gives none. Other
    columns are not looked at. Products that might not fit a long raise OverflowError.

    Each pass and the filter are one cogrouped shuffle of the candidates for every block of queries; rows leave a block at
    most ``k`` for each of its queries. Only counts of queries reach the driver.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    prepare(vectors.sparkSession)
    rows = materialize(quantized(vectors, scale, id_col, vector_col, queries), "quantized")
    longest = rows.groupBy("dims").agg(F.max("norm").alias("most"))
    # By the Cauchy-Schwarz inequality no score is beyond the product of the norms.
    reach = F.ceil(F.least(F.col("norm") * F.col("most") * (1 + 1e-9) + 1, F.lit(EXACT_LONG))).cast("long")
    state = rows.where("is_query").join(longest, "dims").select(
        "uid", "id", "dims", "width", "vec", (-reach).alias("lo"), reach.alias("hi"), F.lit(k).cast("long").alias("need"), F.lit(False).alias("ties"),
        F.lit(False).alias("settled"),
    )
    state = materialize(state, "asked")
    while not _open(state).isEmpty():
        state = materialize(refine(state, rows), "asked")
    taken = _meet(state, rows, take_rows, "uid long, query_id long, vec_id long, score long, b long")
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))
    some = taken.withColumn("part", F.pmod("b", F.lit(MEETINGS))).withColumn("at", best("uid", "part")).where(F.col("at") <= k)
    return some.withColumn("rank", best("uid")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11(embeddings: DataFrame) -> DataFrame:
    """The contract's columns: queries are the rows whose vec_id is divisible by 50; nulls, ties and odd rows as in ``top_k``."""
    return top_k(embeddings, F.col("vec_id") % 50 == 0)


#: SQL of op11 for DuckDB.
OP11_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""

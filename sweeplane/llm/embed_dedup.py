"""Embedding near-duplicates by an exact metric range join.

Unit vectors at cosine c are sqrt(2 - 2c) apart, so links are pairs within a radius. Pivots of each label partition
its vectors, about half the root of the label's size of them: a vector is at home in its nearest pivot's cell. For a vector x at home with pivot p, and another pivot q,
the triangle inequality bounds how far x is from any vector of q's cell: at least (d(x,q) - d(x,p)) / 2, and at least
the distance (d(x,q)^2 - d(x,p)^2) / 2d(p,q) to the plane between the two. Where neither exceeds the radius, x visits
q's cell. A pair of two cells is compared in the lower-numbered one only. Cells join independently, in blocks of
bounded size, so one dense cell is many tasks. Blocks give counts and a forest of edges, not their pairs.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweeplane.llm.common import map_arrow, materialize, prepare
from sweeplane.llm.graph import connected_components

#: Pivots of a label by the root of its distinct vectors. Over all labels they are about PIVOTS at most, which bounds their
#: broadcast: beyond it every label has fewer in proportion.
PIVOT_SHARE = 0.5
PIVOTS = 32768
#: Bytes of all pivots in double precision, which long vectors reach first.
PIVOT_BYTES = 32 << 20
#: Distances between vectors and pivots that a task holds at once.
DISTANCES = 1 << 20
#: Most home vectors, and most vectors they are compared with, in one block.
BLOCK = 2048
#: Slack of the cell bounds for rounding; links themselves are decided by the cosine alone.
SLACK = 1e-9


def _keyed(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label, key (null where a vector cannot link), vec: its components in bytes, single or double as in the table."""
    rows = vectors.select(
        F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v")
    )

    dtype = _dtype(vectors, vector_col)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, packed = [], []
        for label, vector in zip(batch.column("label").to_pylist(), batch.column("v"), strict=True):
            values = vector.values
            usable = label is not None and values is not None and len(values) and not values.null_count
            x = values.to_numpy(zero_copy_only=False).astype(dtype) + dtype(0) if usable else None
            if usable and np.isfinite(x).all() and x.any():
                data = x.tobytes()
                keys.append(hashlib.blake2b(data + label.encode(), digest_size=16).digest())
                packed.append(data)
            else:
                keys.append(None)
                packed.append(None)
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("label"), pa.array(keys, pa.binary()), pa.array(packed, pa.binary())],
            names=["id", "label", "key", "vec"],
        )

    kind = vectors.schema[id_col].dataType.simpleString()
    return map_arrow(rows, kernel, f"id {kind}, label string, key binary, vec binary")


def _dtype(vectors: DataFrame, vector_col: str) -> type:
    return np.float32 if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else np.float64


def _unit(vecs, dtype: type) -> np.ndarray:
    """Vectors in rows, in double precision at length one; scaled first, so that no square overflows or vanishes."""
    x = np.frombuffer(b"".join(vecs), dtype=dtype).reshape(len(vecs), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def choose_pivots(nodes: DataFrame, dtype: type) -> dict[str, np.ndarray]:
    """Unit pivots of each group, picked by a hash of the vector; groups that would have less than two are left out."""
    sizes = nodes.groupBy("grp").agg(F.count("*").alias("n"), F.max(F.octet_length("vec")).alias("bytes"))
    wish = PIVOT_SHARE * F.sqrt("n")
    total, held = sizes.agg(F.sum(wish), F.sum(wish * F.col("bytes")) * (8 / np.dtype(dtype).itemsize)).first()
    scale = min(1.0, PIVOTS / (total or 1.0), PIVOT_BYTES / (held or 1.0))
    # At most PIVOTS / 2 groups have two pivots or more, so their sizes can be broadcast.
    wanted = sizes.withColumn("want", F.floor(scale * wish)).where("want >= 2")
    place = F.pmod(F.xxhash64("key"), F.lit(1 << 40)) / float(1 << 40)
    picked = nodes.select("grp", "key", "vec").join(F.broadcast(wanted), "grp").where(place < F.col("want") / F.col("n")).select("grp", "key", "vec").collect()
    groups: dict[str, list] = {}
    for r in sorted(picked, key=lambda r: bytes(r["key"])):
        groups.setdefault(r["grp"], []).append(r["vec"])
    return {g: _unit(vecs, dtype) for g, vecs in groups.items()}


def assign_cells(x: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Each unit vector's home cell, and whether it visits each cell (of a lower number than its home).

    Distances are taken for so many vectors at once that no matrix exceeds DISTANCES.
    """
    home, visits = np.zeros(len(x), dtype=np.int64), np.zeros((len(x), len(pivots)), dtype=bool)
    step = max(1, DISTANCES // max(1, len(pivots)))
    for at in range(0, len(x), step):
        part = slice(at, at + step)
        d2 = np.maximum(2 - 2 * x[part] @ pivots.T, 0)
        near = d2.argmin(axis=1)
        near2 = d2[np.arange(len(near)), near][:, None]
        apart = np.sqrt(np.maximum(2 - 2 * pivots[near] @ pivots.T, 0))
        by_triangle = (np.sqrt(d2) - np.sqrt(near2)) / 2 <= radius + SLACK
        by_plane = d2 - near2 <= 2 * apart * (radius + SLACK) + SLACK
        home[part], visits[part] = near, by_triangle & by_plane & (np.arange(len(pivots)) < near[:, None])
    return home, visits


def _cells(nodes: DataFrame, pivots: dict[str, np.ndarray], radius: float, dtype: type) -> DataFrame:
    """Each node in its home cell and in those it visits."""
    shared = nodes.sparkSession.sparkContext.broadcast(pivots)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        groups = np.array(batch.column("grp").to_pylist())
        rows, cells, homes = [], [], []
        for group in np.unique(groups):
            at = np.flatnonzero(groups == group)
            if group in shared.value:
                home, visits = assign_cells(_unit([batch.column("vec")[int(i)].as_py() for i in at], dtype), shared.value[group], radius)
                who, cell = np.nonzero(visits)
            else:
                home, who, cell = np.zeros(len(at), dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
            rows += [at, at[who]]
            cells += [home, cell]
            homes += [np.ones(len(at), dtype=bool), np.zeros(len(who), dtype=bool)]
        rows = np.concatenate(rows)
        taken = batch.take(pa.array(rows))
        arrays = [taken.column(c) for c in ("node", "grp", "n", "vec")]
        return pa.RecordBatch.from_arrays(
            [*arrays, pa.array(np.concatenate(cells)), pa.array(np.concatenate(homes))],
            names=["node", "grp", "n", "vec", "cell", "home"],
        )

    schema = "node long, grp string, n long, vec binary, cell long, home boolean"
    return map_arrow(nodes.select("node", "grp", "n", "vec"), kernel, schema)


def compared_pairs(cells: DataFrame) -> tuple[int, int]:
    """(pairs that cells compare, pairs of equal group): what the pivots prune."""
    home = F.count_if("home")
    by_cell = cells.groupBy("grp", "cell").agg(home.alias("h"), (F.count("*") - home).alias("v"))
    by_group = by_cell.groupBy("grp").agg(F.sum(F.col("h") * (F.col("h") - 1) / 2 + F.col("h") * F.col("v")).alias("c"), F.sum("h").alias("n"))
    r = by_group.agg(F.sum("c"), F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()
    return int(r[0] or 0), int(r[1] or 0)


def _block_links(least: float, dtype: type):
    """One block pair: how many vectors each node links with here, and edges that connect what is linked."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if left.empty or (right.empty and not pdf["same"].iloc[0]):
            return pd.DataFrame({"node": [], "links": [], "other": []}).astype("int64")
        same = bool(pdf["same"].iloc[0])
        right = left if same else right
        a, b = _unit(left["vec"], dtype), _unit(right["vec"], dtype)
        na, nb = left["n"].to_numpy(), right["n"].to_numpy()
        ia, ib = left["node"].to_numpy(), right["node"].to_numpy()
        links_a, links_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        edges: dict[tuple[int, int], None] = {}
        for at in range(0, len(a), 256):
            close = a[at : at + 256] @ b.T >= least
            if same:
                close &= np.arange(len(b)) > np.arange(at, at + len(close))[:, None]
            if not close.any():
                continue
            links_a[at : at + 256] += close @ nb
            links_b += na[at : at + 256] @ close
            rows = np.flatnonzero(close.any(axis=1))
            cols = np.flatnonzero(close.any(axis=0))
            edges.update(dict.fromkeys(_forest(close, rows, cols, ia[at:], ib)))
        e = list(edges)
        out = pd.DataFrame(
            {
                "node": np.concatenate([ia, ib, np.array([x for x, _ in e], dtype=np.int64)]),
                "links": np.concatenate([links_a, links_b, np.zeros(len(e), dtype=np.int64)]),
                "other": np.concatenate([ia, ib, np.array([y for _, y in e], dtype=np.int64)]),
            }
        )
        return out[(out["links"] > 0) | (out["node"] != out["other"])]

    return run


def _forest(close: np.ndarray, rows: np.ndarray, cols: np.ndarray, ia: np.ndarray, ib: np.ndarray):
    """Edges that connect what ``close`` connects: a search over its rows and columns, one edge for each one reached."""
    todo_r, todo_c = set(rows.tolist()), set(cols.tolist())
    while todo_r:
        stack = [todo_r.pop()]
        while stack:
            r = stack.pop()
            for c in np.flatnonzero(close[r]).tolist():
                if c not in todo_c:
                    continue
                todo_c.discard(c)
                yield int(ia[r]), int(ib[c])
                for other in np.flatnonzero(close[:, c]).tolist():
                    if other in todo_r:
                        todo_r.discard(other)
                        stack.append(other)
                        yield int(ia[other]), int(ib[c])


def near_vectors(
    vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """One row a vector: id, n_links, component_id, kept; links are pairs of equal label at cosine >= ``least``.

    Vectors that are null, zero, or hold null or non-finite components, and those without a label, link with nothing;
    nor do vectors of different lengths. Equal vectors are compared once and counted for each row, so repeated rows
    link with each other. Null ids are passed over in the smallest id; a null id is never kept. An empty table gives no
    rows. Other columns are not looked at. Cosines are taken in double precision.
    """
    prepare(vectors.sparkSession)
    keyed = materialize(_keyed(vectors, id_col, vector_col, label_col), "vectors")
    nodes = keyed.where(F.col("key").isNotNull()).groupBy("key").agg(
        F.min("id").alias("least"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("vec").alias("vec")
    )
    group = F.concat_ws(":", F.length("vec").cast("string"), "label")
    nodes = nodes.withColumn("grp", group).withColumn("node", F.monotonically_increasing_id())
    rows = keyed.count()
    nodes = materialize(nodes.drop("label"), "nodes", 16 * rows)  # a vector is as long as many small rows
    dtype = _dtype(vectors, vector_col)
    cells = materialize(_cells(nodes, choose_pivots(nodes, dtype), math.sqrt(max(0.0, 2 - 2 * least)), dtype), "cells")
    # Blocks of a cell: its homes and its visitors in parts of about BLOCK, each part of homes with each other part.
    sizes = cells.groupBy("grp", "cell").agg(
        F.ceil(F.count_if("home") / BLOCK).alias("parts"), F.ceil(F.count_if(~F.col("home")) / BLOCK).alias("guests")
    )
    sizes = sizes.where("parts > 0")
    placed = cells.join(materialize(sizes, "sizes"), ["grp", "cell"])
    part = F.pmod(F.xxhash64("node"), F.when(F.col("home"), F.col("parts")).otherwise(F.col("guests"))).cast("long")
    placed = placed.withColumn("part", part)
    # Home part p stands on the left of blocks (p, q) for q >= p and of (p, guest part g); on the right of (o, p), o < p.
    span = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))
    tag = lambda a, b, kind, side: F.struct(a.alias("a"), b.alias("b"), F.lit(kind).alias("kind"), F.lit(side).alias("side"))
    p = F.col("part")
    of_home = F.concat(
        F.transform(F.filter(span(F.col("parts")), lambda q: q >= p), lambda q: tag(p, q, "home", 0)),
        F.transform(F.filter(span(F.col("parts")), lambda o: o < p), lambda o: tag(o, p, "home", 1)),
        F.transform(span(F.col("guests")), lambda g: tag(p, g, "guest", 0)),
    )
    of_guest = F.transform(span(F.col("parts")), lambda o: tag(o, p, "guest", 1))
    dealt = placed.withColumn("t", F.explode(F.when(F.col("home"), of_home).otherwise(of_guest)))
    dealt = dealt.select(
        "grp", "cell", "t.*", "node", "n", "vec", ((F.col("t.a") == F.col("t.b")) & (F.col("t.kind") == "home")).alias("same")
    )
    found = dealt.groupBy("grp", "cell", "a", "b", "kind").applyInPandas(_block_links(least, dtype), "node long, links long, other long")
    found = materialize(found, "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    members = nodes.select("node", "key", "n", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    members = materialize(members.join(counts, "node", "left"), "members", rows)
    smallest = materialize(members.groupBy("root").agg(F.min("least").alias("component_id")), "smallest", rows)
    result = members.join(smallest, "root").select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    # A hot vector's rows are split by Spark: both sides are scans.
    usable = keyed.where("key IS NOT NULL").select("id", "key").join(materialize(result, "result", rows), "key")
    alone = keyed.where("key IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = usable.select("id", "n_links", "component_id").unionByName(alone)
    return out.select(
        F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
    )


#: SQL of op8 for DuckDB.
OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.node = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""

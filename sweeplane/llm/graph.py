"""Connected components of links, as alternating large-star and small-star rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweeplane.llm.common import materialize


def _star(pairs: DataFrame, large: bool, edges: int) -> DataFrame:
    """One star round over edges (a > b). Large: neighbours above a node move to its minimum; small: those below.

    Least neighbours come from partial aggregates and are written, so that the join back is one of two scans, whose hot
    keys Spark splits by itself.
    """
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    least = materialize(least, "least", 2 * edges)
    met = both.join(least, "a")
    if large:
        out = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = out.unionAll(least.select("a", F.col("m").alias("b")))
    return materialize(out.where("a > b").distinct(), "edges", 2 * edges)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Edges (a, b) of longs to (node, root): root is the smallest node of the component.

    Nodes without an edge, and loops, give no row. Repeated edges count once; no edges give no rows. Only counts and
    checksums of the edges reach the driver; each round is two joins and four written tables.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = materialize(pairs.where("a > b").distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == mark or not now[0]:
            break
        mark = tuple(now)
        pairs = _star(_star(pairs, True, now[0]), False, now[0])
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)

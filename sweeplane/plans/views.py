"""The driver's tables read as networks, parameters and clouds, in Spark and in SQL.

A 64-component embedding is a two-port sweep of 8 frequencies (component 8k + 4i + 2j + part) or a four-port one of 2
(32k + 8i + 2j + part); frequencies start at 1 GHz, 0.5 GHz apart; the label is the device family.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sweeplane.operators.design import DesignSpace


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str, ports: int = 2) -> DataFrame:
    """sample_id, label, k, f_hz, i, j, re, im."""
    e = table(spark, sf_dir, "embeddings")
    pairs = ports * ports
    item = lambda q: F.struct(
        F.floor(q / pairs).cast("long").alias("k"), F.floor(q % pairs / ports).cast("long").alias("i"), (q % ports).cast("long").alias("j"),
        F.get("embedding", 2 * q).cast("double").alias("re"), F.get("embedding", 2 * q + 1).cast("double").alias("im"),
    )
    rows = e.select(F.col("vec_id").alias("sample_id"), "label", F.explode(F.transform(F.sequence(F.lit(0), F.lit(31)), item)).alias("p"))
    return rows.select("sample_id", "label", "p.k", (1e9 + F.col("p.k") * 5e8).alias("f_hz"), "p.i", "p.j", "p.re", "p.im")


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two-port networks as packed rows."""
    e = table(spark, sf_dir, "embeddings")
    take = lambda part: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda q: F.get("embedding", 2 * q + part).cast("double"))
    return e.select(
        F.col("vec_id").alias("sample_id"), F.col("label"), F.lit(2).alias("n_ports"), F.array(F.lit(50.0), F.lit(50.0)).alias("z0_re"),
        F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: 1e9 + k * 5e8).alias("f_hz"), take(0).alias("s_re"), take(1).alias("s_im"),
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as samples: size and price, a constant, and a key that every seventh part lacks."""
    p = table(spark, sf_dir, "part")
    entries = F.array(
        F.struct(F.lit("size").alias("k"), F.col("p_size").cast("double").alias("v")), F.struct(F.lit("price").alias("k"), F.col("p_retailprice").alias("v")),
        F.struct(F.lit("fc").alias("k"), F.lit(12.7).alias("v")), F.struct(F.lit("q").alias("k"), F.when(F.col("p_partkey") % 7 != 0, (F.col("p_partkey") % 5).cast("double")).alias("v")),
    )
    return p.select(F.col("p_partkey").alias("sample_id"), F.map_from_entries(F.filter(entries, lambda x: x["v"].isNotNull())).alias("params"))


def ranges(spark: SparkSession, sf_dir: str) -> DesignSpace:
    """The space that parts and line items span: size, price, qty, disc."""
    p = table(spark, sf_dir, "part").select(F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    q = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("qty"), F.col("l_discount").alias("disc"))
    return DesignSpace({**DesignSpace.of_table(p, ["size", "price"]).variables, **DesignSpace.of_table(q, ["qty", "disc"]).variables})


def r6(c: Column | str, name: str | None = None) -> Column:
    """Six decimals, without a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.round(c, 6) + 0.0).alias(name) if name else F.round(c, 6) + 0.0


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


def sql_points(ports: int = 2) -> str:
    """The points in SQL, as the relation s."""
    n = ports * ports
    return (
        f"s AS (SELECT vec_id AS sample_id, label, q // {n} AS k, 1e9 + (q // {n}) * 5e8 AS f_hz, (q % {n}) // {ports} AS i, q % {ports} AS j, "
        "CAST(embedding[2*q+1] AS DOUBLE) AS re, CAST(embedding[2*q+2] AS DOUBLE) AS im FROM embeddings, range(32) t(q))"
    )


#: Magnitude in dB of an element, minus infinity at zero.
SQL_DB = "(CASE WHEN re = 0 AND im = 0 THEN CAST('-Infinity' AS DOUBLE) ELSE 20 * log10(sqrt(re*re + im*im)) END)"
SQL_PARTS = (
    "p AS (SELECT p_partkey AS sample_id, 'size' AS key, CAST(p_size AS DOUBLE) AS val FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part "
    "UNION ALL SELECT p_partkey, 'fc', CAST(12.7 AS DOUBLE) FROM part UNION ALL SELECT p_partkey, 'q', CAST(p_partkey % 5 AS DOUBLE) FROM part WHERE p_partkey % 7 <> 0)"
)
#: The bounds of the space in SQL, as the relation r.
SQL_RANGES = (
    "r AS (SELECT * FROM (SELECT CAST(min(p_size) AS DOUBLE) AS s0, CAST(max(p_size) AS DOUBLE) AS s1, min(p_retailprice) AS p0, max(p_retailprice) AS p1 FROM part), "
    "(SELECT min(l_quantity) AS q0, max(l_quantity) AS q1, min(l_discount) AS d0, max(l_discount) AS d1 FROM lineitem))"
)


def sql_at(unit: str, axis: str) -> str:
    """A variable's value in SQL at a place of its unit interval, to six decimals."""
    return f"round({axis}0 + ({unit}) * ({axis}1 - {axis}0), 6) + 0.0"

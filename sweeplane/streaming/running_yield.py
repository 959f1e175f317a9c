"""Running yield of networks as they arrive: stateless verdicts, then counts by event-time window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sweeplane.operators.goals import Criterion, MaxAgg, MeanAgg, MinAgg, RippleAgg, SMag, Specification, StdAgg


def packed_verdicts(networks: DataFrame, spec: Specification) -> DataFrame:
    """ok for packed networks, within the row: no shuffle, so it runs on streams. S-magnitude criteria only.

    Maximum, minimum, mean, ripple and deviation are taken over the band by array functions, with the rules of ``Specification``.
    """
    out = F.lit(True)
    for c in spec.criteria:
        if not isinstance(c.selector, SMag):
            raise TypeError("streams judge S magnitudes only")
        out = out & c.comparator.ok(F.coalesce(_value(c), F.lit(float("nan"))))
    return networks.withColumn("ok", out)


def _value(c: Criterion) -> Column:
    """A criterion's value from the arrays of its row; null where the band is empty."""
    pairs = F.col("n_ports") * F.col("n_ports")
    at = (c.selector.m - 1) * F.col("n_ports") + c.selector.n - 1

    def element(f: Column, k: Column) -> Column:
        place = (k * pairs + at).cast("int")
        return F.struct(f.alias("f"), F.hypot(F.get("s_re", place), F.get("s_im", place)).alias("m"))

    values = F.transform("f_hz", element)
    if c.selector.band_ghz:
        values = F.filter(values, lambda x: (x["f"] / 1e9).between(*c.selector.band_ghz))
    if c.selector.in_db:
        v = F.transform(values, lambda x: F.when(x["m"] == 0, F.lit(float("-inf"))).otherwise(20 * F.log10(x["m"])))
    else:
        v = F.transform(values, lambda x: x["m"])
    over = lambda values: F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(v).cast("double"))
    mean = over(v)
    std = F.sqrt(over(F.transform(v, lambda x: (x - mean) * (x - mean))))
    of = {StdAgg: std, MaxAgg: F.array_max(v), MinAgg: F.array_min(v), MeanAgg: mean, RippleAgg: F.array_max(v) - F.array_min(v)}
    return of[type(c.aggregator)]


def running_yield(flags: DataFrame, ts: str = "ts", window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """window_start, n, n_ok by tumbling window; on a stream, rows later than ``late`` are left out."""
    rows = flags.withWatermark(ts, late) if flags.isStreaming else flags
    out = rows.groupBy(F.window(ts, window).alias("w")).agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"))
    return out.select(F.col("w.start").alias("window_start"), "n", "n_ok")


def start_to_table(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append closed windows to Parquet files, exactly once; ends when the input at hand is done."""
    return (
        result.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )

"""Arrays for models: encoding samples to x and y, and decoding them back."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweeplane.functions.complexcols import EPS, db, mag, undo
from sweeplane.functions.params import param
from sweeplane.operators.transform import resample_packed, unwrapped_deg

VERSION = 1
#: Parameters that schema inference takes as columns at most.
MAX_KEYS = 10_000
PARTS = ("real", "imag", "db", "mag", "deg")
_TAG = re.compile(r"s(\d+)_(\d+)\.(real|imag|db|mag|deg)", re.IGNORECASE)


class Backup(str, Enum):
    """What to keep of a matrix that the channels do not cover."""

    NONE = "none"
    MISSING = "missing"
    FULL = "full"


def parse_channel(tag: str) -> tuple[int, int, str]:
    """(out port, in port, part) of a tag S<i>_<j>.<part>; ports from 0."""
    found = _TAG.fullmatch(tag)
    if not found or "0" in (found[1], found[2]):
        raise ValueError(f"bad channel {tag!r}")
    return int(found[1]) - 1, int(found[2]) - 1, found[3].lower()


@dataclass(frozen=True)
class Codec:
    x_keys: tuple[str, ...]
    channels: tuple[str, ...]
    freq_hz: tuple[float, ...]
    eps_db: float = EPS
    force_resample: bool = True
    backup: Backup = Backup.NONE

    @property
    def n_ports(self) -> int:
        return 1 + max(max(parse_channel(c)[:2]) for c in self.channels)

    @classmethod
    def infer(cls, networks: DataFrame, components: tuple[str, ...] = ("real", "imag"), **options) -> Codec:
        """Keys are the sorted union over all samples; ports and grid are those of the smallest sample id.

        A codec's keys are columns of x: more than MAX_KEYS of them raise.
        """
        first = networks.orderBy("sample_id").select("n_ports", "f_hz").first()
        if first is None:
            raise ValueError("no sample to infer from")
        keys = networks.select(F.explode(F.map_keys("params")).alias("k")).distinct().orderBy("k").limit(MAX_KEYS + 1).collect()
        if len(keys) > MAX_KEYS:
            raise ValueError(f"more than {MAX_KEYS} parameters: name those that are wanted")
        ports = range(1, first["n_ports"] + 1)
        tags = tuple(f"S{i}_{j}.{part}" for part in components for i in ports for j in ports)
        return cls(tuple(r["k"] for r in keys), tags, tuple(first["f_hz"]), **options)

    def dumps(self) -> str:
        return json.dumps({"version": VERSION, **asdict(self)})

    @classmethod
    def loads(cls, text: str) -> Codec:
        data = json.loads(text)
        if data.pop("version", None) != VERSION:
            raise ValueError("the codec was written by another version")
        data["backup"] = Backup(data["backup"])
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in data.items()})

    def channel_table(self, spark) -> DataFrame:
        """c, i, j, part: a small dimension table."""
        rows = [(c, *parse_channel(tag)) for c, tag in enumerate(self.channels)]
        return spark.createDataFrame(rows, "c int, i long, j long, part string")

    def encode_x(self, networks: DataFrame, strict: bool = False) -> DataFrame:
        """sample_id, x: parameters in the order of the keys, NaN where missing; ``strict`` raises on those."""
        values: list[Column] = []
        for k in self.x_keys:
            v = param("params", k)
            if strict:
                v = F.when(F.map_contains_key("params", F.lit(k)), v).otherwise(F.raise_error(F.lit(f"missing parameter {k}")))
            values.append(v)
        return networks.select("sample_id", F.array(*values).alias("x"))

    def decode_x(self, df: DataFrame) -> DataFrame:
        keys = F.array(*(F.lit(k) for k in self.x_keys))
        return df.withColumn("params", F.map_from_arrays(keys, F.col("x")))

    def on_grid(self, networks: DataFrame) -> DataFrame:
        """Networks on the codec's grid; those that differ are resampled, or raise if that is not allowed."""
        grid = F.array(*(F.lit(f) for f in self.freq_hz))
        off = F.zip_with("f_hz", grid, lambda a, b: F.coalesce(F.abs(a - b) > 1e-3, F.lit(True)))
        marked = networks.withColumn("__off", F.exists(off, lambda x: x))
        if self.force_resample:
            other = marked.where("__off").drop("__off")
            return marked.where("NOT __off").drop("__off").unionByName(resample_packed(other, list(self.freq_hz)))
        return marked.withColumn("f_hz", F.when(F.col("__off"), F.raise_error(F.lit("a sample's grid differs"))).otherwise(F.col("f_hz"))).drop("__off")

    def encode_long(self, points: DataFrame) -> DataFrame:
        """sample_id, c, k, y: each channel's values along the sweep."""
        table = self.channel_table(points.sparkSession)
        rows = unwrapped_deg(points, "__deg") if any(t.lower().endswith(".deg") for t in self.channels) else points.withColumn("__deg", F.lit(None).cast("double"))
        met = rows.join(F.broadcast(table), ["i", "j"])
        re_, im_ = F.col("re"), F.col("im")
        value = (
            F.when(F.col("part") == "real", re_).when(F.col("part") == "imag", im_).when(F.col("part") == "mag", mag(re_, im_))
            .when(F.col("part") == "db", db(re_, im_, self.eps_db)).otherwise(F.col("__deg"))
        )
        return met.select("sample_id", "c", "k", value.alias("y"))

    def encode_s(self, points: DataFrame) -> DataFrame:
        """sample_id, y: array of channels, each an array along the sweep; with a backup also s_backup."""
        long = self.encode_long(points)
        sweep = F.transform(F.array_sort(F.collect_list(F.struct("k", "y"))), lambda s: s["y"])
        rows = long.groupBy("sample_id", "c").agg(sweep.alias("v")).groupBy("sample_id")
        out = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "v"))), lambda s: s["v"]).alias("y"))
        if self.backup is Backup.NONE:
            return out
        kept = self.backup_points(points)
        packed = F.array_sort(F.collect_list(F.struct("i", "j", "k", "re", "im")))
        return out.join(kept.groupBy("sample_id").agg(packed.alias("s_backup")), "sample_id", "left")

    def backup_points(self, points: DataFrame) -> DataFrame:
        """The points to keep: those of uncovered port pairs, or all of them if any pair is uncovered and FULL."""
        covered = {parse_channel(t)[:2] for t in self.channels}
        if self.backup is Backup.FULL:
            pairs = {(i, j) for i in range(self.n_ports) for j in range(self.n_ports)}
            return points if pairs - covered else points.where("false")
        table = points.sparkSession.createDataFrame(sorted(covered), "i long, j long")
        return points.join(F.broadcast(table), ["i", "j"], "left_anti")

    def decode_s(self, encoded: DataFrame) -> DataFrame:
        """Points from y: re and im win, then amplitude with phase, then phase or one part alone; NaN in a part is 0."""
        table = self.channel_table(encoded.sparkSession)
        rows = encoded.select("sample_id", F.posexplode("y").alias("c", "v")).select("sample_id", "c", F.posexplode("v").alias("k", "y"))
        met = rows.join(F.broadcast(table), "c")
        one = lambda *parts: F.max(F.when(F.col("part").isin(*parts), F.col("value")))
        value = F.when(F.col("part") == "db", undo(F.col("y"), "db")).when(F.col("part") == "deg", undo(F.col("y"), "deg")).otherwise(F.col("y"))
        wide = met.withColumn("value", value).groupBy("sample_id", "k", "i", "j").agg(
            one("real").alias("a"), one("imag").alias("b"), one("db", "mag").alias("amp"), one("deg").alias("phi")
        )
        a, b, amp, phi = (F.col(c) for c in ("a", "b", "amp", "phi"))
        size = F.coalesce(amp, F.lit(1.0))
        re_ = F.when(a.isNotNull(), a).when(b.isNotNull(), 0.0).when(phi.isNotNull(), size * F.cos(phi)).otherwise(amp)
        im_ = F.when(b.isNotNull(), b).when(a.isNotNull(), 0.0).when(phi.isNotNull(), size * F.sin(phi)).otherwise(0.0)
        bad = F.isnan(re_) | F.isnan(im_)
        grid = F.array(*(F.lit(f) for f in self.freq_hz))
        return wide.select(
            "sample_id", F.col("k").cast("long").alias("k"), F.get(grid, F.col("k")).alias("f_hz"), "i", "j",
            F.when(bad, 0.0).otherwise(re_).alias("re"), F.when(bad, 0.0).otherwise(im_).alias("im"),
        )

"""Secret scanning with corpus-wide ownership frequency.

Patterns give base spans. Opaque tokens outside them are candidates too weak to report on their form alone: for these,
and for the base spans' values, hashes are counted over distinct repositories and owners of the whole corpus. A value
that several owners or many repositories share is a widely copied example; one that a single owner has in few looks live. Live opaque tokens
become spans of kind ``owned``; base spans stay in either case and are counted as live or example.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweeplane.llm.common import as_row, from_row, join_heavy, join_marked, map_arrow, materialize, prepare, texts_of

# The base patterns and their least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ASSIGN_MIN = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_MIN = 18
HEX = re.compile(r"[0-9a-f]{16,}")  # runs of 16 and more are the runs of any length that do not fail

KINDS = ("assign", "access", "hex", "owned")
#: Candidates by ownership: opaque tokens with letters and digits.
OPAQUE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: A value of more owners, or in more repositories, than this is an example, not a live credential. A live one has one
#: owner, who may use it in a few repositories; what is all over an owner's repositories is a placeholder.
MAX_OWNERS = 1
MAX_REPOS = 3

#: What stands for a secret in a redacted text.
MASK = "[SECRET]"

_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_TO_HEX = bytes(104 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
_TO_OPAQUE = bytes(104 if chr(i).isascii() and (chr(i).isalnum() or chr(i) in "+/_=-") else 32 for i in range(256))


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the base patterns, by start, then kind. Offsets are code points."""
    found: list[tuple[int, int, int, str]] = []
    raw = text.encode("utf-8", "replace")
    lower = raw.lower()
    if any(k in lower for k in _KEYWORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_MIN]
    if b"h" * 16 in raw.translate(_TO_HEX):
        found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def opaque_spans(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Opaque tokens with a letter and a digit that touch no base span."""
    if b"h" * 20 not in text.encode("utf-8", "replace").translate(_TO_OPAQUE):
        return []
    out = []
    for m in OPAQUE.finditer(text):
        value = m[0]
        if any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
            if not any(s < m.end() and m.start() < e for s, _, e, _ in taken):
                out.append((m.start(), 3, m.end(), value))
    return out


_CANDIDATES = (
    "base array<struct<start:long,kind:int,end:long,hash:long>>, opaque array<struct<start:long,kind:int,end:long,hash:long>>"
)
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("hash", pa.int64())]))


def candidates(docs: DataFrame, id_col: str, text_col: str, repo: Column, owner: Column) -> DataFrame:
    """One small row a document: its spans with hashed values, who holds it, and the text's key if it has spans."""
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), repo.cast("string").alias("repo"),
        owner.cast("string").alias("owner"),
    )

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, opaque, keys = [], [], []
        for text in texts_of(batch, "text"):
            found = base_spans(text)
            for spans, out in ((found, base), (opaque_spans(text, found), opaque)):
                out.append([(s, k, e, xxhash.xxh64_intdigest(v.encode()) - (1 << 63)) for s, k, e, v in spans])
            keys.append(text_key(text) if base[-1] or opaque[-1] else None)
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("repo"), batch.column("owner"), pa.array(base, _SPAN), pa.array(opaque, _SPAN), pa.array(keys, pa.binary())],
            names=["id", "repo", "owner", "base", "opaque", "text_key"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(rows, kernel, f"id {kind}, repo string, owner string, {_CANDIDATES}, text_key binary")


def ownership(found: DataFrame) -> DataFrame:
    """Per value hash: hits, distinct repositories and distinct owners over the whole corpus.

    A repository is its owner's: one name under two owners counts twice. Counted in two steps of partial aggregation, so a value that is everywhere is a few rows a task.
    """
    spans = found.select(F.explode(F.concat("base", "opaque")).alias("s"), "repo", "owner").select("s.hash", "repo", "owner")
    by_repo = spans.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repos"))
    return by_owner.groupBy("hash").agg(
        F.sum("n").alias("hits"), F.sum("repos").alias("repos"), F.count("*").alias("owners")
    )


def scan_secrets(
    docs: DataFrame, repo: Column, owner: Column, id_col: str = "doc_id", text_col: str = "text",
    max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS,
) -> DataFrame:
    """Every whole text's secrets: id, n_assign, n_access, n_hex, n_owned, n_live, n_example, spans array<struct>,
    text_key (the text's hash; null where the text has no candidate).

    ``spans`` (start, kind, end, live, repos, owners) are by start, then kind; offsets are code points, the end exclusive. Null texts
    are empty. A null repository or owner counts as one value. Each row gives one row, repeated rows and null ids
    included; an empty table gives none. Other columns are not looked at.
    """
    prepare(docs.sparkSession)
    found = candidates(docs, id_col, text_col, repo, owner).withColumn("uid", F.monotonically_increasing_id())
    found = materialize(found, "candidates")
    counts = ownership(found)
    rows = found.count()
    hits = found.select("uid", F.explode(F.concat("base", "opaque")).alias("s")).select("uid", "s.*")
    judged = join_heavy(hits, materialize(counts.select("hash", "hits", "repos", "owners"), "ownership", 4 * rows), "hash", "hits")
    judged = judged.withColumn("live", (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)).where("kind < 3 OR live")
    per_doc = judged.groupBy("uid").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end", "live", "repos", "owners"))).alias("spans"),
        *(F.count_if(F.col("kind") == k).alias(f"n_{name}") for k, name in enumerate(KINDS)),
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_example"),
    )
    counted = [f"n_{name}" for name in KINDS] + ["n_live", "n_example"]
    bare = found.where((F.size("base") == 0) & (F.size("opaque") == 0))
    some = found.where((F.size("base") > 0) | (F.size("opaque") > 0)).select("uid", "id", "text_key")
    empty = F.from_json(F.lit("[]"), per_doc.schema["spans"].dataType)
    none = bare.select(F.col("id").alias(id_col), *(F.lit(0).cast("long").alias(c) for c in counted), empty.alias("spans"), "text_key")
    with_some = some.join(per_doc, "uid", "left").select(
        F.col("id").alias(id_col),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counted),
        F.coalesce("spans", empty).alias("spans"), "text_key",
    )
    return none.unionByName(with_some)


def span_text(spans: str, keep: Column | None = None) -> Column:
    """kind:start:end of the spans, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    items = F.filter(spans, lambda s: s["kind"] < 3) if keep is not None else F.col(spans)
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.concat_ws(",", F.transform(items, one))


def redact(docs: DataFrame, scanned: DataFrame, text_col: str = "text", mask: str = MASK) -> DataFrame:
    """``docs`` with every span of ``scanned`` replaced by ``mask``; all columns and clean rows as they were.

    Base spans are found again in the text at hand; ``owned`` ones, which the whole corpus decides on, are taken from the
    scan by a hash of the text, on which alone a scan's spans depend: ids may be null, repeat, or stand for several texts.
    Where such spans are too many to broadcast, only rows that may be one of their texts are shuffled. Columns may have any names. Null and empty texts stay as they are, each repeated row is
    masked for itself, spans that overlap become one mask, and an empty table gives no rows.
    """
    owned = scanned.where(F.exists("spans", lambda s: s["kind"] == 3)).groupBy(F.col("text_key").alias("key"))
    cut = F.transform(F.filter(F.first("spans"), lambda s: s["kind"] == 3), lambda s: F.struct(s["start"], s["end"]))
    owned = materialize(owned.agg(cut.alias("owned")), "owned", docs.count())
    key = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))

    @F.arrow_udf("string")
    def masked(texts: pa.Array, owned: pa.Array) -> pa.Array:
        """The masked text; null where nothing is masked."""
        out: list[str | None] = []
        for text, spans in zip(texts.to_pylist(), owned.to_pylist(), strict=True):
            cuts = [(s, e) for s, _, e, _ in base_spans(text or "")] + [(c["start"], c["end"]) for c in spans or ()]
            parts, at = [], 0
            for s, e in _union(cuts):
                parts += [text[at:s], mask]
                at = e
            out.append("".join([*parts, text[at:]]) if cuts else None)
        return pa.array(out, pa.string())

    rows = docs.select(as_row(docs).alias("row"), F.col(text_col).alias("text"), key.alias("key"))
    # A text's spans are a row of any length, so they are what is counted before a broadcast.
    met = join_marked(rows, owned, "key", "left", 1 + F.size("owned"))
    met = met.select("row", F.coalesce(masked("text", "owned"), "text").alias("text"))
    return met.select(*(F.col("text").alias(c) if c == text_col else out for c, out in zip(docs.columns, from_row(docs), strict=True)))


def text_key(text: str) -> bytes:
    """SHA-256 of the text, as Spark's ``sha2`` gives it too."""
    return hashlib.sha256(text.encode("utf-8", "replace")).digest()


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping spans as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def op1(docs: DataFrame) -> DataFrame:
    """The contract's columns; repository = source and language, owner = source. span_counts: repositories:owners of each span."""
    out = scan_secrets(docs, F.concat_ws("/", F.col("source"), F.col("lang")), F.col("source"))
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(span_text("spans", F.lit(True)), 256).alias("base_sha256"),
        span_text("spans").alias("spans"), "n_owned", "n_live", "n_example",
        F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s["repos"].cast("string"), s["owners"].cast("string")))).alias("span_counts"),
    )

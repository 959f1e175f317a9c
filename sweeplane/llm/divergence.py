"""Source divergence audit: how the term frequencies of a language's sources differ, with strings materialised late.

Texts are split once, in the tasks that read them. Each writes its counts by language and term, those of the language's
sources side by side, with the term's 64-bit digest; counts are shuffled and added up by digest alone. The least and the greatest string of a digest tell
whether two terms share it; only digests frequent enough to be kept are asked, and only for those are strings shuffled, two
a task. The few digests that collide are split: their counts are added up again by string, and each of their terms has a
slot of its own. All else goes by (digest, slot), until the rows to return are known; just these are joined to their text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sweeplane.llm.common import join_marked, mark_keys, materialize, prepare

#: Least documents of a language that hold a term which is kept.
LEAST_DOCS = 30
#: Added to every count.
PRIOR = 5
#: Frequencies are in parts of this.
UNIT = 1_000_000_000
#: Ranks that part ``term`` goes to.
TERM_RANKS = 50
#: Distinct terms, summed over its groups, that a task counts before it writes them.
TASK_TERMS = 1 << 19
#: Kept terms of a language whose frequencies in up to SOURCES sources are compared at once.
TERMS, SOURCES = 2048, 64

# Bytes of terms: letters, those in capitals as small ones, and all of a character beyond ASCII. Any other is a space.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame, digest_bits: int) -> DataFrame:
    """lid, digest, term, docs, n (occurrences), gids and ns (the occurrences in each group): of each task, for each flush
    of its counters. A language's term is one row with its groups side by side."""
    mask = (1 << digest_bits) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, tuple[Counter, dict[int, Counter]]] = {}
        for batch in batches:
            for lid, gid, text in zip(batch.column("lid").to_pylist(), batch.column("gid").to_pylist(), batch.column("text"), strict=True):
                data = text.as_buffer()
                if data is None or not data.size:
                    continue
                terms = data.to_pybytes().translate(_TERM_BYTES).split()
                docs, by_group = counts.setdefault(lid, (Counter(), {}))
                docs.update(set(terms))
                by_group.setdefault(gid, Counter()).update(terms)
            if sum(len(n) for _, by_group in counts.values() for n in by_group.values()) >= TASK_TERMS:
                yield from _flushed(counts, mask)
                counts = {}
        yield from _flushed(counts, mask)

    schema = "lid long, digest long, term binary, docs long, n long, gids array<long>, ns array<long>"
    return docs.select("lid", "gid", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def _flushed(counts: dict[int, tuple[Counter, dict[int, Counter]]], mask: int) -> Iterator[pa.RecordBatch]:
    for lid, (docs, by_group) in counts.items():
        terms = list(docs)
        place = dict(zip(terms, range(len(terms)), strict=True))
        at = np.concatenate([np.fromiter(map(place.__getitem__, n), np.int64, len(n)) for n in by_group.values()])
        gids = np.repeat(list(by_group), [len(n) for n in by_group.values()])
        ns = np.concatenate([np.fromiter(n.values(), np.int64, len(n)) for n in by_group.values()])
        order = np.argsort(at, kind="stable")
        at, gids, ns = at[order], gids[order], ns[order]
        ends = np.searchsorted(at, np.arange(len(terms) + 1)).astype(np.int32)
        totals = np.add.reduceat(ns, ends[:-1]) if len(terms) else ns
        digests = np.array([xxhash.xxh64_intdigest(t) & mask for t in terms], dtype=np.uint64).view(np.int64)
        batch = pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(terms), lid)), pa.array(digests), pa.array(terms, pa.binary()), pa.array(list(docs.values()), pa.int64()), pa.array(totals),
                pa.ListArray.from_arrays(ends, gids), pa.ListArray.from_arrays(ends, ns),
            ],
            names=["lid", "digest", "term", "docs", "n", "gids", "ns"],
        )
        yield from (batch.slice(start, 1 << 14) for start in range(0, len(terms), 1 << 14))


def grouped(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """(gid, lid, lang, source) of every group that occurs, and (gid, text) of the documents."""
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    pairs = materialize(named.select("lang", "source").distinct(), "pairs").withColumn("gid", F.monotonically_increasing_id())
    groups = materialize(pairs, "groups")
    # A language is known by the least of its groups.
    langs = groups.groupBy("lang").agg(F.min("gid").alias("lid"))
    groups = materialize(groups.join(langs, "lang").select("gid", "lid", "lang", "source"), "groups")
    keys = groups.select(F.struct("lang", "source").alias("pair"), "gid", "lid")
    rows = named.select(F.struct("lang", "source").alias("pair"), "text")
    return groups, join_marked(rows, keys, "pair", "left").select("gid", "lid", "text")


def kept_terms(raw: DataFrame, least_docs: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts (gid, lid, digest, slot, n) of the kept terms; (lid, digest, slot, n) of their languages; and the strings
    (digest, slot, term) of the digests asked for.

    Documents of a digest are at least those of each of its terms, so no term that is kept is missed before the split. Groups
    are counted for frequent digests alone, and unfolded behind the shuffle.
    """
    by_lang = lambda df, *key: df.groupBy("lid", *key).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    frequent = materialize(by_lang(raw, "digest").drop("docs"), "frequent")
    asked = frequent.select("digest").distinct()
    # The marks leave out most rows of digests that are not asked for; the join all others.
    marks = mark_keys(asked, "digest")
    told = marks.rows(raw.select("digest", "term"), True, "digest").groupBy("digest")
    told = materialize(told.agg(F.min("term").alias("least"), F.max("term").alias("greatest")).join(asked, "digest"), "told")
    shared = materialize(told.where("least <> greatest").select("digest"), "shared")
    zero = F.lit(0).cast("long").alias("slot")
    split = materialize(join_marked(raw, shared, "digest", "inner"), "split")
    # A slot is the term's rank among those of its digest: no more than collide.
    slots = split.select("digest", "term").distinct().withColumn("slot", F.row_number().over(Window.partitionBy("digest").orderBy("term")).cast("long"))
    slots = materialize(slots, "slots")
    parted = split.join(slots, ["digest", "term"]).drop("term")
    kept_split = by_lang(parted, "digest", "slot").drop("docs")
    langs = frequent.join(shared, "digest", "left_anti").select("lid", "digest", zero, "n")
    langs = materialize(langs.unionByName(kept_split.select(langs.columns)), "kept")
    key = ["lid", "digest", "slot"]
    whole = marks.rows(raw.select("lid", "digest", zero, "gids", "ns"), True, "digest")
    both = whole.unionByName(parted.select(whole.columns)).join(langs.select(key), key, "left_semi")
    each = both.select(*key, F.explode(F.arrays_zip("gids", "ns")).alias("e"))
    counts = materialize(each.groupBy(*key, F.col("e.gids").alias("gid")).agg(F.sum("e.ns").alias("n")), "counts")
    strings = told.where("least = greatest").select("digest", zero, F.col("least").alias("term"))
    return counts, langs, strings.unionByName(slots.select("digest", "slot", "term"))


def share(n: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(UNIT (n + PRIOR) / (total + PRIOR kinds)), exactly, for totals of up to 18 digits."""
    big = lambda c: c.cast("decimal(19,0)")
    over, under = big(n + PRIOR) * F.lit(UNIT).cast("decimal(10,0)"), big(total + PRIOR * kinds)
    return ((over - over % under) / under).cast("long") + 1


def _distances(counts: pd.DataFrame, sides: pd.DataFrame) -> pd.DataFrame:
    """One chunk of a language's terms and two blocks of its sources: sums of |p - q| for each pair of one with the other."""
    terms = int(sides["terms"].iloc[0]) if len(sides) else 0
    first, second = sides[sides["side"] == 0], sides[sides["side"] == 1]
    a, b = _shares(counts, first, terms), _shares(counts, second, terms)
    total = np.zeros((len(a), len(b)), dtype=np.int64)
    for n in range(len(a)):
        total[n] = np.abs(b - a[n]).sum(axis=1)
    row, col = np.indices(total.shape)
    return pd.DataFrame({"gid": first["gid"].to_numpy()[row.ravel()], "other": second["gid"].to_numpy()[col.ravel()], "value": total.ravel()})


def _shares(counts: pd.DataFrame, sources: pd.DataFrame, terms: int) -> np.ndarray:
    """The frequencies of each source at the chunk's terms, those it does not have included."""
    out = np.repeat(sources["p0"].to_numpy()[:, None], terms, axis=1)
    place = pd.Series(np.arange(len(sources)), index=sources["gid"].to_numpy())
    mine = counts[counts["gid"].isin(place.index)]
    out[place[mine["gid"]].to_numpy(), mine["at"].to_numpy()] = mine["p"].to_numpy()
    return out


def pair_distances(counts: DataFrame, langs: DataFrame, groups: DataFrame) -> DataFrame:
    """gid, other, value: the distances of all sources of a language in one order of each pair. Terms meet in chunks, sources in blocks.

    ``counts`` has p, ``groups`` p0, the frequency of a term that a source does not have. No row is made of a pair and a term: a chunk of
    TERMS terms gives one row for each pair.
    """
    # Places of the terms within their language's chunks, by running numbers within a bucket of digests.
    buckets = 4096
    bucket = F.pmod(F.xxhash64("digest", "slot"), F.lit(buckets))
    placed = langs.select("lid", "digest", "slot").withColumn("bucket", bucket)
    sizes = placed.groupBy("lid", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("lid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("lid", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("lid", "bucket").orderBy("digest", "slot")) - 1
    placed = placed.withColumn("within", within).join(starts, ["lid", "bucket"])
    placed = placed.select("lid", "digest", "slot", (F.col("start") + F.col("within")).alias("place"))
    chunk, at = F.expr(f"place div {TERMS}").alias("chunk"), (F.col("place") % TERMS).alias("at")
    # Sources in blocks, by their rank within the language: as many rows as the result has sources.
    rank = F.row_number().over(Window.partitionBy("lid").orderBy("gid")) - 1
    blocked = materialize(groups.withColumn("block", F.floor(rank / SOURCES)), "blocked")
    blocks = blocked.groupBy("lid").agg((F.max("block") + 1).alias("blocks"), F.first("kinds").alias("kinds")).where("kinds > 0")
    tag = lambda a, b, side: F.struct(a.alias("a"), b.alias("b"), F.lit(side).alias("side"))
    mine = F.col("block")
    others = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    of_pairs = F.concat(
        F.transform(F.filter(others, lambda b: b >= mine), lambda b: tag(mine, b, 0)), F.transform(F.filter(others, lambda a: a <= mine), lambda a: tag(a, mine, 1))
    )
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(kinds - 1) div {TERMS}")))
    sides = blocked.drop("kinds").join(blocks, "lid").withColumn("t", F.explode(of_pairs)).withColumn("chunk", chunks)
    terms = F.least(F.lit(TERMS), F.col("kinds") - F.col("chunk") * TERMS).cast("long")
    sides = sides.select("lid", "chunk", "t.*", "gid", "p0", terms.alias("terms"))
    met = counts.join(placed, ["lid", "digest", "slot"]).select("gid", "lid", chunk, at, "p").join(blocked.select("gid", "block"), "gid")
    met = met.join(blocks.select("lid", "blocks"), "lid").withColumn("t", F.explode(F.array_distinct(F.transform(of_pairs, lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"))))))
    met = met.select("lid", "chunk", "t.*", "gid", "at", "p")
    key = ("lid", "chunk", "a", "b")
    parts = met.groupBy(*key).cogroup(sides.groupBy(*key)).applyInPandas(_distances, "gid long, other long, value long")
    return parts.where("gid < other").groupBy("gid", "other").agg(F.sum("value").alias("value"))


def source_divergence(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS,
    term_ranks: int = TERM_RANKS, digest_bits: int = 64,
) -> DataFrame:
    """lang, source, part, item, value, rank: each source's distances to the others of its language, and its salient terms.

    Null texts, languages and sources are empty strings. Terms are runs of letters A to Z, in small, and of characters beyond
    ASCII; whole texts of any length are counted. Ties in value go by item, in UTF-8. Each row counts as a document, repeated
    ones too. A language that keeps no term has distances of 0 and no term; one of a single source no distance; an empty
    table gives no rows. Other columns are not looked at. ``digest_bits`` is for tests of collisions.
    """
    prepare(docs.sparkSession)
    groups, texts = grouped(docs, text_col, lang_col, source_col)
    raw = materialize(term_counts(texts, digest_bits), "term_counts")
    counts, langs, strings = kept_terms(raw, least_docs)
    of_lang = langs.groupBy("lid").agg(F.count("*").alias("kinds"), F.sum("n").alias("lang_total"))
    totals = counts.groupBy("gid").agg(F.sum("n").alias("total"))
    groups = groups.join(of_lang, "lid", "left").join(totals, "gid", "left").fillna(0, ["kinds", "lang_total", "total"])
    rare = F.when(F.col("kinds") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("kinds")))
    groups = materialize(groups.withColumn("p0", rare), "totals")
    measured = counts.join(groups.select("gid", "total", "kinds", "lang_total"), "gid")
    measured = materialize(measured.select("gid", "lid", "digest", "slot", "lang_total", "kinds", share(F.col("n"), F.col("total"), F.col("kinds")).alias("p")), "measured")
    found = pair_distances(measured.drop("lang_total", "kinds"), langs, groups.select("gid", "lid", "kinds", "p0"))
    both = found.unionByName(found.select(F.col("other").alias("gid"), F.col("gid").alias("other"), "value"))
    names = groups.select("gid", "lid", "lang", "source")
    others = names.select(F.col("gid").alias("other"), "lid", F.col("source").alias("item"))
    # All pairs of a language's sources are what is asked for.
    pairs = names.join(others, "lid").where("gid <> other").join(both, ["gid", "other"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("kinds"))
    salient = measured.join(langs.withColumnRenamed("n", "lang_n"), ["lid", "digest", "slot"]).withColumn("value", F.col("p") - q).where("value > 0")
    # Ranks before strings are known: all terms that tie with the last rank stay for now.
    near = salient.withColumn("at", F.rank().over(Window.partitionBy("gid").orderBy(F.desc("value")))).where(F.col("at") <= term_ranks)
    told = near.select("gid", "digest", "slot", "value").join(strings, ["digest", "slot"]).join(names, "gid")
    terms = told.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.unionByName(terms).withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= term_ranks))


#: SQL of op13 for DuckDB.
OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
        1 + (1000000000 * (coalesce(c.n, 0) + 5)::HUGEINT) // (coalesce(n.total, 0) + 5 * v.v)::HUGEINT AS p, 1 + (1000000000 * (k.n + 5)::HUGEINT) // (v.total + 5 * v.v)::HUGEINT AS q
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source) LEFT JOIN c USING (lang, source, term)),
f AS (SELECT a.lang, a.source, b.source AS other, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.other = b.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
WHERE part = 'pair' OR rank <= 50
"""

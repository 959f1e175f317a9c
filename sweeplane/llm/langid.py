"""Language identification by nearest centroid.

Texts become TF-IDF vectors of hashed byte n-grams, at length one. Every language of the table has several centroids,
from spherical k-means on a bounded sample of its labelled rows, in a task of its own. Document frequencies (by language,
then averaged), and the cosines that the bounds of rejection come from, are counted over all labelled rows. A text gets the language of the centroid of
highest cosine; below the language's least cosine it counts as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sweeplane.llm.common import blocks, bucket_of, held_out, map_arrow, prepare

#: Buckets of hashed n-grams.
DIMS = 1 << 13
#: Ids of each language the model is fitted on, about (a language of up to a fifth more is taken whole); centroids of each.
LANGUAGE_ROWS = 600
CENTROIDS = 4
#: Fitting raises above so many languages: the model, 128 kB of each, is on the driver and in every worker.
MOST_LANGUAGES = 1024
#: A text is rejected below this share of the cosine that all but REJECT_TAIL of its language's rows reach, in steps of
#: 1 / STEPS. A text of less than FULL_SIZE n-grams cannot come as close to a centroid; its bound falls with the root of its size.
REJECT_SHARE = 0.25
REJECT_TAIL = 0.01
STEPS = 1000
FULL_SIZE = 400

_LETTER = np.zeros(256, dtype=np.uint8)
_LETTER[128:] = np.arange(128, 256)
_LETTER[97:123] = np.arange(97, 123)
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)


def ngram_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of each text's hashed two- and three-byte n-grams of letters and word edges."""
    data = _LETTER[np.frombuffer((b" " + b"  ".join(texts) + b"  ").lower(), dtype=np.uint8)].astype(np.uint32)
    row = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    a, b, c = data[:-2], data[1:-1], data[2:]
    inner = np.flatnonzero(b)
    a, b, c, row = a[inner], b[inner], c[inner], row[inner] * DIMS
    shift = np.uint32(32 - DIMS.bit_length() + 1)
    three = (a * _MIX[0] ^ b * _MIX[1] ^ c * _MIX[2]) * _MIX[3] >> shift
    two = (b * _MIX[2] ^ c * _MIX[0]) * _MIX[1] >> shift
    total = len(texts) * DIMS
    counts = np.bincount(row + three, minlength=total) + np.bincount(row + two, minlength=total)
    return counts.reshape(len(texts), DIMS)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass(frozen=True)
class LanguageModel:
    """Centroids in rows, the language of each, inverse document frequencies, and the least cosine by language."""

    languages: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    least: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts).astype(np.float32) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def nearest(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's language (an index), cosine, and n-grams; -1 and 0 where there is no model or no n-gram."""
        best, score, size = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
        if len(self.centroids):
            for lo, hi in blocks([len(t) + 4000 for t in texts]):
                counts = ngram_counts(texts[lo:hi])
                size[lo:hi] = counts.sum(axis=1)
                sims = self.vectors(counts) @ self.centroids.T
                top = sims.argmax(axis=1)
                best[lo:hi], score[lo:hi] = self.owner[top], np.clip(sims[np.arange(hi - lo), top], 0, 1)
        return best, score, size

    def cosines(self, texts: list[bytes], languages: list[int]) -> np.ndarray:
        """Each text's cosine with the nearest centroid of the language given for it."""
        out, asked = np.zeros(len(texts)), np.array(languages, dtype=np.int64)
        for lo, hi in blocks([len(t) + 4000 for t in texts]):
            sims = self.vectors(ngram_counts(texts[lo:hi])) @ self.centroids.T
            sims[self.owner[None, :] != asked[lo:hi, None]] = 0
            out[lo:hi] = np.clip(sims.max(axis=1), 0, 1)
        return out


def _spherical_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means by cosine; starts from rows far from those already chosen."""
    chosen = [0]
    near = x @ x[0]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    centers = x[chosen]
    for _ in range(rounds):
        of = (x @ centers.T).argmax(axis=1)
        sums = np.stack([x[of == c].sum(axis=0) if (of == c).any() else centers[c] for c in range(len(centers))])
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return centers


def _no_model() -> LanguageModel:
    return LanguageModel([], np.zeros(0, int), np.zeros((0, DIMS), np.float32), np.ones(DIMS, np.float32), np.zeros(0))


def _sample(rows: DataFrame) -> DataFrame:
    """lang, place (a hash of the id), x (n-gram counts' logarithms) of about LANGUAGE_ROWS ids of every language."""
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("id").alias("n"))
    chance = F.when(F.col("n") <= 1.2 * LANGUAGE_ROWS, 1.0).otherwise(LANGUAGE_ROWS / F.col("n"))
    place = F.xxhash64("id", F.lit(11))
    near = rows.join(F.broadcast(sizes), "lang").where(F.pmod(place, F.lit(1_000_000)) / 1_000_000 < chance)
    once = near.groupBy("id", "lang").agg(F.min("text").alias("text")).select("lang", place.alias("place"), "text")

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t.as_py() for t in batch.column("text").cast(pa.binary())]
        out = []
        for lo, hi in blocks([len(t) + 4000 for t in texts]):
            out += [r.tobytes() for r in np.log1p(ngram_counts(texts[lo:hi])).astype(np.float16)]
        return pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("place"), pa.array(out, pa.binary())], names=["lang", "place", "x"])

    return map_arrow(once, kernel, "lang string, place long, x binary")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float16).reshape(-1, DIMS).astype(np.float32)


def _shares(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Languages, and the share of a language's rows that each bucket is in, averaged over the languages.

    So a language does not count for more by having more rows. A task gives one row for each language and bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist())
            texts = [t.as_py() for t in batch.column("text").cast(pa.binary())]
            for lo, hi in blocks([len(t) + 4000 for t in texts]):
                found = ngram_counts(texts[lo:hi]) > 0
                for lang in np.unique(langs[lo:hi]):
                    own = langs[lo:hi] == lang
                    total = totals.setdefault(str(lang), np.zeros(DIMS + 1, dtype=np.int64))  # the last place counts rows
                    total[:DIMS] += found[own].sum(axis=0)
                    total[DIMS] += own.sum()
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(total[at])], names=["lang", "bucket", "n"])

    counts = rows.select("text", "lang").mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    size = F.max(F.when(F.col("bucket") == DIMS, F.col("n"))).over(Window.partitionBy("lang"))  # DIMS + 1 rows a language
    shares = counts.withColumn("rows", size).groupBy("bucket").agg(F.sum(F.col("n") / F.col("rows")).alias("share"))
    out = np.zeros(DIMS + 1)
    for r in shares.collect():
        out[r["bucket"]] = r["share"]
    return int(round(out[DIMS])), out[:DIMS] / max(1.0, out[DIMS])


def _tails(rows: DataFrame, model: LanguageModel) -> dict[str, float]:
    """For each language, the cosine with their own centroids that all but REJECT_TAIL of its rows reach."""
    shared = rows.sparkSession.sparkContext.broadcast((model, {name: n for n, name in enumerate(model.languages)}))

    @F.arrow_udf("long")
    def step(texts: pa.Array, langs: pa.Array) -> pa.Array:
        model, number = shared.value
        own = [number[name] for name in langs.to_pylist()]
        return pa.array((model.cosines([t.as_py() for t in texts.cast(pa.binary())], own) * STEPS).astype(np.int64))

    steps = rows.select("lang", step("text", "lang").alias("step")).groupBy("lang", "step").agg(F.count("*").alias("n"))
    found = steps.groupBy("lang").agg(F.percentile("step", F.lit(REJECT_TAIL), F.col("n")).alias("step")).collect()
    return {r["lang"]: r["step"] / STEPS for r in found}


def fit_languages(
    docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bounds: bool = True
) -> LanguageModel:
    """Fit on rows where ``learn`` holds and id, text and language are not null; every language of theirs is learned.

    Centroids come from about LANGUAGE_ROWS of a language's ids, picked by a hash of the id, so any partitioning gives one
    model; a rare one is fitted on all of them. An id that repeats counts once for each language there. Document
    frequencies and, unless ``bounds`` is false, the least cosines come from all rows. Each language is fitted in its
    own task, and only CENTROIDS rows of DIMS numbers of each (128 kB) reach the driver: the model grows with the
    number of languages, not with the rows, and above MOST_LANGUAGES of them fitting raises. Without a row there is no centroid.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), learn.alias("learn"))
    rows = rows.where(F.col("learn") & F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull()).drop("learn")
    languages, share = _shares(rows)
    if not languages:
        return _no_model()
    if languages > MOST_LANGUAGES:
        raise ValueError(f"{languages} values of {lang_col}, over MOST_LANGUAGES ({MOST_LANGUAGES}): clean the column first")
    count = languages * LANGUAGE_ROWS
    idf = (np.log((1 + count) / (1 + count * share)) + 0.1).astype(np.float32)

    def fit(group: pa.Table) -> pa.Table:
        group = group.sort_by([("place", "ascending"), ("x", "ascending")])
        own = _matrix(group.column("x")) * idf
        own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)
        centers = _spherical_means(own, CENTROIDS).astype(np.float32)
        return pa.table({"lang": group.column("lang")[:1], "centers": pa.array([centers.tobytes()], pa.binary())})

    fitted = _sample(rows).groupBy("lang").applyInArrow(fit, "lang string, centers binary").collect()
    fitted.sort(key=lambda r: r["lang"])
    centers = [np.frombuffer(r["centers"], dtype=np.float32).reshape(-1, DIMS) for r in fitted]
    owner = np.repeat(np.arange(len(fitted)), [len(c) for c in centers])
    model = LanguageModel([r["lang"] for r in fitted], owner, np.concatenate(centers), idf, np.zeros(len(fitted)))
    if not bounds:
        return model
    tails = _tails(rows, model)
    return replace(model, least=REJECT_SHARE * np.array([tails[name] for name in model.languages]))


def identify(texts: list[str], model: LanguageModel) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language (``und`` without a letter or a model), cosine, and whether each text is rejected."""
    best, score, size = model.nearest([t.encode("utf-8", "replace") for t in texts])
    lettered = np.array([has_letter(t) for t in texts], dtype=bool)
    known = lettered & (best >= 0)
    names = [model.languages[b] if k else "und" for b, k in zip(best, known, strict=True)]
    rejected = ~known
    rejected[known] = score[known] < model.least[best[known]] * np.sqrt(np.minimum(size[known] / FULL_SIZE, 1))
    return names, np.where(known, score, 0.0), rejected


def detect_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, rejected for every whole text.

    Null texts and texts without a letter are ``und``, with score 0, and rejected. Of equal cosines the first language in
    order counts. Each row gives one row, repeated rows and null ids included; an empty table gives none; other columns
    are not looked at. Without a row to learn from all texts are ``und``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(text_col).to_pylist()]
        names, score, rejected = identify(texts, shared.value)
        return pa.RecordBatch.from_arrays(
            [batch.column(id_col), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)],
            names=[id_col, "lang_pred", "score", "rejected"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, text_col), kernel, f"{id_col} {kind}, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` without the rejected rows, all columns as they were.

    Null texts and texts without a letter are rejected. Each repeated row is judged for itself, null ids too; of equal
    cosines the centroid of the first language in order counts; an empty table gives no rows. Only the text goes through
    Python.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def told(texts: pa.Array) -> pa.Array:
        _, _, rejected = identify([t or "" for t in texts.to_pylist()], shared.value)
        return pa.array(~rejected)

    return docs.where(told(F.col(text_col)))


def learn_rows(id_col: str = "doc_id") -> Column:
    """Rows the contract lets the model learn from: crc32 of the id modulo 4 is not 2."""
    return F.coalesce(bucket_of(id_col, 4) != 2, F.lit(False))


def op3(docs: DataFrame) -> DataFrame:
    """The contract's columns, and ``rejected``."""
    found = detect_language(docs, fit_languages(docs, learn_rows()))
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "rejected")

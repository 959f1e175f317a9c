"""Toxicity: a convolutional text classifier in numpy, with thresholds by language.

A word's embedding is the sum of two table rows: one picked by the word's hash, one by that of its first bytes. Filters of several widths slide over a text's
words; each keeps its greatest response in the whole text; a linear layer gives the logit. After training, a threshold
is chosen for each language on all labelled rows that were not trained on, and scores are shifted so that 0.5 is the threshold of the text's
language. That language comes from the text, by the nearest-centroid model.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweeplane.llm.common import blocks, bucket_of, classes, hash_tokens, held_out, map_arrow, mark_keys, prepare
from sweeplane.llm.labelled import known_labels, labelled_sample, score_rows
from sweeplane.llm.langid import LanguageModel, fit_languages

#: Rows of each table, first bytes of a word that have a row of their own, components of an embedding, filter widths in words, filters of each width.
BUCKETS = 1 << 16
PREFIX = 4
DIMS = 16
WIDTHS = (1, 2, 3)
FILTERS = 12
#: Rows the model is sampled from at most; of each four, one is not trained on, so that thresholds have rows in small tables too.
SAMPLE_ROWS = 3600
EPOCHS = 8
#: A parameter of the fit: rows of either label a language needs for a threshold of its own. ``shift`` lists those that have one.
LEAST_ROWS = 12
#: Logits are counted for thresholds in steps of 1 / STEPS, up to REACH to either side.
STEPS = 128
REACH = 40
_TOKENS = classes("words")
_PAD = max(WIDTHS)  # so that each filter has a place even in a text without words


def word_rows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each word's two table rows in one integer, and where each text ends."""
    whole, begin, ends = hash_tokens([t.lower() for t in texts], _TOKENS, PREFIX)
    rows = (whole >> np.uint64(48)) << np.uint64(16) | begin >> np.uint64(48)
    return rows.astype(np.uint32).view(np.int32), ends


def split_features(texts: list[bytes]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for lo, hi in blocks([len(t) for t in texts]):
        words, ends = word_rows(texts[lo:hi])
        out += np.split(words, ends[:-1])
    return out


def _lay_out(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of both tables with padding behind each text (the last row of a table), and each text's first place."""
    n = np.diff(np.append(0, ends))
    begins = np.append(0, ends[:-1]) + np.arange(len(ends)) * _PAD
    first = np.full(len(words) + len(ends) * _PAD, BUCKETS, dtype=np.int64)
    second = first.copy()
    at = np.arange(len(words)) + np.repeat(np.arange(len(ends)) * _PAD, n)
    raw = words.view(np.uint32)
    first[at], second[at] = raw >> 16, raw & 0xFFFF
    return first, second, begins, n


def _responses(x: np.ndarray, w: np.ndarray, b: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Each filter's response in every place; minus infinity where its window would reach the next text's words."""
    places = len(x) - len(w) + 1
    r = sum(x[o : o + places] @ w[o] for o in range(len(w))) + b
    for o in range(1, len(w)):
        r[begins[1:] - o] = -np.inf
    return r


@dataclass
class ToxicityModel:
    tables: np.ndarray  # (2, BUCKETS + 1, DIMS); the last row is padding
    filters: list[np.ndarray]  # (width, DIMS, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    base: float
    languages: LanguageModel | None
    shift: dict[int, float]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"tables": self.tables.astype(np.float32)}

    def pooled(self, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The greatest response of each filter in each text; a text without words has those of padding."""
        first, second, begins, _ = _lay_out(words, ends)
        x = self.tables[0][first] + self.tables[1][second]
        parts = []
        for w, b in zip(self.filters, self.bias, strict=True):
            parts.append(np.maximum(np.maximum.reduceat(_responses(x, w, b, begins), begins, axis=0), 0))
        return np.concatenate(parts, axis=1)

    def raw(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        for lo, hi in blocks([len(t) for t in texts], 1 << 18):
            out[lo:hi] = self.pooled(*word_rows(texts[lo:hi])) @ self.out + self.base
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        z = self.raw(texts)
        if self.languages is not None and self.shift:
            spoken, _, _ = self.languages.nearest(texts)
            z = z - np.array([self.shift.get(int(s), self.shift[-1]) for s in spoken])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(words: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.05) -> ToxicityModel:
    """By AdaGrad; gradients flow only through the places of greatest response."""
    rng = np.random.default_rng(3)
    tables = rng.normal(0, 0.05, (2, BUCKETS + 1, DIMS)).astype(np.float32)
    tables[:, BUCKETS] = 0
    model = ToxicityModel(
        tables, [rng.normal(0, 0.3, (w, DIMS, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), 0.0, None, {},
    )
    seen = [np.full_like(tables, 1e-2), [np.full_like(f, 1e-2) for f in model.filters], [np.full_like(b, 1e-2) for b in model.bias], np.full_like(model.out, 1e-2), 1e-2]
    for _ in range(epochs):
        order = rng.permutation(len(words))
        for at in range(0, len(order), 32):
            batch = order[at : at + 32]
            flat = np.concatenate([words[i] for i in batch])
            ends = np.cumsum([len(words[i]) for i in batch])
            first, second, begins, _ = _lay_out(flat, ends)
            x = tables[0][first] + tables[1][second]
            pooled, places = [], []
            stops = np.append(begins[1:], len(x))
            for w, b in zip(model.filters, model.bias, strict=True):
                count = len(x) - len(w) + 1
                r = _responses(x, w, b, begins)
                where = np.stack([lo + r[lo : min(hi, count)].argmax(axis=0) for lo, hi in zip(begins, stops, strict=True)])
                places.append(where)
                pooled.append(r[where, np.arange(FILTERS)])
            top = np.concatenate(pooled, axis=1)
            active = np.maximum(top, 0)
            error = ((1 / (1 + np.exp(-np.clip(active @ model.out + model.base, -40, 40))) - y[batch]) / len(batch)).astype(np.float32)
            back = np.outer(error, model.out) * (top > 0)
            g_out, g_base = active.T @ error + 1e-4 * model.out, float(error.sum())
            rows, grads = [], []
            for i, (w, where) in enumerate(zip(model.filters, places, strict=True)):
                g = back[:, i * FILTERS : (i + 1) * FILTERS]
                g_w = np.empty_like(w)
                for o in range(len(w)):
                    g_w[o] = np.einsum("dfk,df->kf", x[where + o], g)
                    rows.append((where + o).ravel())
                    grads.append((g[:, :, None] * w[o].T[None]).reshape(-1, DIMS))
                seen[1][i] += g_w**2
                w -= rate * g_w / np.sqrt(seen[1][i])
                g_b = g.sum(axis=0)
                seen[2][i] += g_b**2
                model.bias[i] -= rate * g_b / np.sqrt(seen[2][i])
            seen[3] += g_out**2
            model.out -= rate * g_out / np.sqrt(seen[3])
            seen[4] += g_base**2
            model.base -= rate * g_base / np.sqrt(seen[4])
            rows, grads = np.concatenate(rows), np.concatenate(grads)
            for table, of in ((0, first), (1, second)):
                touched, inverse = np.unique(of[rows], return_inverse=True)
                total = np.zeros((len(touched), DIMS), np.float32)
                np.add.at(total, inverse, grads)
                total[touched == BUCKETS] = 0
                seen[0][table][touched] += total**2
                tables[table][touched] -= rate * total / np.sqrt(seen[0][table][touched])
    return model


def best_threshold(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The logit between two rows that gives label 1 its best F1; of a stretch of equals, its middle."""
    order = np.argsort(-z, kind="stable")
    hit, miss = np.cumsum((y * weight)[order]), np.cumsum(((1 - y) * weight)[order])
    f1 = 2 * hit / np.maximum(hit + miss + (y * weight).sum(), 1e-12)
    best = np.flatnonzero(f1 >= f1.max() - 1e-9)
    z = np.append(z[order], z.min() - 2)
    return float((z[best[0]] + z[best[-1] + 1]) / 2)


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, learn, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> ToxicityModel:
    """Fit on SAMPLE_ROWS labelled rows at most where ``learn(id column)`` holds, half of either label.

    Languages, for the thresholds alone, are learned from such rows too and then told from the text. Thresholds are set
    on every labelled row where ``learn`` holds, but for those trained on. Without rows of both labels every score is
    that of the label there is, or 0.5.
    """
    prepare(docs.sparkSession)
    y, words, ids, _ = labelled_sample(docs, labels, label_col, learn, SAMPLE_ROWS, split_features, id_col, text_col)
    if len(set(y.tolist())) < 2:
        model = train([], y)
        model.out[:] = 0
        model.base = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return model
    check = np.arange(len(y)) % 4 == 3
    model = train([w for w, c in zip(words, check, strict=True) if not c], y[~check])
    model.languages = fit_languages(docs, learn(id_col), id_col, text_col, lang_col, bounds=False)
    trained = frozenset(i for i, c in zip(ids, check, strict=True) if not c)
    counts = count_logits(docs, known_labels(labels, label_col, learn, id_col), model, trained, learn, id_col, text_col)
    model.shift = thresholds(counts)
    return model


def count_logits(
    docs: DataFrame, known: DataFrame, model: ToxicityModel, trained: frozenset[str], learn, id_col: str = "doc_id", text_col: str = "text"
) -> np.ndarray:
    """Rows of (language, label, trained on, step of the logit, ids) over all of ``known`` (id, y) that have a text.

    Texts are scored where they lie; only id, language and step are shuffled. An id that repeats counts once.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, trained))
    kind = docs.schema[id_col].dataType.simpleString()

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, trained = shared.value
        texts = [(t or "").encode("utf-8", "replace") for t in batch.column("text").to_pylist()]
        step = np.rint((np.clip(model.raw(texts), -REACH, REACH) + REACH) * STEPS).astype(np.int64)
        own = np.array([i in trained for i in batch.column("id").cast(pa.string()).to_pylist()], dtype=np.int64)
        lang = model.languages.nearest(texts)[0].astype(np.int64) + 1
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(step << 32 | lang << 1 | own)], names=["id", "code"])

    rows = docs.where(learn(id_col)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # Most texts have no label: a bitmap of the labelled ids, of fixed size, leaves them unscored.
    as_text = F.col("id").cast("string")
    rows = mark_keys(known.select(as_text.alias("id")), "id").rows(rows, True, as_text)
    once = map_arrow(rows, kernel, f"id {kind}, code long").groupBy("id").agg(F.min("code").alias("code"))
    # Both sides grow with the table, so neither is one to broadcast.
    met = once.join(known.hint("merge"), "id").groupBy("code", "y").agg(F.count("*").alias("n")).collect()
    out = [((r["code"] >> 1 & 0x7FFFFFFF) - 1, r["y"], r["code"] & 1, (r["code"] >> 32) - REACH * STEPS, r["n"]) for r in met]
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 5)


def thresholds(counts: np.ndarray) -> dict[int, float]:
    """The best threshold of each language, and of all (-1), by the counts of rows not trained on.

    Each label's rows weigh as much as all its rows, those trained on included: the sample has as many of either label.
    """
    out = {-1: 0.0}
    for one in [-1, *sorted(set(counts[:, 0].tolist()) - {-1})]:
        of = counts if one == -1 else counts[counts[:, 0] == one]
        free = of[of[:, 2] == 0]
        rows = [int(free[free[:, 1] == y, 4].sum()) for y in (0, 1)]
        if min(rows) >= (1 if one == -1 else LEAST_ROWS):
            weight = free[:, 4] * np.array([of[of[:, 1] == y, 4].sum() / rows[y] for y in (0, 1)])[free[:, 1]]
            # Rows of one step stand or fall together.
            steps, at = np.unique(free[:, 3], return_inverse=True)
            whole = np.bincount(at, weight)
            out[one] = best_threshold(steps / STEPS, np.bincount(at, weight * free[:, 1]) / whole, whole)
    return out


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1; 0.5 is the threshold of the text's language) of every whole text.

    Null and empty texts are scored as padding. Each row gives one row, repeated rows and null ids included; equal texts
    have equal scores; an empty table gives no rows. Other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return score_rows(docs, lambda texts: shared.value.scores([t.encode("utf-8", "replace") for t in texts]), id_col, text_col)


def keep_clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs`` without rows scored 0.5 or more, all columns as they were.

    Null and empty texts are scored as padding. Each repeated row is judged for itself, null ids too; an empty table
    gives no rows. Only the text goes through Python.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores([t.as_py() or b"" for t in texts.cast(pa.binary())]) < 0.5)

    return docs.where(clean(F.col(text_col)))


def learn_rows(id_col: str):
    """Rows the contract lets the model learn from: crc32 of the id modulo 5 is not 0."""
    return F.coalesce(bucket_of(id_col, 5) != 0, F.lit(False))


def op9(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns: a row for each row of ``docs``, whatever its id and text; none for an empty table."""
    scored = score_toxicity(docs, fit_toxicity(docs, labels, learn_rows))
    return scored.select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )

"""Quality classifier: random-indexing word vectors, pooled by document, and a two-layer network.

A word's index vector is sparse and ternary, drawn from its hash. Its context vector sums the index vectors of the
words around it over all documents; the two together are its vector. A document is the mean of its words' vectors, with
the mean's length, the document's size, and how often a word is that one or two places before. The network has one hidden layer; a temperature fitted on rows it was not
trained on calibrates its probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweeplane.llm.common import blocks, bucket_of, classes, hash_tokens, held_out, prepare
from sweeplane.llm.labelled import labelled_sample, score_rows

#: Buckets of hashed words, components of a vector, nonzero ones of an index vector, words to either side of a context.
BUCKETS = 1 << 16
DIMS = 64
NONZERO = 4
POOLED = DIMS + 4
WINDOW = 2
#: Rows the model is fitted on at most; of each four, one calibrates the temperature.
SAMPLE_ROWS = 3000
HIDDEN = 32
_TOKENS = classes("runs")


def word_buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each token's bucket, and where each text ends. Tokens are runs of letters and digits, or of other marks."""
    hashes, ends = hash_tokens(texts, _TOKENS)
    return (hashes >> np.uint64(48)).astype(np.int32), ends


def split_features(texts: list[bytes]) -> list[np.ndarray]:
    """The buckets of each text on its own."""
    out: list[np.ndarray] = []
    for lo, hi in blocks([len(t) for t in texts]):
        words, ends = word_buckets(texts[lo:hi])
        out += np.split(words, ends[:-1])
    return out


def index_slots() -> tuple[np.ndarray, np.ndarray]:
    """Each bucket's NONZERO components, and their signs."""
    rng = np.random.default_rng(5)
    drawn = [(rng.integers(0, DIMS, BUCKETS), rng.choice(np.float32([-1, 1]), BUCKETS)) for _ in range(NONZERO)]
    return np.stack([d for d, _ in drawn]), np.stack([s for _, s in drawn])


def index_vectors() -> np.ndarray:
    """Each bucket's sparse ternary vector."""
    out = np.zeros((BUCKETS, DIMS), dtype=np.float32)
    for where, sign in zip(*index_slots(), strict=True):
        out[np.arange(BUCKETS), where] += sign
    return out


def add_contexts(total: np.ndarray, words: np.ndarray, ends: np.ndarray, slots: tuple[np.ndarray, np.ndarray]) -> None:
    """Add to each word's row of ``total`` the index vectors of the words up to WINDOW places away in its text.

    Pairs of a word and a neighbour are counted first; each distinct one adds to the few components of the neighbour.
    """
    text = np.repeat(np.arange(len(ends)), np.diff(np.append(0, ends)))
    at = np.arange(len(words)) + WINDOW * (text + 1)
    laid = np.full(len(words) + WINDOW * (len(ends) + 1), BUCKETS, dtype=np.int64)  # the places between texts have no word
    laid[at] = words
    pairs = []
    for o in range(-WINDOW, WINDOW + 1):
        near = laid[at + o]
        inside = near < BUCKETS
        if o:
            pairs.append(words[inside].astype(np.int64) * BUCKETS + near[inside])
    pairs, times = np.unique(np.concatenate(pairs), return_counts=True)
    own, near = pairs // BUCKETS * DIMS, pairs % BUCKETS
    for where, sign in zip(*slots, strict=True):
        np.add.at(total.reshape(-1), own + where[near], times * sign[near].astype(np.int64))


#: Partitions of the table that a task of the context sums reads, so that its table of sums is small against its texts.
CONTEXT_PARTITIONS = 8


def context_sums(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Each bucket's context sums over all texts: partial sums from each task, then a sum by bucket.

    A task holds one table of BUCKETS rows, whatever it reads, and so does the driver.
    """
    columns = [f"d{n}" for n in range(DIMS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = index_slots()
        total = np.zeros((BUCKETS, DIMS), dtype=np.int64)
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(0).cast(pa.binary())]
            for lo, hi in blocks([len(t) for t in texts]):
                add_contexts(total, *word_buckets(texts[lo:hi]), slots)
        rows = np.flatnonzero(total.any(axis=1))
        for at in range(0, len(rows), 4096):
            part = rows[at : at + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(c) for c in total[part].T.copy())], names=["bucket", *columns])

    texts = docs.select(text_col)
    parts, slots = texts.rdd.getNumPartitions(), 4 * docs.sparkSession.sparkContext.defaultParallelism
    texts = texts.coalesce(max(1, min(parts, slots), -(-parts // CONTEXT_PARTITIONS)))
    sums = texts.mapInArrow(run, "bucket long, " + ", ".join(f"{c} long" for c in columns))
    found = sums.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()
    out = np.zeros((BUCKETS, DIMS), dtype=np.int64)
    out[found.column("bucket").to_numpy()] = np.stack([found.column(c).to_numpy() for c in columns], axis=1)
    return out


def word_vectors(context: np.ndarray) -> np.ndarray:
    """Index vectors plus context vectors, the latter at length one."""
    return index_vectors() + (context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-6)).astype(np.float32)


def pool(words: np.ndarray, ends: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Each text's mean vector, its length, the words' logarithm, the shares of repeats; zeros without words."""
    out = np.zeros((len(ends), POOLED), dtype=np.float32)
    begins = np.append(0, ends[:-1])
    sums = np.zeros((len(ends), DIMS), dtype=np.float64)
    step = 1 << 15
    for at in range(0, len(words), step):
        part = vectors[words[at : at + step]]
        first, last = np.searchsorted(ends, [at, min(at + step, len(words)) - 1], side="right")
        rows = np.arange(first, last + 1)
        rows = rows[ends[rows] > begins[rows]]
        sums[rows] += np.add.reduceat(part, np.maximum(begins[rows] - at, 0))
    n = ends - begins
    out[:, :DIMS] = sums / np.maximum(n, 1)[:, None]
    out[:, DIMS] = np.linalg.norm(out[:, :DIMS], axis=1)
    out[:, DIMS + 1] = np.log1p(n)
    for apart in (1, 2):
        again = np.append(0, np.cumsum(np.append(np.zeros(min(apart, len(words)), bool), words[apart:] == words[:-apart])))
        first = np.minimum(begins + apart, ends)  # a repeat counts within its own text only
        out[:, DIMS + 1 + apart] = (again[ends] - again[first]) / np.maximum(n, 1)
    return out


@dataclass(frozen=True)
class QualityModel:
    vectors: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    weights: tuple[np.ndarray, ...]
    temperature: float
    offset: float

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        x = (pooled - self.center) / self.scale
        return np.tanh(x @ w1 + b1) @ w2 + b2

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        for lo, hi in blocks([len(t) for t in texts]):
            z = self.logits(pool(*word_buckets(texts[lo:hi]), self.vectors)) / self.temperature + self.offset
            out[lo:hi] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return out


def train_two_layers(x: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 0.01, decay: float = 1e-4):
    """Weights of tanh(x w1 + b1) w2 + b2, by Adam on the logistic loss."""
    rng = np.random.default_rng(1)
    w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), np.zeros(())]
    first, second, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 64):
            b, target = x[order[at : at + 64]], y[order[at : at + 64]]
            hidden = np.tanh(b @ w[0] + w[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ w[2] + w[3], -40, 40))) - target) / len(b)
            back = np.outer(error, w[2]) * (1 - hidden**2)
            grads = [b.T @ back, back.sum(axis=0), hidden.T @ error, error.sum()]
            step += 1
            for i, g in enumerate(grads):
                g = g + decay * w[i]
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                w[i] = w[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return tuple(w)


def fit_temperature(logits: np.ndarray, y: np.ndarray, offset: float) -> float:
    """The temperature of least logistic loss on a grid; 1 without rows of both labels."""
    if len(set(y.tolist())) < 2:
        return 1.0
    grid = np.exp(np.linspace(np.log(0.2), np.log(20), 80))
    loss = [np.logaddexp(0, -(2 * y - 1) * (logits / t)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit_quality(docs: DataFrame, labels: DataFrame, learn, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Fit on SAMPLE_ROWS labelled rows at most where ``learn(id column)`` holds, half of either label.

    Context vectors come from all texts of ``docs``, labelled or not. The share of label 1 among all labelled rows sets
    the probabilities' offset. Without rows the score is 0.5.
    """
    prepare(docs.sparkSession)
    y, words, _, share = labelled_sample(docs, labels, label_col, learn, SAMPLE_ROWS, split_features, id_col=id_col, text_col=text_col)
    vectors = word_vectors(context_sums(docs, text_col))
    if len(set(y.tolist())) < 2:
        z = np.zeros((POOLED, HIDDEN))
        sure = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return QualityModel(vectors, np.zeros(POOLED), np.ones(POOLED), (z, z[0], z[0], np.float64(sure)), 1.0, 0.0)
    x = np.concatenate([pool(d, np.array([len(d)]), vectors) for d in words])
    center, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    check = np.arange(len(x)) % 4 == 3
    weights = train_two_layers((x[~check] - center) / scale, y[~check])
    model = QualityModel(vectors, center, scale, weights, 1.0, 0.0)
    temperature = fit_temperature(model.logits(x[check]), y[check], 0.0)
    held = y.mean()
    share = min(max(share, 1e-3), 1 - 1e-3)
    offset = float(np.log(share / (1 - share)) - np.log(held / (1 - held)))
    return QualityModel(vectors, center, scale, weights, temperature, offset)


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1, higher: better quality) of every whole text; null and empty texts have a score too.

    Each row gives one row, repeated rows and null ids included; equal texts have equal scores; an empty table gives no
    rows. Other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return score_rows(docs, lambda texts: shared.value.scores([t.encode("utf-8", "replace") for t in texts]), id_col, text_col)


def learn_rows(id_col: str):
    """Rows the contract lets the model learn from: crc32 of the id modulo 3 is not 1."""
    return F.coalesce(bucket_of(id_col, 3) != 1, F.lit(False))


def op5(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns: a row for each row of ``docs``, whatever its id and text; none for an empty table."""
    scored = score_quality(docs, fit_quality(docs, labels, learn_rows))
    return scored.select(
        "doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )

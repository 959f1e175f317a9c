"""Held-out accuracy of the classifiers on labelled rows, and their odd cases."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sweeplane.llm import common, langid, quality, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_language_of_held_out_rows(table, odd_docs, empty_docs):
    rows = langid.op3(table).join(table.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == table.count() and len(held) > 150
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert sum(r.rejected for r in rows) <= 2
    model = langid.fit_languages(table, langid.learn_rows())
    found = {r.doc_id: r for r in langid.detect_language(odd_docs, model).collect()}
    assert found[1].lang_pred == found[2].lang_pred == found[6].lang_pred == "und" and found[1].score == 0
    assert langid.op3(empty_docs).count() == 0
    assert langid.op3(odd_docs).count() == odd_docs.count()
    far = odd_docs.sparkSession.createDataFrame([(1, "ﷺ漢字仮名交じり文" * 50), (2, "the and of that with")], "doc_id long, text string")
    assert [r.rejected for r in langid.detect_language(far, model).orderBy("doc_id").collect()] == [True, False]
    assert langid.keep_identified(far, model).count() == 1


def test_language_model_does_not_depend_on_partitions(table):
    a, b = (langid.fit_languages(t, langid.learn_rows()) for t in (table, table.repartition(7)))
    assert a.languages == b.languages and np.allclose(a.centroids, b.centroids)


def test_every_language_of_a_table_is_learned(spark):
    rng = np.random.default_rng(8)
    spoken = {f"l{n:02}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(12)] for n in range(60)}
    rows = []
    for n, (lang, words) in enumerate(spoken.items()):
        rows += [(len(rows) + i, " ".join(rng.choice(words, 40)), lang) for i in range(6 if n < 12 else 12)]
    # One more language has a single id, and so many rows that a sample by their number could miss it.
    rows += [(10_000, "zq zzq qzzq " * 30, "one")] * 2000
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    model = langid.fit_languages(table, F.lit(True))
    assert model.languages == sorted({*spoken, "one"})
    got = langid.detect_language(table, model).distinct().collect()
    want = {i: lang for i, _, lang in rows}
    assert all(r.lang_pred == want[r.doc_id] and not r.rejected for r in got) and len(got) == len(want)


def test_features_of_blocks_equal_those_of_single_texts():
    texts = ["Ab c!! Ab c!!".encode(), b"", "x é é ü-1".encode() * 40, b"   "]
    for table_ in (common.classes("runs"), common.classes("words")):
        whole, ends = common.hash_tokens(texts, table_)
        alone = [common.hash_tokens([t], table_)[0] for t in texts]
        assert [len(p) for p in alone] == np.diff(np.append(0, ends)).tolist()
        assert np.array_equal(whole, np.concatenate(alone))
    _, prefix, _ = common.hash_tokens([b"lower lowest low"], common.classes("words"), 3)
    assert len(set(prefix.tolist())) == 1
    one = np.stack([langid.ngram_counts([t])[0] for t in texts])
    assert np.array_equal(one, langid.ngram_counts(texts))


def test_pooling_matches_a_plain_loop():
    vectors = quality.index_vectors()
    texts = [b"a a b", b"", b"word " * 70_000, b"one two one two"]
    words, ends = quality.word_buckets(texts)
    got = quality.pool(words, ends, vectors)
    for row, part in zip(got, np.split(words, ends[:-1]), strict=True):
        mean = vectors[part].astype(float).mean(axis=0) if len(part) else np.zeros(quality.DIMS)
        again = [float((part[n:] == part[:-n]).sum()) / len(part) if len(part) else 0.0 for n in (1, 2)]
        assert np.allclose(row, [*mean, np.linalg.norm(mean), math.log1p(len(part)), *again], atol=1e-5)


def test_context_sums_match_a_plain_loop(spark):
    texts = ["a b c a b", "c c, d", None, "", "x", "one two three two one " * 30]
    table = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    index, want = quality.index_vectors(), np.zeros((quality.BUCKETS, quality.DIMS))
    for t in texts:
        words, _ = quality.word_buckets([(t or "").encode()])
        for i, w in enumerate(words):
            for j in range(max(0, i - quality.WINDOW), min(len(words), i + quality.WINDOW + 1)):
                want[w] += index[words[j]] if i != j else 0
    assert np.array_equal(quality.context_sums(table), want)
    assert not quality.context_sums(table.where("false")).any()


def test_quality_scores_match_a_plain_network(table, labels):
    model = quality.fit_quality(table, labels, quality.learn_rows)
    texts = [t.text for t in table.limit(25).select("text").collect()] + ["", "one", "!! ??"]
    w1, b1, w2, b2 = model.weights
    for text, got in zip(texts, model.scores([(t or "").encode() for t in texts]), strict=True):
        words, _ = quality.word_buckets([(text or "").encode()])
        mean = [sum(float(model.vectors[w][d]) for w in words) / max(1, len(words)) for d in range(quality.DIMS)]
        again = [sum(a == b for a, b in zip(words[n:], words[:-n], strict=True)) / max(1, len(words)) for n in (1, 2)]
        pooled = [*mean, math.sqrt(sum(m * m for m in mean)), math.log1p(len(words)), *again]
        x = [(p - c) / s for p, c, s in zip(pooled, model.center, model.scale, strict=True)]
        hidden = [math.tanh(sum(x[i] * w1[i][h] for i in range(len(x))) + b1[h]) for h in range(quality.HIDDEN)]
        z = (sum(v * w for v, w in zip(hidden, w2, strict=True)) + float(b2)) / model.temperature + model.offset
        assert abs(got - 1 / (1 + math.exp(-max(-40, min(40, z))))) < 1e-3


def test_language_scores_match_plain_vectors(table):
    model = langid.fit_languages(table, langid.learn_rows())
    mix, mask, shift = [int(m) for m in langid._MIX], (1 << 32) - 1, 32 - langid.DIMS.bit_length() + 1

    def plain(text):
        data, counts = [0, *(b if b >= 128 or 97 <= b <= 122 else 0 for b in text.encode().lower()), 0], Counter()
        for a, b, c in zip(data, data[1:], data[2:], strict=False):
            if b:
                counts[((a * mix[0] & mask) ^ (b * mix[1] & mask) ^ (c * mix[2] & mask)) * mix[3] % (1 << 32) >> shift] += 1
                counts[((b * mix[2] & mask) ^ (c * mix[0] & mask)) * mix[1] % (1 << 32) >> shift] += 1
        x = {k: math.log1p(n) * float(model.idf[k]) for k, n in counts.items()}
        size = math.sqrt(sum(v * v for v in x.values())) or 1.0
        return [sum(v * float(c[k]) for k, v in x.items()) / size for c in model.centroids]

    rows = [(r.doc_id, r.text or "") for r in table.limit(25).select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in langid.detect_language(table.limit(25), model).collect()}
    for i, text in rows:
        cosines = plain(text)
        assert abs(max(cosines) - got[i].score) < 1e-4
        assert model.languages[model.owner[int(np.argmax(cosines))]] == got[i].lang_pred


def test_rejection_bounds_come_from_all_rows(table):
    learn = langid.learn_rows()
    model = langid.fit_languages(table, learn)
    rows = table.where(learn).where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").collect()
    for n, lang in enumerate(model.languages):
        own = [r.text.encode() for r in rows if r.lang == lang]
        steps = np.floor(model.cosines(own, [n] * len(own)) * langid.STEPS)
        assert math.isclose(model.least[n], langid.REJECT_SHARE * np.quantile(steps, langid.REJECT_TAIL) / langid.STEPS, rel_tol=1e-9)
        counts = langid.ngram_counts(own[:1])[0]
        assert counts.sum() and (model.idf[counts > 0] <= model.idf.max()).all()


def test_toxicity_scores_match_a_plain_convolution(table, labels):
    model = toxicity.fit_toxicity(table, labels, toxicity.learn_rows)
    texts = [t.text or "" for t in table.limit(15).select("text").collect()] + ["", "one", "two words"]
    spoken = model.languages.nearest([t.encode() for t in texts])[0]
    for text, lang, got in zip(texts, spoken, model.scores([t.encode() for t in texts]), strict=True):
        words, _ = toxicity.word_rows([text.encode()])
        raw = words.view(np.uint32).astype(np.int64)
        x = [model.tables[0][r >> 16] + model.tables[1][r & 0xFFFF] for r in raw] + [np.zeros(toxicity.DIMS)] * toxicity._PAD
        pooled = []
        for w, b in zip(model.filters, model.bias, strict=True):
            places = [sum(x[p + o] @ w[o] for o in range(len(w))) + b for p in range(len(x) - len(w) + 1)]
            pooled += np.maximum(np.max(places, axis=0), 0).tolist()
        z = float(np.dot(pooled, model.out)) + model.base - model.shift.get(int(lang), model.shift[-1])
        assert abs(got - 1 / (1 + math.exp(-max(-40, min(40, z))))) < 1e-3


def test_filters_of_rows_without_ids_and_of_no_rows(table, labels, odd_docs, empty_docs):
    told = langid.fit_languages(table, langid.learn_rows())
    clean = toxicity.fit_toxicity(table, labels, toxicity.learn_rows)
    for keep, model, verdict in (
        (langid.keep_identified, told, lambda d: langid.detect_language(d, told).where("NOT rejected")),
        (toxicity.keep_clean, clean, lambda d: toxicity.score_toxicity(d, clean).where("score < 0.5")),
    ):
        kept = keep(odd_docs, model)
        assert kept.columns == odd_docs.columns and keep(empty_docs, model).count() == 0
        assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in verdict(odd_docs).collect())


def _held(rows, label):
    return [(r["score"], r["predicted"], r[label]) for r in rows if r["held_out"]]


@pytest.mark.parametrize("module,label,least", [(quality, "quality", 0.93), (toxicity, "toxic", 0.9)])
def test_held_out_labels(table, labels, odd_docs, empty_docs, module, label, least):
    op = module.op5 if module is quality else module.op9
    got = op(table, labels)
    rows = [r.asDict() for r in got.join(labels, "doc_id").collect()]
    held = _held(rows, label)
    assert got.count() == table.count() and len(held) > 50
    assert np.mean([p == y for _, p, y in held]) > least
    assert all(0 <= s <= 1 and p == (s >= 0.5) for s, p, _ in held)
    assert op(empty_docs, labels).count() == 0
    # Labels without a row of either kind, or that contradict each other, give every text a score all the same.
    for few in (labels.where("false"), labels.limit(1), labels.unionByName(labels.withColumn(label, 1 - F.col(label)))):
        odd = op(odd_docs, few).collect()
        assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 for r in odd)


def test_toxicity_training_follows_its_gradient():
    rng = np.random.default_rng(0)
    bad = [11 << 16 | 5, 23 << 16 | 9]
    words, y = [], []
    for i in range(200):
        w = rng.integers(100, 30_000, 30).astype(np.int64) * 65536 + rng.integers(100, 60_000, 30)
        if i % 2:
            w[rng.integers(0, 30)] = bad[i // 2 % 2]
        words.append(w.astype(np.uint32).view(np.int32))
        y.append(i % 2)
    model = toxicity.train(words, np.array(y), epochs=15)
    z = [float((model.pooled(w, np.array([len(w)])) @ model.out + model.base)[0]) for w in words]
    assert np.mean((np.array(z) > 0) == np.array(y)) > 0.95


def test_toxicity_of_a_block_equals_that_of_each_text():
    rng = np.random.default_rng(6)
    words = [rng.integers(0, 2**32, n, dtype=np.uint32).view(np.int32) for n in (5, 0, 1, 2, 40, 0, 0, 3)]
    model = toxicity.train([], np.zeros(0))
    # Every filter finds words, and nothing in padding: a window that reads into the next text would win.
    model.tables[:, : toxicity.BUCKETS] = rng.uniform(0, 1, (2, toxicity.BUCKETS, toxicity.DIMS))
    model.filters = [np.abs(f) for f in model.filters]
    block = model.pooled(np.concatenate(words), np.cumsum([len(w) for w in words]))
    alone = np.concatenate([model.pooled(w, np.array([len(w)])) for w in words])
    assert np.allclose(block, alone, atol=1e-5) and not block[1].any() and block[2].any()


def test_thresholds_cover_all_labelled_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 48)
    rng = np.random.default_rng(9)
    spoken = {"aa": ["abba", "bacca", "cabba", "dabba"], "zz": ["zyxi", "yxzi", "xyzzy", "zizzy"]}
    rows, marks = [], []
    for i in range(900):
        lang, bad = ("zz" if i % 12 < 2 else "aa"), i % 2
        rows.append((i, " ".join([*rng.choice(spoken[lang], 20), *(["grrr"] if bad else [])]), lang))
        marks.append((i, bad))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    every = lambda _: F.lit(True)
    model = toxicity.fit_toxicity(docs, labels, every)
    assert model.shift.keys() == {-1, 0, 1}
    counts = toxicity.count_logits(docs, labels.withColumnsRenamed({"doc_id": "id", "toxic": "y"}), model, frozenset(["0", "1"]), every)
    assert counts[:, 4].sum() == 900 and counts[counts[:, 2] == 1, 4].sum() == 2
    assert counts[counts[:, 0] == 1, 4].sum() == 150 and counts[counts[:, 1] == 1, 4].sum() == 450
    # A language's threshold is that of its own rows: here label 1 begins at 3 in one, at -3 in the other.
    own = [(g, int(z >= edge), 0, z * toxicity.STEPS, 20) for g, edge in ((0, 3), (1, -3)) for z in range(-6, 7)]
    cut = toxicity.thresholds(np.array(own))
    assert 2 < cut[0] < 3 and -4 < cut[1] < -3


def test_calibration_helpers():
    rng = np.random.default_rng(1)
    p = rng.uniform(0.02, 0.98, 4000)
    y = (rng.uniform(size=4000) < p).astype(int)
    t = quality.fit_temperature(3 * np.log(p / (1 - p)), y, 0.0)
    assert 2.4 < t < 3.6
    z, y = np.array([-3.0, -2, -1, 1, 2]), np.array([0, 0, 0, 1, 1])
    assert -1 < toxicity.best_threshold(z, y, np.ones(5)) < 1
    assert Counter(y.tolist())[1] == 2


def test_too_many_languages_raise(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 3)
    rows = [(i, "some words of a text", f"l{i % 4}") for i in range(40)]
    with pytest.raises(ValueError, match="MOST_LANGUAGES"):
        langid.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), langid.learn_rows())

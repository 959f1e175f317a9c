"""Top-k search, prefix trie and source divergence against plain Python on small odd tables."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sweeplane.llm import divergence, topk, trie
from tests.llm.brute import sha

VECTORS = "vec_id long, embedding array<double>, label int, uid string, need string"


def brute_top(rows, k, every):
    kept = []
    for place, (vec_id, v) in enumerate(rows):
        if vec_id is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((place, vec_id, [math.floor(256 * x) for x in v]))
    out = []
    for place, q, a in kept:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), c) for p, c, b in kept if p != place and len(a) == len(b))
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scored[:k])]
    return sorted(out)


def top(spark, rows, k=5, every=50):
    df = spark.createDataFrame([(i, v, None, "mine", "mine") for i, v in rows], VECTORS).repartition(3)
    got = topk.top_k(df, F.col("vec_id") % every == 0, k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, got.collect()))


def test_top_k_odd_rows(spark):
    rows = [
        (0, [0.5, -0.25]), (50, [1.0, 2.0]), (100, None), (150, [float("nan"), 1.0]), (200, [None, 1.0]), (1, [0.5, -0.25]), (2, [0.5, -0.25]),
        (3, [float("inf"), 0.0]), (None, [1.0, 1.0]), (7, [1.0, 1.0, 1.0]), (250, []), (8, []), (300, [0.1, 0.2, 0.3]), (9, [-3.7, 1e-9]), (50, [1.0, 2.0]), (350, [1.0]),
    ]
    assert top(spark, rows) == brute_top(rows, 5, 50)
    assert top(spark, rows, k=2) == brute_top(rows, 2, 50)
    assert top(spark, []) == []


def test_top_k_ties_and_blocks(spark, monkeypatch):
    import random

    draw = random.Random(3)
    # A third of the rows is one vector; many scores tie at the threshold; blocks of a few rows.
    rows = [(n, [0.5, 0.5] if n % 3 == 0 else [draw.randrange(-4, 5) / 8, draw.randrange(-4, 5) / 8]) for n in range(240)]
    monkeypatch.setattr(topk, "VECTOR_BYTES", 16 * 37)
    assert top(spark, rows, every=20) == brute_top(rows, 5, 20)


def test_top_k_wide_scores(spark):
    rows = [(n, [(n * 7919 % 101) * 1e4 + n, -1e6 * (n % 5)]) for n in range(60)]
    assert top(spark, rows, every=20) == brute_top(rows, 5, 20)
    with pytest.raises(Exception, match="fit a long"):
        top(spark, [(0, [1e15]), (1, [1e15])])


# -- trie ---------------------------------------------------------------------------------------------------------


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    nodes = defaultdict(list)
    length = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))
        path = own.get(base, [])[:h] + own[c][h:]
        length[c] = len(path)
        for d in range(len(path) + 1):
            nodes[tuple(path[:d])].append(c)
    children = Counter(k[:-1] for k in nodes if k)
    leaves, saved = Counter(), Counter()
    for k, members in nodes.items():
        own_saved = (len(members) - 1) * len(k[-1][1].decode()) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += own_saved
    out = []
    for k, m in nodes.items():
        ends = ",".join(map(str, sorted(c for c in m if length[c] == len(k))))
        out.append((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], sha(ends)))
    return sorted(out, key=str)


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def grown(spark, rows):
    df = spark.createDataFrame([(*r, "mine", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, depth int").repartition(3)
    got = trie.prefix_trie(df)
    assert got.columns == TRIE
    return sorted(map(tuple, got.collect()), key=str)


def test_trie_odd_rows(spark):
    rows = [
        (0, 1, "user", "hi"), (0, None, None, None), (0, 2, "user", "hi"), (1, 1, "user", "hi"), (1, 1, "user", "hi"), (1, 1, "bot", "ünï😀"), (2, None, "user", "b"),
        (2, None, "user", "a"), (None, 1, "user", "lost"), (-3, 5, "user", "below zero"), (-300, 1, "user", "base"), (7, 1, "us", "er\nx"), (8, 1, "us\ner", "x"),
        (9, 1, "user", ""), (205, 1, "user", "no base"), (101, 3, None, "x" * 100_000), (101, -3, "user", None),
    ]
    assert grown(spark, rows) == brute_trie(rows)
    assert grown(spark, []) == []


def test_trie_deep_and_hot(spark, monkeypatch):
    # One conversation holds a third of the rows; copies of another end in one node; short ones end within shared turns.
    rows = [(0, n, "user", f"turn {n}") for n in range(150)]
    rows += [(c, n, "user", f"same {n % 2}") for c in range(101, 125) for n in range(9)]
    rows += [(c, n, "user", f"turn {n}") for c in range(1, 40, 3) for n in range(c % 13)]
    monkeypatch.setattr(trie, "ENDS", 5)
    assert grown(spark, rows) == brute_trie(rows)


def test_trie_narrow_bands(spark, monkeypatch):
    rows = [(c, n, "user", f"t{n}" if n < c % 7 else f"t{n} {c % 3}") for c in range(40) for n in range(c)]
    monkeypatch.setattr(trie, "BAND", 2)
    assert grown(spark, rows) == brute_trie(rows)


# -- divergence ---------------------------------------------------------------------------------------------------


def brute_divergence(rows, least_docs, ranks):
    n, docs, lang_n = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    groups = set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower)
        n[lang, source].update(terms)
        lang_n[lang].update(terms)
        docs[lang].update(set(terms))
    kept = {lang: {t for t, c in d.items() if c >= least_docs} for lang, d in docs.items()}
    share = lambda counts, terms: {t: 1 + 1_000_000_000 * (counts[t] + 5) // (sum(counts[u] for u in terms) + 5 * len(terms)) for t in terms}
    p = {g: share(n[g], kept.get(g[0], set())) for g in groups}
    q = {lang: share(lang_n[lang], terms) for lang, terms in kept.items()}
    out = []
    for lang, source in groups:
        mine = p[lang, source]
        pairs = [(-sum(abs(mine[t] - p[lang, o][t]) for t in mine), o.encode(), o) for x, o in groups if x == lang and o != source]
        terms = [(q[lang][t] - mine[t], t.encode(), t) for t in mine if n[lang, source][t] and mine[t] > q[lang][t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:ranks])):
            out += [(lang, source, part, item, -value, at + 1) for at, (value, _, item) in enumerate(found)]
    return sorted(out)


def diverge(spark, rows, **options):
    df = spark.createDataFrame([(n, *r, "mine", "mine") for n, r in enumerate(rows)], "doc_id long, lang string, source string, text string, gid string, term string").repartition(3)
    got = divergence.source_divergence(df, **options)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, got.collect()))


ODD_TEXTS = [
    ("en", "s0", "The cat THE Cat, the\x00dog"), ("en", "s1", "the dog ünïcode ÜNÏ 日本語 😀"), ("en", "s1", None), ("en", None, "cat dog the the"), (None, None, "cat"),
    (None, "s0", ""), ("en", "s0", "dog " * 3000 + "cat"), ("en", "s2", "1234 -- 5"), ("de", "s0", "der Hund"), ("de", "s0", "der Hund"), ("fr", "s9", "seul"), ("en", "s1", "cat_dog`the{cat}"),
    ("de", "s1", "Hund\x7fder\x85x der"),
]


@pytest.mark.parametrize("bits", [64, 2])
def test_divergence_odd_rows(spark, bits):
    for least, ranks in ((2, 50), (1, 2), (99, 50)):
        assert diverge(spark, ODD_TEXTS, least_docs=least, term_ranks=ranks, digest_bits=bits) == brute_divergence(ODD_TEXTS, least, ranks)
    assert diverge(spark, []) == []


def test_divergence_chunks_and_ties(spark, monkeypatch):
    # One source holds a third of the documents; many terms tie; terms and sources meet in small blocks, tasks flush often.
    rows = [("en", f"s{n % 9 if n % 3 else 0}", " ".join(f"w{chr(97 + (n * k) % 23)}" for k in range(1, 14))) for n in range(120)]
    rows += [("es", f"s{n % 5}", f"uno dos w{chr(97 + n % 7)}") for n in range(30)]
    monkeypatch.setattr(divergence, "TERMS", 4)
    monkeypatch.setattr(divergence, "SOURCES", 2)
    monkeypatch.setattr(divergence, "TASK_TERMS", 10)
    assert diverge(spark, rows, least_docs=3, term_ranks=3) == brute_divergence(rows, 3, 3)
    assert diverge(spark, rows, least_docs=3, term_ranks=3, digest_bits=3) == brute_divergence(rows, 3, 3)

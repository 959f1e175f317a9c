import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm import brute

from sweeplane.llm import common, embed_dedup, graph, warc

SF = "/root/testdata/sf0.001"


def _revisits(rows):
    first = {}
    for page, html in rows:
        d = warc.digest_of((html or "").encode())
        if page is not None:
            first[d] = min(first.get(d, page), page)
    out = Counter()
    for page, html in rows:
        data = (html or "").encode()
        d = warc.digest_of(data)
        is_first = first.get(d) == page
        out[page, len(data), d, "response" if is_first else "revisit", None if is_first else first.get(d)] += 1
    return out


@pytest.mark.parametrize("broadcast", [1 << 17, 0])
def test_warc_round_trip(spark, monkeypatch, broadcast):
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    odd = spark.createDataFrame(
        [(5, "same"), (3, "same"), (4, None), (9, ""), (7, "é" * 500_000), (7, "é" * 500_000), (None, "same"), (1, "WARC/1.1\r\n\r\n")],
        "page_id long, html string",
    ).withColumns({"digest": F.lit("x"), "first": F.lit(0), "payload": F.lit(1)})
    for table in (pages, odd):
        want = _revisits([(r.page_id, r.html) for r in table.select("page_id", "html").collect()])
        assert Counter(map(tuple, warc.op6(table).collect())) == want
    assert warc.op6(pages.where("false")).count() == 0


def _members(n):
    return [warc.compress_record(warc.format_record({"WARC-Type": "response", "N": str(i)}, b"body %d" % i * 50)) for i in range(n)]


def test_salvage_reads_on_after_damage():
    members = _members(6)
    damaged = bytearray(members[2])
    damaged[20] ^= 0xFF
    content = b"".join([*members[:2], bytes(damaged), members[3], b"junk\x1f\x8b\x08junk", members[4], members[5][:-9]])
    found = list(warc.read_archive(content))
    assert [f["n"] for _, _, f, _ in found if f] == ["0", "1", "3", "4"]
    gaps = [(at, n) for at, n, f, _ in found if f is None]
    assert [n for _, n in gaps] == [len(damaged), 11, len(members[5]) - 9]
    assert sum(n for _, n, _, _ in found) == len(content)


def test_salvage_of_plain_archives_and_of_none():
    records = [warc.format_record({"WARC-Type": "response", "N": str(i), "WARC-Block-Digest": "sha1:" + warc.digest_of(b"b%d" % i)}, b"b%d" % i) for i in range(4)]
    wrong = records[1].replace(b"b1\r\n\r\n", b"bX\r\n\r\n")
    content = records[0] + wrong + b"\x00\x01" + records[2] + records[3].replace(b"Content-Length: 2", b"Content-Length: x")
    found = list(warc.read_archive(content))
    assert [f["n"] for _, _, f, _ in found if f] == ["0", "2"]
    assert sum(n for _, n, _, _ in found) == len(content)
    assert list(warc.read_archive(b"")) == []
    assert list(warc.read_archive(b"nothing here")) == [(0, 12, None, b"")]


def test_payload_digests_are_checked_where_the_payload_is_the_block():
    def one(kind, **fields):
        return warc.format_record({"WARC-Type": kind, "WARC-Payload-Digest": "sha1:" + warc.digest_of(b"body")} | fields, b"bodi")

    for record, good in ((one("response"), False), (one("revisit"), True), (one("response", **{"Content-Type": "application/http;msgtype=response"}), True),
                         (warc.format_record({"WARC-Type": "response", "WARC-Payload-Digest": "sha1:" + warc.digest_of(b"body")}, b"body"), True)):
        for data in (record, warc.compress_record(record)):
            assert [f is not None for _, _, f, _ in warc.read_archive(data)] == [good]


def test_reading_time_follows_the_archive():
    def seconds(n, kind):
        record = warc.format_record({"WARC-Type": "response"}, np.random.default_rng(n).bytes(2000))
        damaged = warc.compress_record(record)[:-9] + b"\x00" * 9 if kind == "gzip" else record.replace(b"Content-Length: 2000", b"Content-Length: 9999999")
        content = (damaged + (warc.compress_record(record) if kind == "gzip" else record)) * n
        began = time.process_time()
        assert sum(f is not None for _, _, f, _ in warc.read_archive(content)) == n
        return time.process_time() - began

    for kind in ("gzip", "plain"):
        seconds(50, kind)
        assert seconds(4000, kind) < 12 * seconds(800, kind) + 0.3


def test_salvage_as_a_table(spark):
    members = _members(3)
    table = spark.createDataFrame([("a", b"xx".join(members)), ("b", None), ("c", b"")], "archive string, content binary")
    rows = warc.read_warc(table).collect()
    assert [(r.archive, r.quarantined) for r in sorted(rows, key=lambda r: r.offset)] == [("a", x) for x in (False, True, False, True, False)]


def _neighbours(rows, least=0.98):
    units = []
    for _, v, label in rows:
        x = np.array([np.nan if c is None else c for c in v], dtype=float) if v is not None else np.zeros(0)
        ok = label is not None and x.size and np.isfinite(x).all() and x.any()
        units.append(x / np.linalg.norm(x) if ok else None)
    links = [
        (a, b) for a in range(len(rows)) for b in range(a)
        if units[a] is not None and units[b] is not None and rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= least
    ]
    root = brute.components(range(len(rows)), links)
    degree = Counter(n for pair in links for n in pair)
    small = {}
    for n, r in root.items():
        if rows[n][0] is not None:
            small[r] = min(small.get(r, rows[n][0]), rows[n][0])
    return Counter((rows[n][0], degree[n], small.get(root[n]), rows[n][0] is not None and small[root[n]] == rows[n][0]) for n in range(len(rows)))


@pytest.mark.parametrize("share,pivots,block,kind", [(0.5, 32768, 2048, "float"), (2.0, 32768, 16, "double"), (2.0, 12, 2048, "float")])
def test_embeddings_match_all_pairs(spark, monkeypatch, share, pivots, block, kind):
    monkeypatch.setattr(embed_dedup, "PIVOT_SHARE", share)
    monkeypatch.setattr(embed_dedup, "PIVOTS", pivots)
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(12, 8))
    rows = []
    for i in range(240):
        v = centers[i % 12] + rng.normal(scale=(0.02, 0.1, 0.2)[i % 3], size=8)
        rows.append((i, [float(np.float32(c)) for c in v], i % 12 % 2))
    rows += [rows[0], (500, rows[3][1], rows[3][2]), (501, None, 1), (502, [0.0] * 8, 1), (503, [float("nan")] + [1.0] * 7, 1),
             (504, [None] + [1.0] * 7, 1), (505, rows[1][1], None), (None, rows[5][1], rows[5][2]), (506, rows[1][1][:4], 1), (507, [], 1)]
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    table = table.withColumns({"node": F.lit(1), "cell": F.lit(1), "key": F.lit("k")}).repartition(3)
    assert Counter(map(tuple, embed_dedup.near_vectors(table).collect())) == _neighbours(rows)
    assert embed_dedup.near_vectors(table.where("false")).count() == 0


def test_pivots_partition_tables_of_any_size_and_prune_pairs(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(9, 16))
    rows = [(i, (centers[i % 9] + rng.normal(scale=0.05, size=16)).tolist(), i % 2) for i in range(400)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    nodes = embed_dedup._keyed(table, "vec_id", "embedding", "label").selectExpr("id AS node", "label AS grp", "1L AS n", "key", "vec")
    pivots = embed_dedup.choose_pivots(nodes, np.float64)
    assert pivots.keys() == {"0", "1"} and all(2 <= len(p) <= 20 for p in pivots.values())
    compared, whole = embed_dedup.compared_pairs(embed_dedup._cells(nodes, pivots, 0.2, np.float64))
    assert whole == 2 * 200 * 199 // 2 and 0 < compared < 0.6 * whole


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (3, 2), (2, 3), (-5, 200)]
    table = spark.createDataFrame(edges, "a long, b long")
    nodes = {n for e in edges for n in e}
    assert {r.node: r.root for r in graph.connected_components(table).collect()} == brute.components(nodes, edges)
    assert graph.connected_components(table.where("false")).count() == 0
    assert zlib.crc32(b"") == 0


def test_warc_limits_are_reasons_and_none_loses_nothing(spark, monkeypatch):
    small, large = b"s" * 50, b"l" * 5000
    members = [warc.compress_record(warc.format_record({"WARC-Type": "response", "N": str(n)}, b)) for n, b in enumerate((small, large, small))]
    wide = warc.compress_record(warc.format_record({"WARC-Type": "response", "X": "y" * 3000}, small))
    table = spark.createDataFrame([("a", b"".join(members)), ("b", wide)], "archive string, content binary")
    assert warc.read_warc(table, record_bytes=None, header_bytes=None).where("quarantined").count() == 0
    rows = {r.archive: r for r in warc.read_warc(table, record_bytes=4000, header_bytes=1000).where("quarantined").collect()}
    assert (rows["a"].offset, rows["a"].length, rows["a"].reason) == (len(members[0]), len(members[1]), "a member of more than 4000 bytes")
    assert rows["b"].reason == "no end of header in 1000 bytes"
    plain = warc.format_record({"WARC-Type": "response"}, large)
    assert [f[4] for f in warc.salvage(plain + warc.format_record({"N": "1"}, small), record_bytes=4000)] == ["a record of more than 4000 bytes", None]


def test_op6_raises_on_a_gap(spark, monkeypatch):
    broken = spark.createDataFrame([("a", b"no record")], "archive string, content binary")
    monkeypatch.setattr(warc, "write_warc", lambda pages: broken)
    with pytest.raises(Exception, match="a gap in archive a: no version line"):
        warc.op6(spark.createDataFrame([(1, "x")], "page_id long, html string")).collect()


def test_cells_do_not_depend_on_slices(monkeypatch):
    x = np.random.default_rng(1).normal(size=(200, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    home, visits = embed_dedup.assign_cells(x, x[:23], 0.2)
    monkeypatch.setattr(embed_dedup, "DISTANCES", 60)
    again = embed_dedup.assign_cells(x, x[:23], 0.2)
    assert (home == again[0]).all() and (visits == again[1]).all()

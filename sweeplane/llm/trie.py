"""Prefix trie of conversations, rolled up in bands of depth.

A node is a distinct sequence of first turns. It is known by its depth and a 128-bit digest of the sequence, the exclusive
or of the digests of its (place, turn) pairs, so that running digests are two short scans: within a band of BAND turns, and
over the bands before it. Texts are needed to order turns that tie and for their digests; behind that only fixed-width
columns move.

Totals of subtrees go up in bands. A node adds what it has itself to its ancestors within its band, BAND rows at most. The
band roots so have the totals of their bands, and form a tree a BAND-th as high; doubling the distance that is summed
completes them in as many rounds as the number of bands has binary digits. A completed band root then adds its total to
its ancestors in the band above, BAND rows again. A conversation of a million turns takes 17 rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sweeplane.llm.common import materialize, prepare

#: Depths of a band: a node has at most so many rows in a roll-up.
BAND = 8
#: A rebuilt conversation starts with fewer turns than this of the first of its hundred.
SHARED = 6
#: Conversations of a node whose ids are put together before they are hashed.
ENDS = 4096

_KEY = ("depth", "hi", "lo")


def ordered_turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, rank (dense over the whole table, by conversation and turn), chars, t_hi, t_lo (the turn's digest).

    One range sort over all columns that decide the order, so a conversation of any length is many tasks' work; its result
    is written without texts, and ranks are running totals of the tasks' sizes.
    """
    rows = conversations.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).where("conv_id IS NOT NULL")
    order = ("conv_id", F.asc_nulls_first("turn"), "role", "text")
    # The role's length keeps (role, text) apart from any other two strings that join to the same.
    digest = F.md5(F.concat_ws("\n", F.length("role").cast("string"), "role", "text"))
    half = lambda at: F.conv(F.substring("digest", at, 16), 16, -10).cast("long")
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    written = materialize(
        sorted_rows.withColumn("digest", digest).select("conv_id", "place", F.length("text").cast("long").alias("chars"), half(1).alias("t_hi"), half(17).alias("t_lo")),
        "turns",
    )
    part = F.shiftright("place", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = written.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # a row a task that sorted
    ranked = written.withColumn("part", part).join(F.broadcast(starts), "part")
    rank = F.col("start") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return ranked.select("conv_id", rank.alias("rank"), "chars", "t_hi", "t_lo")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, chars, t_hi, t_lo) of all rebuilt conversations, and (conv_id, length) of each, turnless ones too."""
    own = turns.groupBy("conv_id").agg(F.min("rank").alias("first"), F.count("*").alias("n"))
    own = own.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).withColumn("base", F.col("conv_id") - F.col("conv_id") % 100)
    bases = own.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = materialize(own.join(bases, "base", "left").withColumn("taken", taken).drop("base_n"), "convs")
    # A conversation of any share of the rows is split by Spark: both sides are scans.
    placed = turns.join(convs, "conv_id").withColumn("at", F.col("rank") - F.col("first") + 1)
    tail = placed.where("at > h").select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("depth"), "chars", "t_hi", "t_lo")
    heads = placed.where(f"conv_id % 100 = 0 AND at < {SHARED}").select(F.col("conv_id").alias("base"), F.col("at").alias("depth"), "chars", "t_hi", "t_lo")
    head = convs.select("conv_id", "base", "taken").where("taken > 0").join(heads, "base").where("depth <= taken")
    lengths = convs.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    return tail.unionByName(head.select(tail.columns)), lengths


def prefixes(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """A row for each rebuilt turn: conv_id, its node's key, chars, ends, ``up`` and ``over``.

    ``up`` are the digests of the band's nodes down to this one; ``over``, on the band's first depth only, those of the
    whole band above (the root's for the first band). Both depend on the node alone.
    """
    mixed = lambda *seed: F.xxhash64(*seed, "depth", "t_hi", "t_lo")
    rows = turns.withColumns({"band": F.expr(f"(depth - 1) div {BAND}"), "hi": mixed(), "lo": mixed(F.lit("second"))})
    packed = rows.groupBy("conv_id", "band").agg(
        F.array_sort(F.collect_list(F.struct("depth", "hi", "lo", "chars"))).alias("p"), F.bit_xor("hi").alias("x_hi"), F.bit_xor("lo").alias("x_lo"),
    )
    over = Window.partitionBy("conv_id").orderBy("band")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    carry = lambda c: F.coalesce(F.bit_xor(c).over(before), F.lit(0).cast("long"))
    packed = packed.withColumns({"c_hi": carry("x_hi"), "c_lo": carry("x_lo")})

    def running(part: str) -> Column:
        xor = lambda a, x: a.bitwiseXOR(x[part])
        return lambda i: F.aggregate(F.slice("p", F.lit(1), i + 1), F.col(f"c_{part}"), xor)

    hi, lo = running("hi"), running("lo")
    nodes = F.transform("p", lambda x, i: F.struct(x["depth"].alias("depth"), hi(i).alias("hi"), lo(i).alias("lo"), x["chars"].alias("chars")))
    packed = packed.withColumn("p", nodes).withColumn("keys", F.transform("p", lambda x: F.struct(x["depth"].alias("depth"), x["hi"].alias("hi"), x["lo"].alias("lo"))))
    packed = packed.withColumn("over", F.coalesce(F.lag("keys").over(over), F.array(_root())))
    out = packed.select("conv_id", "keys", "over", F.posexplode("p").alias("i", "x")).join(lengths, "conv_id")
    return out.select(
        "conv_id", "x.*", (F.col("x.depth") == F.col("length")).alias("ends"), F.slice("keys", F.lit(1), F.col("i") + 1).alias("up"),
        F.when(F.col("i") == 0, F.col("over")).alias("over"),
    )


def _root() -> Column:
    zero = F.lit(0).cast("long")
    return F.struct(zero.alias("depth"), zero.alias("hi"), zero.alias("lo"))


def trie_nodes(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row a node: its key, conv_id (smallest member), n_convs, n_ends, chars, up, over. The root is there if any conversation is."""
    of_turns = rows.groupBy(*_KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if("ends").alias("n_ends"), F.first("chars").alias("chars"),
        F.first("up").alias("up"), F.first("over", ignorenulls=True).alias("over"),
    )
    kind = of_turns.schema["up"].dataType
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if(F.col("length") == 0).alias("n_ends"))
    root = root.where("n_convs > 0").select(
        _root().alias("r"), "conv_id", "n_convs", "n_ends", F.lit(0).cast("long").alias("chars"), F.array(_root()).cast(kind).alias("up"), F.lit(None).cast(kind).alias("over")
    )
    nodes = of_turns.unionByName(root.select("r.*", *(c for c in root.columns if c != "r")))
    leaf = (F.col("n_ends") == F.col("n_convs")).cast("long")
    return nodes.withColumns({"leaf": leaf, "own": (F.col("n_convs") - 1) * F.col("chars")})


def _complete(roots: DataFrame) -> DataFrame:
    """Band roots (key, above: the key of the root of the band above, leaves, saved) with totals over all bands below them.

    Round r sums what is 2^r to 2^(r+1) - 1 bands below, and looks twice as far up the next time.
    """
    roots = materialize(roots, "band_roots")
    while not roots.where("above IS NOT NULL").isEmpty():
        # Many roots share one above: partial sums come first, and Spark splits what stays hot, as both sides are scans.
        below = roots.where("above IS NOT NULL").groupBy(F.col("above").alias("key")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        summed = roots.join(below, "key", "left")
        summed = summed.select("key", "above", *((F.col(a) + F.coalesce(b, F.lit(0))).alias(a) for a, b in (("leaves", "l"), ("saved", "s"))))
        farther = roots.select(F.col("key").alias("above"), F.col("above").alias("next"))
        roots = materialize(summed.join(farther, "above", "left").select("key", F.col("next").alias("above"), "leaves", "saved"), "band_roots")
    return roots


def roll_up(nodes: DataFrame) -> DataFrame:
    """key, n_children, n_leaves, saved_tokens of every node."""
    key = F.struct(*_KEY)
    top = F.get("up", F.lit(0))
    in_band = nodes.groupBy(top.alias("key")).agg(F.sum("leaf").alias("leaves"), F.sum("own").alias("saved"))
    roots = nodes.where("over IS NOT NULL").select(key.alias("key"), "over")
    above = F.get("over", F.lit(0))
    linked = in_band.join(roots.select("key", F.when(above["depth"] > 0, above).alias("above")), "key")
    done = _complete(linked.select("key", "above", "leaves", "saved"))
    depth = F.col("depth")
    one = lambda to, child: F.struct(to.alias("key"), child.cast("long").alias("children"))
    up = nodes.select("depth", "leaf", "own", F.explode(F.transform("up", lambda k: one(k, k["depth"] == F.col("depth") - 1))).alias("t"))
    over = roots.join(done, "key").withColumn("depth", F.col("key.depth"))
    over = over.select("leaves", "saved", F.explode(F.transform("over", lambda k: one(k, k["depth"] == depth - 1))).alias("t"))
    parts = up.select("t.*", F.col("leaf").alias("leaves"), F.col("own").alias("saved")).unionByName(over.select("t.*", "leaves", "saved"))
    return parts.groupBy("key").agg(F.sum("children").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def ends_hash(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """key, ends_sha256 for nodes where a conversation ends.

    A node may be where a third of all conversations end, and a digest is sequential. Ids are joined in ranges of at most
    ENDS, spread over the tasks; a node's ranges, so many times fewer rows, then pass through one task's hash as a stream.
    """
    ended = rows.where("ends").select(F.struct(*_KEY).alias("key"), "conv_id")
    ended = ended.unionByName(lengths.where("length = 0").select(_root().alias("key"), "conv_id"))
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))
    ranges = ended.groupBy("key", F.floor(F.col("conv_id") / ENDS).alias("r")).agg(F.concat_ws(",", ids).alias("ids"))
    ordered = ranges.repartition("key").sortWithinPartitions("key", "r").select("key.*", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            keys, digests = [], []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "ids")), strict=True):
                if key != at:
                    if at is not None:
                        keys.append(at)
                        digests.append(state.hexdigest())
                    at, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            yield _hashed(keys, digests)
        if at is not None:
            yield _hashed([at], [state.hexdigest()])

    hashed = ordered.mapInArrow(run, "depth long, hi long, lo long, ends_sha256 string")
    return hashed.select(F.struct(*_KEY).alias("key"), "ends_sha256")


def _hashed(keys: list[list[int]], digests: list[str]) -> pa.RecordBatch:
    columns = [pa.array([k[n] for k in keys], pa.int64()) for n in range(len(_KEY))]
    return pa.RecordBatch.from_arrays([*columns, pa.array(digests, pa.string())], names=[*_KEY, "ends_sha256"])


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """All nodes of the trie of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    A rebuilt conversation starts with the first crc32(id) % 6 turns of that whose id ends in 00 below it, then has its own
    behind as many. Turns go by ``turn``, null first; those that tie by role, then text, in UTF-8. Null roles and texts are
    empty. Rows without a conv_id take no part. Repeated rows are turns of their own. An empty table gives no node, not even
    a root. Other columns are not looked at; texts of any length only meet a sort, a digest and a count of code points.
    """
    prepare(conversations.sparkSession)
    turns, lengths = rebuilt(ordered_turns(conversations, conv_col, turn_col, role_col, text_col))
    lengths = materialize(lengths, "lengths")
    rows = materialize(prefixes(turns, lengths), "prefixes")
    nodes = materialize(trie_nodes(rows, lengths), "nodes")
    key = F.struct(*_KEY)
    totals = materialize(roll_up(nodes), "totals")
    parent = F.when(F.size("up") > 1, F.get("up", F.size("up") - 2)).when(F.col("depth") > 0, F.get("over", F.size("over") - 1))
    out = nodes.select(key.alias("key"), "conv_id", "depth", "n_convs", parent.alias("parent")).join(totals, "key")
    out = out.join(ends_hash(rows, lengths), "key", "left")
    # A node of very many children is a hot key on the left, split by Spark.
    out = materialize(out.drop("key"), "joined").join(nodes.select(key.alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


#: SQL of op12 for DuckDB; SQL has no CRC-32, so it is taken bit by bit.
OP12_SQL = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS at
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 100 AS base,
        xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
          lambda d: [CAST(ascii(d) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
          lambda x, y: xor(xor(x, y) >> 1, 3988292384 * (xor(x, y) & 1))), 4294967295) % 6 AS h
      FROM t GROUP BY conv_id),
k AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS taken FROM c LEFT JOIN c b ON b.conv_id = c.base),
r AS (SELECT k.conv_id, t.at AS d, t.role, t.text FROM k JOIN t ON t.conv_id = k.base AND t.at <= k.taken
      UNION ALL SELECT k.conv_id, t.at - k.h + k.taken, t.role, t.text FROM k JOIN t ON t.conv_id = k.conv_id AND t.at > k.h),
s AS (SELECT k.conv_id, coalesce(list({'role': r.role, 'text': r.text} ORDER BY r.d) FILTER (r.d IS NOT NULL), []) AS turns
      FROM k LEFT JOIN r USING (conv_id) GROUP BY k.conv_id),
p AS (SELECT conv_id, len(turns) AS n, unnest(range(len(turns) + 1)) AS depth, turns FROM s),
m AS (SELECT conv_id, n, depth, sha256(CAST(to_json(turns[1:depth]) AS VARCHAR)) AS id, length(turns[depth].text) AS chars,
        CASE WHEN depth > 0 THEN sha256(CAST(to_json(turns[1:depth - 1]) AS VARCHAR)) END AS up,
        list_transform(range(depth + 1), lambda d: sha256(CAST(to_json(turns[1:d]) AS VARCHAR))) AS path FROM p),
g AS (SELECT depth, id, up, any_value(path) AS path, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(any_value(chars), 0) AS own,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
      FROM m GROUP BY depth, id, up),
f AS (SELECT g.*, (SELECT count(*) FROM g x WHERE x.up = g.id AND x.depth = g.depth + 1) AS n_children FROM g),
u AS (SELECT unnest(path) AS id, n_children, own FROM f),
w AS (SELECT id, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(own) AS saved_tokens FROM u GROUP BY id)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(w.n_leaves AS BIGINT) AS n_leaves,
  CAST(w.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN w ON w.id = f.id LEFT JOIN g q ON q.id = f.up AND q.depth = f.depth - 1
"""

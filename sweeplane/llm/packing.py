"""Sequence packing as cutting stock: column generation over the length histogram, patterns dealt to ranked documents.

A document longer than a sequence is cut into full sequences and a rest. The rests' lengths are rounded up to GRAIN
tokens and counted; the counts (at most length/GRAIN of them, whatever the table's size) go to the driver. Rests of up to
SHORT tokens have a class for every length, and so many of one length are an item that rounding costs next to nothing. A
linear program picks patterns of items that fill a sequence; a knapsack dynamic program prices new patterns; the rounded
solution is a table of patterns. Rests are ranked within their class and a rank leads to its sequence by a search in that
table, so the rows themselves never leave the executors. Pieces that fill a sequence are numbered in the task that cuts
them, and shifted by the totals of the tasks before it: they are never shuffled.
"""

from __future__ import annotations

import json
import string
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sweeplane.llm.common import join_marked, materialize, prepare, texts_of

#: Length classes are multiples of so many tokens; up to SHORT tokens every length is a class, whose pieces go together in
#: items that rounding makes longer by a share of ITEM_SLACK at most, if items of ITEM_TOKENS can.
GRAIN = 16
SHORT = 256
ITEM_SLACK = 0.01
ITEM_TOKENS = 512
#: The linear program ends this close to the bound of sequences without any padding.
NEAR_BOUND = 0.0005
#: Chunks of the table; pieces of one class are ranked within each. Their counts are CHUNKS times the classes at most.
CHUNKS = 1024
#: Bytes of words and their ids, with what holds them (WORD_BYTES each), that a worker keeps; then it starts anew.
CACHE_BYTES = 96 << 20
WORD_BYTES = 200
#: Marks that, behind letters, are split from them by the tokenizer's pattern.
MARKS = string.punctuation
#: White space to the tokenizer's pattern but not to ``str.split``, and the other way round.
_ODD_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")


# -- the cutting-stock problem ------------------------------------------------------------------------------------


def price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most value that ``capacity`` holds, and how often each item is taken."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fits = sizes <= room
        options = np.where(fits, values + best[np.maximum(room - sizes, 0)], -1.0)
        k = int(options.argmax())
        if options[k] > best[room - 1] + 1e-12:
            best[room], took[room] = options[k], k
        else:
            best[room] = best[room - 1]
    counts, room = np.zeros(len(sizes), dtype=np.int64), capacity
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            counts[took[room]] += 1
            room -= int(sizes[took[room]])
    return float(best[capacity]), counts


def column_generation(
    sizes: np.ndarray, demand: np.ndarray, capacity: int, max_columns: int = 1500
) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one a row) and how often to use each (fractional), covering ``demand`` with about least sequences.

    Revised simplex on the covering program: the basis starts with one pattern a class, the knapsack finds the column
    of best reduced cost under the current duals, and the ratio test says which pattern leaves.
    """
    m = len(sizes)
    patterns = np.diag(capacity // sizes).astype(np.int64)
    costs = np.ones(m)
    inverse = np.diag(1.0 / np.diag(patterns))
    use = demand * np.diag(inverse)
    bound = float(demand @ sizes) / capacity
    for _ in range(max_columns):
        duals = costs @ inverse
        if use @ costs <= bound * (1 + NEAR_BOUND):
            break
        # Price near the duals that fill alone would give, for those of early bases swing; else with the duals as are.
        for share in (0.2, 1.0):
            _, pattern = price(np.maximum(share * duals + (1 - share) * sizes / capacity, 0), sizes, capacity)
            if (value := float(duals @ pattern)) > 1 + 1e-6:
                break
        gain, cost = value - 1, 1.0
        if -duals.min() > gain:  # worth more to cover a class beyond its demand: its surplus column comes in
            gain, cost, pattern = -duals.min(), 0.0, np.zeros(m, dtype=np.int64)
            pattern[int(duals.argmin())] = -1
        if gain <= 1e-6:
            break
        direction = inverse @ pattern
        with np.errstate(divide="ignore", invalid="ignore"):
            ratios = np.where(direction > 1e-7, use / direction, np.inf)
        amount = float(ratios.min())
        if not np.isfinite(amount):
            break
        tied = ratios <= amount * (1 + 1e-9) + 1e-9
        leave = int(np.where(tied, direction, -1).argmax())  # of ties the largest pivot, for a stable inverse
        use = np.maximum(use - amount * direction, 0)
        use[leave], costs[leave], patterns[leave] = amount, cost, pattern
        inverse[leave] /= direction[leave]
        others = np.arange(m) != leave
        inverse[others] -= np.outer(direction[others], inverse[leave])
    real = costs > 0
    return patterns[real], use[real]


def plan_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(uses, {size: count}) whose counts sum to the histogram exactly, each filling at most ``capacity``.

    The time goes with capacity times classes for each new column, so give sizes in units of the classes' width.

    The LP's uses are rounded down; what is left (at most one pattern's worth a class) goes best-fit decreasing.
    """
    sizes = np.array(sorted(histogram), dtype=np.int64)
    if not len(sizes):
        return []
    left = np.array([histogram[int(s)] for s in sizes], dtype=np.int64)
    patterns, use = column_generation(sizes, left.astype(float), capacity)
    plan: list[tuple[int, dict[int, int]]] = []
    for pattern, times in zip(patterns, np.floor(use + 1e-7).astype(np.int64), strict=True):
        taken = pattern > 0
        if taken.any():
            times = min(int(times), int((left[taken] // pattern[taken]).min()))
            if times > 0:
                left -= times * pattern
                plan.append((times, {int(s): int(c) for s, c in zip(sizes[taken], pattern[taken], strict=True)}))
    bins: list[tuple[int, dict[int, int]]] = []
    rest = {int(s): int(c) for s, c in zip(sizes, left, strict=True) if c}
    while rest:
        room, filled = capacity, {}
        for size in sorted(rest, reverse=True):
            if (take := min(rest[size], room // size)) > 0:
                filled[size], room = take, room - take * size
                rest[size] -= take
        rest = {s: c for s, c in rest.items() if c}
        bins.append((1, filled))
    return plan + bins


# -- tokens -------------------------------------------------------------------------------------------------------


def _latin_tables() -> tuple[bytes, bytes]:
    """For Latin-1 bytes: lower case with white space as spaces; and kinds (a letter or digit, m mark, p other, space)."""
    lower, kinds = bytearray(256), bytearray(256)
    for i, c in enumerate(map(chr, range(256))):
        space = c.isspace() and c not in _ODD_SPACE
        low = ord(c.lower())
        lower[i] = 32 if space else low if low < 256 else i
        kinds[i] = ord(" " if space else "a" if unicodedata.category(c)[0] in "LN" else "m" if c in ",." else "p")
    return bytes(lower), bytes(kinds)


_LOWER, _KINDS = _latin_tables()


class WordIds:
    """Ids of whole texts by a tokenizer that drops white space: each distinct word is encoded once, by the library.

    Texts of Latin-1 characters are cut as lower-case bytes, with a full stop or comma behind letters as a word of its
    own, as the tokenizer's pattern cuts them too; other texts are cut at white space alone. A text in which a special
    token's string stands is encoded whole, by the library as it loads, which gives that token's id.
    """

    def __init__(self, tokenizer_json: str) -> None:
        import regex
        from tokenizers import Tokenizer

        config = json.loads(tokenizer_json)
        assert not config.get("post_processor"), "only tokenizers without a post-processor join word by word"
        self.json, self.whole = tokenizer_json, None
        self.special = [t["content"] for t in config["added_tokens"]]
        # Words are lower-case already, so that what looks like a special token among them was none in the text.
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = True
        self.space = regex.compile(r"\s+")
        vocabulary = self.tokenizer.get_vocab()
        self.word_end = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        if suffix := config["model"].get("end_of_word_suffix"):
            self.word_end[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.ids: dict[bytes | str, bytes] = {}
        self.held = 0

    def words(self, text: str) -> list:
        """The text's words: bytes of a Latin-1 text, strings of others."""
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            if any(c in text for c in _ODD_SPACE):
                return [w for w in self.space.split(text) if w]
            return text.split()
        kinds, raw = raw.translate(_KINDS), raw.translate(_LOWER)
        if b"pm " not in kinds and b"mm " not in kinds:  # else a mark may belong to the one before it
            raw = raw.replace(b", ", b" , ").replace(b". ", b" . ")
        return raw.split(b" ")

    def learn(self, words: set) -> None:
        """Have the ids of these words at hand."""
        ids, letters, others, marked = self.ids, [], [], []
        for w in words:
            text = w.decode("latin-1") if isinstance(w, bytes) else w
            if isinstance(w, str):
                others.append((w, text))
            elif text.isalpha():
                letters.append((w, text))
            elif (p := text.rstrip(MARKS)).isalpha():  # marks behind letters are one token apart from them
                p, m = p.encode("latin-1"), text[len(p) :].encode("latin-1")
                marked.append((w, p, m))
                if p not in ids and p not in words:
                    letters.append((p, p.decode("latin-1")))
                if m not in ids and m not in words:
                    others.append((m, m.decode("latin-1")))
            else:
                others.append((w, text))
        left = self._ask_letters(list(dict(letters).items()))
        others = list(dict(left + others).items())
        for (w, _), code in zip(others, self.tokenizer.encode_batch_fast([t for _, t in others], add_special_tokens=False), strict=True):
            ids[w] = np.array(code.ids, dtype="<u4").tobytes()
        ids.update([(w, ids[p] + ids[m]) for w, p, m in marked])

    def _ask_letters(self, words: list[tuple[bytes, str]]) -> list[tuple[bytes, str]]:
        """Words of letters, encoded as one text; an id whose token has the end-of-word mark closes a word.

        Gives back the words if the tokenizer has no such mark.
        """
        if not (self.word_end.any() and words):
            return words
        code = self.tokenizer.encode_batch_fast([" ".join([t for _, t in words])], add_special_tokens=False)[0]
        ids = np.array(code.ids, dtype="<u4")
        ends = np.flatnonzero(self.word_end[ids]) + 1
        if len(ends) != len(words):
            return words
        data, stops = ids.tobytes(), (4 * ends).tolist()
        self.ids.update((w, data[lo:hi]) for (w, _), lo, hi in zip(words, [0, *stops], stops, strict=False))
        return []

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        if self.held > CACHE_BYTES:
            self.ids.clear()
            self.held = 0
        self.ids[b""] = b""  # between two spaces
        alone = {n for n, t in enumerate(texts) if any(s in t for s in self.special)}
        split = [[] if n in alone else self.words(t) for n, t in enumerate(texts)]
        new = set().union(*split).difference(self.ids)
        self.learn(new)
        look = self.ids.__getitem__
        self.held += 2 * sum(map(len, new)) + WORD_BYTES * len(new)  # ids take about the bytes of their word
        out = [b"".join(map(look, ws)) for ws in split]
        if alone and self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_str(self.json)
        for n in alone:
            out[n] = np.array(self.whole.encode(texts[n], add_special_tokens=False).ids, dtype="<u4").tobytes()
        return out


_TOKENIZERS: dict[int, WordIds] = {}


def _pieces(docs: DataFrame, tokenizer_path: str, capacity: int, least: int, end_id: int, id_col: str, text_col: str, keep: bool):
    """Pieces of at most ``capacity`` ids; ``__nth`` numbers those of ``least`` ids or more within their task, else null."""

    with open(tokenizer_path, encoding="utf-8") as f:
        config = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        key = zlib.crc32(config.value.encode())
        if key not in _TOKENIZERS:
            _TOKENIZERS[key] = WordIds(config.value)
        enc, end, nth = _TOKENIZERS[key], int(end_id).to_bytes(4, "little"), 0
        for batch in batches:
            ids, texts = batch.column(id_col).to_pylist(), texts_of(batch, text_col)
            for at in range(0, len(ids), 128):
                rows: list[list] = [[], [], [], [], [], [], []]
                for doc, data in zip(ids[at : at + 128], enc.encode(texts[at : at + 128]), strict=True):
                    data += end
                    for start in range(0, len(data), 4 * capacity):
                        part = data[start : start + 4 * capacity]
                        full = len(part) >= 4 * least
                        values = (doc, start // 4, len(part) // 4, zlib.crc32(part), len(data) // 4, nth if full else None)
                        nth += full
                        for column, value in zip(rows, values, strict=False):
                            column.append(value)
                        if keep:
                            rows[6].append(np.frombuffer(part, dtype="<u4").astype(np.int32))
                columns = [pa.array(rows[0], batch.column(id_col).type)] + [pa.array(r, pa.int64()) for r in rows[1:6]]
                if keep:
                    columns.append(pa.array(rows[6], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=names[: len(columns)])

    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "__nth", "ids"]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, start long, length long, ids_crc32 long, doc_tokens long, __nth long" + ", ids array<int>" * keep
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def item_pieces(length: int, capacity: int, grain: int = GRAIN) -> int:
    """How many pieces of a length are one item: the fewest whose rounding to ``grain`` costs little, that ``capacity`` holds."""
    most = max(1, min(ITEM_TOKENS, capacity // grain * grain) // length)
    waste = {k: -(-k * length // grain) * grain / (k * length) - 1 for k in range(1, most + 1)}
    return min(waste, key=lambda k: (max(waste[k], ITEM_SLACK), k))


def plan_table(histogram: dict[int, int], capacity: int, grain: int = GRAIN) -> np.ndarray:
    """Rows (class, first rank, first sequence, pieces of the class in a sequence), by class, then rank.

    ``histogram`` has the pieces of each class: 0 for those that fill a sequence, a length up to SHORT, else a multiple of
    ``grain``. Sequences are numbered without a gap.
    """
    whole = histogram.get(0, 0)
    rows, base = [(0, 0, 0, 1)] if whole else [], whole
    # Items of one size, in the order of their classes: (class, pieces in an item, items).
    items: dict[int, list[tuple[int, int, int]]] = {}
    for c, n in sorted(histogram.items()):
        if c:
            k = item_pieces(c, capacity, grain) if c <= SHORT else 1
            items.setdefault(-(-k * c // grain), []).append((c, k, -(-n // k)))
    given = {size: [0, 0] for size in items}  # the class whose items are dealt now, and how many of them are
    for times, pattern in plan_patterns({s: sum(n for _, _, n in own) for s, own in items.items()}, capacity // grain):
        for size, count in pattern.items():
            at, left = 0, times * count  # places of this size in these sequences, in order
            while left:
                which, done = given[size]
                c, k, n = items[size][which]
                take = min(left, n - done)
                # A run of places may begin or end within a sequence: up to that sequence's end, whole ones, and the rest.
                for lo, hi in _runs(at, at + take, count):
                    rows.append((c, (done + lo - at) * k, base + lo // count, min(count, hi - lo) * k))
                at, left = at + take, left - take
                given[size] = [which, done + take] if done + take < n else [which + 1, 0]
        base += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def _runs(lo: int, hi: int, count: int) -> list[tuple[int, int]]:
    """The range cut where its first whole sequence of ``count`` places begins and its last one ends."""
    first, last = min(hi, -(-lo // count) * count), max(lo, hi // count * count)
    cuts = sorted({lo, first, max(first, last), hi})
    return list(zip(cuts, cuts[1:], strict=False))


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, grain: int = GRAIN,
    id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False,
) -> DataFrame:
    """Pack whole texts into sequences: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (, ids).

    A null or empty text is the end id alone. Every row is a document of its own, repeated rows and null ids included.
    Lengths are at most ``capacity``; ``offset`` runs without a gap from 0 in each sequence. Ties within a class are
    dealt by the row's place in the table. An empty table gives no rows. Other columns are not looked at.
    """
    spark = prepare(docs.sparkSession)
    pieces = _pieces(docs, tokenizer_path, capacity, capacity - grain + 1, end_id, id_col, text_col, keep_ids)
    pieces = materialize(pieces.withColumn("__uid", F.monotonically_increasing_id()), "pieces")
    columns = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids
    # Full sequences come first: a piece's number in its task, behind those of the tasks before (one row a task).
    full = pieces.where(F.col("__nth").isNotNull()).withColumn("__task", F.shiftright("__uid", 33))
    tasks = full.groupBy("__task").agg(F.count("*").alias("__n"))
    earlier = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = materialize(tasks.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))), "tasks")
    whole = tasks.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    full = join_marked(full, tasks.drop("__n"), "__task", "inner")
    full = full.withColumns({"sequence_id": F.col("__before") + F.col("__nth"), "offset": F.lit(0).cast("long")})
    # Ranks without a group that holds a whole class: chunks of the table, their counts, and a running total of those.
    size = F.when(F.col("length") <= SHORT, F.col("length")).otherwise(F.ceil(F.col("length") / grain) * grain).cast("int")
    dealt = pieces.where(F.col("__nth").isNull()).withColumn("__size", size)
    dealt = dealt.withColumn("__chunk", F.pmod(F.xxhash64("__uid"), F.lit(CHUNKS)).cast("int"))
    counts = materialize(dealt.groupBy("__size", "__chunk").agg(F.count("*").alias("__n")), "counts", dealt.count())
    histogram = {r["__size"]: r["n"] for r in counts.groupBy("__size").agg(F.sum("__n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(plan_table({0: whole, **histogram}, capacity, grain))
    before = Window.partitionBy("__size").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = Window.partitionBy("__size", "__chunk").orderBy("__uid")
    ranked = dealt.withColumn("__rank", F.row_number().over(within) - 1).join(counts, ["__size", "__chunk"])

    @F.arrow_udf("long")
    def sequence(size: pa.Array, rank: pa.Array) -> pa.Array:
        """The plan's row of a class with the last first rank that is not above the rank, and from there by arithmetic."""
        table = plan.value
        size, rank = size.to_numpy().astype(np.int64), rank.to_numpy()
        at = np.searchsorted(table[:, 0] << 44 | table[:, 1], size << 44 | rank, side="right") - 1
        _, first, base, count = table[at].T
        return pa.array(base + (rank - first) // count)

    placed = ranked.withColumn("sequence_id", sequence(F.col("__size"), F.col("__rank") + F.col("__before")))
    inside = Window.partitionBy("sequence_id").orderBy("__uid").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    return full.select(columns).unionByName(placed.select(columns))

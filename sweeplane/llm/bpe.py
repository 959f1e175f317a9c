"""Byte-level BPE by corpus-level merge replay, and decoding.

A block of documents is the corpus: its distinct pattern matches are laid out as one row of byte tokens, an inverted
index leads from each mergeable token pair to the positions where it stands, and the merges are replayed in rank
order over all positions at once, touching only the neighbours of what merged. A word's merges depend on no other
word, so replaying per block gives the ids of a replay over the whole table, without shuffling a text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sweeplane.llm.common import map_arrow, prepare, sha256, texts_of

#: Bytes of distinct matches and their ids, with what holds them, that a worker keeps between blocks; then it starts anew.
CACHE_BYTES = 192 << 20
#: Token pairs whose merge a worker remembers.
KNOWN_PAIRS = 1_000_000


def load_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a rank file: base64 of the token's bytes, a space, its rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Merges:
    """A rank file's merges: which token two neighbours make, by their ids (a token's id is its rank)."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.token = {r: t for t, r in ranks.items()}
        one = [bytes([b]) for b in range(256)]
        self.byte_ids = np.array([ranks.get(b, -1) for b in one])
        self.byte_pairs = np.array([[ranks.get(a + b, -1) for b in one] for a in one])
        self.known: dict[int, int] = {}

    def look_up(self, key: int) -> int:
        """The rank of the pair ``left << 20 | right``, -1 if the two do not merge; remembered."""
        if len(self.known) > KNOWN_PAIRS:
            self.known.clear()
        rank = self.ranks.get(self.token[key >> 20] + self.token[key & 0xFFFFF], -1)
        self.known[key] = rank
        return rank

    def index(self, words: list[bytes]) -> tuple[list[int], list[int], list[int], list[int], dict[int, list[int]]]:
        """Words laid out as bytes: tokens, next and previous places (-1 at a word's ends), heads, places by rank."""
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        ends = np.cumsum([len(w) for w in words])
        heads = np.append(0, ends[:-1])
        after, before = np.arange(1, len(data) + 1), np.arange(-1, len(data) - 1)
        after[ends - 1] = before[heads] = -1
        rank = self.byte_pairs[data[:-1], data[1:]]
        rank[ends[:-1] - 1] = -1
        places = np.flatnonzero(rank >= 0)
        places = places[np.argsort(rank[places], kind="stable")]
        found, starts = np.unique(rank[places], return_index=True)
        by_rank = {r: p.tolist() for r, p in zip(found.tolist(), np.split(places, starts[1:]), strict=True)} if len(found) else {}
        return self.byte_ids[data].tolist(), after.tolist(), before.tolist(), heads.tolist(), by_rank


def replay(words: list[bytes], merges: Merges) -> list[list[int]]:
    """The ids of each distinct word, by replaying all merges over all words in rank order.

    Of the pairs that a word has at a time, the one of lowest rank merges first, and of equals the leftmost. A word
    that is a token as it stands gives that token.
    """
    out = [[r] if (r := merges.ranks.get(w)) is not None else [] for w in words]
    open_words = [n for n, ids in enumerate(out) if not ids and words[n]]
    if not open_words:
        return out
    token, after, before, heads, index = merges.index([words[n] for n in open_words])
    known, look_up = merges.known, merges.look_up
    queue = list(index)
    heapq.heapify(queue)
    while queue:
        rank = heapq.heappop(queue)
        where = index.pop(rank, None)
        if where is None:
            continue
        where.sort()
        for n, i in enumerate(where):
            j = after[i]
            if j < 0 or token[i] < 0:
                continue  # an earlier merge took one of the two
            key = token[i] << 20 | token[j]
            if (known[key] if key in known else look_up(key)) != rank:
                continue
            token[i], token[j] = rank, -1
            after[i] = k = after[j]
            lower = False
            if k >= 0:
                before[k] = i
                key = rank << 20 | token[k]
                r = known[key] if key in known else look_up(key)
                if r >= 0:
                    if r not in index:
                        index[r] = []
                        heapq.heappush(queue, r)
                    index[r].append(i)
                    lower = r < rank
            if (left := before[i]) >= 0:
                key = token[left] << 20 | rank
                r = known[key] if key in known else look_up(key)
                if r >= 0:
                    if r not in index:
                        index[r] = []
                        heapq.heappush(queue, r)
                    index[r].append(left)
                    lower = lower or r < rank
            if lower and n + 1 < len(where):  # a lower rank came up: it goes before the rest of these
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(queue, rank)
                index[rank].extend(where[n + 1 :])
                break
    for n, i in zip(open_words, heads, strict=True):
        ids = out[n]
        while i >= 0:
            ids.append(token[i])
            i = after[i]
    return out


class Encoder:
    """Encodes and decodes texts with one rank file; keeps the ids of recent words."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.merges = Merges(ranks)
        self.find = regex.compile(pattern).findall
        self.ids: dict[str, str] = {}
        self.held = 0
        self.token = {str(r): t for t, r in ranks.items()}

    def learn(self, words: set[str]) -> None:
        """Have the ids of these matches at hand, as decimal ids joined by commas."""
        new = list(words.difference(self.ids))
        for word, ids in zip(new, replay([w.encode() for w in new], self.merges), strict=True):
            self.ids[word] = joined = ",".join(map(str, ids))
            self.held += len(word) + len(joined) + 250

    def encode_block(self, texts: list[str]) -> list[str]:
        """Each text's ids, joined by commas."""
        if self.held > CACHE_BYTES:
            self.ids.clear()
            self.held = 0
        found = [self.find(t) for t in texts]
        self.learn(set().union(*found))
        look = self.ids.__getitem__
        return [",".join(map(look, f)) for f in found]

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.split(","))) if ids else b""


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(data: bytes, pattern: str) -> Encoder:
    """This worker's encoder for a rank file and pattern."""
    key = (hashlib.sha256(data).hexdigest(), pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(load_ranks(data), pattern)
    return _ENCODERS[key]


def _ranks_broadcast(df: DataFrame, ranks_path: str):
    with open(ranks_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def bpe_encode(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
    digests: bool = False,
) -> DataFrame:
    """Encode every whole text: id, ids array<int>; with ``digests`` instead n_tokens, ids_sha256, decoded_sha256.

    A null text is encoded as an empty one (no ids). Each row gives one row, repeated rows and null ids included; an empty
    table gives none; other columns are not looked at. The rank file's content (of fixed size) is broadcast.
    """
    prepare(docs.sparkSession)
    ranks = _ranks_broadcast(docs, ranks_path)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(ranks.value, pattern)
        texts = texts_of(batch, text_col)
        rows: list = []
        for at in range(0, len(texts), 64):
            for joined in enc.encode_block(texts[at : at + 64]):
                if digests:
                    n = joined.count(",") + 1 if joined else 0
                    rows.append((n, sha256(joined.encode()), sha256(enc.decode(joined))))
                else:
                    rows.append([int(x) for x in joined.split(",")] if joined else [])
        ids = batch.column(id_col)
        if not digests:
            return pa.RecordBatch.from_arrays([ids, pa.array(rows, pa.list_(pa.int32()))], names=[id_col, "ids"])
        n, enc_sha, dec_sha = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(n, pa.int64()), pa.array(enc_sha), pa.array(dec_sha)],
            names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    rest = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>"
    return map_arrow(docs.select(id_col, text_col), kernel, f"{id_col} {kind}, {rest}")


def bpe_decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Ids back to bytes: id, data binary. Null ids give empty data; an unknown id raises KeyError; no row gives no row."""
    prepare(encoded.sparkSession)
    ranks = _ranks_broadcast(encoded, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {r: t for t, r in load_ranks(ranks.value).items()}
        for batch in batches:
            data = [b"".join(map(token.__getitem__, ids or ())) for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(data, pa.binary())], names=[id_col, "data"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"{id_col} {kind}, data binary")

"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The queue has one bucket per merge rank, holding positions in a linked list of symbols, and
a bitmap of the ranks whose buckets have entries, summed up in coarser bitmaps of 64-way
nodes. The next rank is found by find-first-set from the top; entries whose pair has changed
meanwhile are stale and skipped. One queue serves all distinct pre-tokens of a group of texts:
pre-tokens are independent, so all their entries of a rank merge in one vectorised step. When
a merge can make a pair of lower rank than its own, only the leftmost entry of each pre-token
merges before the queue is asked again, which keeps the order of the classical algorithm.
The cost of a pre-token is near-linear in its length, however long it is.

Ranks come from a file of the public tokenizers; its path is a parameter. Vocabularies are
never trained here. No special tokens are used. Null and empty texts have no ids. Decoding
joins the bytes of the ids; ids outside the vocabulary raise IndexError.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import count as count_up

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from vectaria.llm.pretokens import pretokens
from vectaria.llm.textbatch import SpanHash, TextBatch, annotate, same_bytes, slices

#: Bytes of text whose distinct pre-tokens share one queue.
GROUP_BYTES = 4 << 20
NONE = np.int32(2**31 - 1)


class Vocabulary:
    """Ranks, their merge table and the bytes of each id."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(r) for a, r in (line.split() for line in f if line.strip())}
        size = max(ranks.values()) + 1
        self.size = size
        tokens = [b""] * size
        for t, r in ranks.items():
            tokens[r] = t
        self.token_size = np.array([len(t) for t in tokens], np.int64)
        self.token_start = np.concatenate([[0], np.cumsum(self.token_size)])[:-1]
        self.token_data = np.frombuffer(b"".join(tokens), np.uint8)
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        keys, values = [], []
        early = np.zeros(size, bool)  # of tokens that a merge of lower rank can take up
        for t, r in ranks.items():
            for j in range(1, len(t)):
                a, b = ranks.get(t[:j]), ranks.get(t[j:])
                if a is not None and b is not None:
                    keys.append(a * size + b)
                    values.append(r)
                    early[a] |= a > r
                    early[b] |= b > r
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.values, self.early = np.array(keys, np.int64)[order], np.array(values, np.int32)[order], early
        first = np.arange(256)
        self.byte_pair = self.pair(np.repeat(self.byte_id[first], 256), np.tile(self.byte_id[first], 256))

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols; NONE if they don't merge."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(self.keys.searchsorted(key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class RankQueue:
    """Buckets of positions by rank; the lowest rank is found through a hierarchy of bitmaps."""

    def __init__(self, ranks: int):
        self.levels = []
        n = ranks
        while not self.levels or n > 1:
            n = (n + 63) >> 6
            self.levels.append([0] * n)
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, rank: int, positions: np.ndarray) -> None:
        if (bucket := self.buckets.get(rank)) is not None:
            bucket.append(positions)
            return
        self.buckets[rank] = [positions]
        for level in self.levels:
            had = level[rank >> 6]
            level[rank >> 6] = had | 1 << (rank & 63)
            if had:
                break
            rank >>= 6

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        if len(ranks) == 1:
            self.push(int(ranks[0]), positions)
            return
        order = ranks.argsort(kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        at = 0
        for rank, to in zip(ranks[np.concatenate([[0], cuts])].tolist(), [*cuts.tolist(), len(ranks)], strict=True):
            self.push(rank, positions[at:to])
            at = to

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The lowest rank with entries, and all its entries in order of position."""
        if not self.levels[-1][0]:
            return None
        rank = 0
        for level in reversed(self.levels):
            word = level[rank]
            rank = rank << 6 | ((word & -word).bit_length() - 1)
        at = rank
        for level in self.levels:
            level[at >> 6] &= ~(1 << (at & 63))
            if level[at >> 6]:
                break
            at >>= 6
        parts = self.buckets.pop(rank)
        if len(parts) == 1:
            return rank, parts[0]
        return rank, np.unique(np.concatenate(parts))


def encode_spans(data: np.ndarray, size: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of spans laid end to end in ``data``, joined, and the number of each span's ids."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(size), np.int64)
    span = np.repeat(np.arange(len(size), dtype=np.int32), size)
    symbol = np.append(vocab.byte_id[data], np.int32(0))
    after = np.arange(1, n + 2, dtype=np.int32)
    before = np.arange(-1, n, dtype=np.int32)
    filled = size > 0
    stops = np.cumsum(size)[filled]
    after[stops - 1] = n
    before[(stops - size[filled])] = n
    after[n] = before[n] = n
    pair = np.full(n + 1, NONE, np.int32)
    pair[: n - 1] = vocab.byte_pair[data[:-1].astype(np.int64) << 8 | data[1:]]
    pair[stops - 1] = NONE
    alive = np.ones(n + 1, bool)

    queue = RankQueue(vocab.size)
    at = np.flatnonzero(pair[:n] != NONE).astype(np.int32)
    if len(at):
        queue.push_all(pair[at], at)
    while (got := queue.pop()) is not None:
        rank, at = got
        at = at[pair[at] == rank]
        if not len(at):
            continue
        if len(at) > 1:
            if vocab.early[rank]:
                own = span[at]
                lead = np.empty(len(at), bool)
                lead[0] = True
                np.not_equal(own[1:], own[:-1], out=lead[1:])
                if not lead.all():
                    queue.push(rank, at[~lead])
                    at = at[lead]
            else:
                joined = after[at[:-1]] == at[1:]
                if joined.any():
                    idx = np.arange(len(at))
                    begun = np.maximum.accumulate(np.where(np.concatenate([[True], ~joined]), idx, 0))
                    at = at[(idx - begun) % 2 == 0]
        gone = after[at]
        then = after[gone]
        symbol[at] = rank
        alive[gone] = False
        pair[gone] = NONE
        after[at] = then
        before[then] = at
        after[n] = before[n] = n
        prior = before[at]
        both = np.concatenate([at, prior])
        follow = after[both]
        ok = (follow != n) & (both != n)
        made = np.where(ok, vocab.pair(symbol[both], symbol[follow]), NONE)
        pair[both] = made
        pair[n] = NONE
        live = made != NONE
        if live.any():
            queue.push_all(made[live], both[live])
    keep = alive[:n]
    return symbol[:n][keep], np.bincount(span[keep], minlength=len(size))


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., for size[0] items, then the same of each next."""
    total = np.cumsum(size)
    if not len(total) or not total[-1]:
        return np.zeros(0, np.int64)
    return np.arange(total[-1]) + np.repeat(start - (total - size), size)


def _distinct(slices_: list[tuple[TextBatch, np.ndarray, np.ndarray]], salt: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]] | None:
    """Bytes and sizes of the distinct pre-tokens of several slices, and which of them each pre-token is.

    Pre-tokens are told apart by hashes, then compared byte by byte with the one they are taken
    for (those of up to seven bytes have hashes of their own). None if two differ after all.
    """
    seen, data, sizes, keys = np.zeros(0, np.uint64), [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)], []
    hashers = [b.hasher(salt=salt) for b, _, _ in slices_]
    for (b, start, stop), hashed in zip(slices_, hashers, strict=True):
        key, at, inverse = np.unique(hashed(start, stop), return_index=True, return_inverse=True)
        new = ~np.isin(key, seen, assume_unique=True)
        seen = np.concatenate([seen, key[new]])
        size = (stop - start)[at[new]]
        data.append(b.data[spread(start[at[new]], size)])
        sizes.append(size)
        keys.append((key, inverse.astype(np.int32)))
    data, sizes = np.concatenate(data), np.concatenate(sizes)
    first, every = np.cumsum(sizes) - sizes, SpanHash(data)
    order, rows = np.argsort(seen), []
    for (_, start, stop), hashed, (key, inverse) in zip(slices_, hashers, keys, strict=True):
        row = order[np.searchsorted(seen, key, sorter=order)][inverse].astype(np.int32) if len(key) else np.zeros(0, np.int32)
        long = np.flatnonzero((stop - start > 7) | (sizes[row] > 7))
        own = row[long]
        if not same_bytes(hashed, start[long], stop[long], every, first[own], first[own] + sizes[own]).all():
            return None
        rows.append(row)
    return data, sizes, rows


def encode_group(texts: pa.Array, vocab: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray, TextBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Encodes texts with one queue; for each slice: ids, bounds of each text's ids, the slice, pre-token starts and bounds, ids of each pre-token."""
    parts = [(b, *pretokens(b)) for b in (TextBatch(texts.slice(a, z - a)) for a, z in slices(texts))]
    if not parts:
        return
    # another hash function, should two pre-tokens ever have one hash
    data, sizes, rows = next(filter(None, (_distinct([p[:3] for p in parts], salt) for salt in count_up())))
    ids, count = encode_spans(data, sizes, vocab)
    offset = np.cumsum(count) - count
    for (b, start, _, bounds), row in zip(parts, rows, strict=True):
        own = count[row]
        total = np.concatenate([[0], np.cumsum(own)])
        yield ids[spread(offset[row], own)], total[bounds], b, start, bounds, own


def decode(ids: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the ids, joined, and the number of bytes of each id."""
    size = vocab.token_size[ids]
    return vocab.token_data[spread(vocab.token_start[ids], size)], size


FIELDS = "ids array<int>, decoded string"
DIGESTS = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _texts(texts: pa.Array, path: str, digests: bool) -> list:
    vocab = vocabulary(path)
    out: list[list] = [[], [], []]
    for a, z in slices(texts, GROUP_BYTES):
        for ids, bounds, b, _, _, _ in encode_group(texts.slice(a, z - a), vocab):
            plain, size = decode(ids, vocab)
            cuts = np.concatenate([[0], np.cumsum(size)])[bounds]
            if digests:
                wide = ids.astype("<u4")
                out[0].extend(np.diff(bounds).tolist())
                out[1].extend(hashlib.sha256(wide[i:j]).hexdigest() for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
                out[2].extend(hashlib.sha256(plain[i:j]).hexdigest() for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
            else:
                out[0].append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))))
                out[1].append(pa.Array.from_buffers(pa.large_utf8(), b.n, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(plain))]))
    if digests:
        return [pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.string(), pa.string()), strict=True)]
    if not out[0]:
        return [pa.array([], pa.list_(pa.int32())), pa.array([], pa.string())]
    return [pa.concat_arrays(out[0]), pa.concat_arrays(out[1])]


def bpe(df: DataFrame, text_col: str = "text", name: str = "bpe", *, ranks: str, digests: bool = False, keep: list[str] | None = None) -> DataFrame:
    """``df`` with a struct column: ids and decoded text of each text, or (``digests``) their number and SHA-256."""

    def compute(texts: pa.Array) -> list:
        return _texts(texts, ranks, digests)

    return annotate(df, text_col, name, DIGESTS if digests else FIELDS, compute, keep)


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    r = bpe(docs, ranks=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), digests=True, keep=["doc_id"])
    return r.select("doc_id", "bpe.n_tokens", "bpe.ids_sha256", "bpe.decoded_sha256")

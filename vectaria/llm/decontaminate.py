"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are normalised (all letters case-folded, runs of white space and ASCII
punctuation written as one blank). An alignment of ``WINDOW`` signs (or a whole shorter item)
with at most ``k`` edits keeps at least ``WINDOW - q + 1 - q k`` q-grams of the item, all on
diagonals no further than ``k`` apart. So, per text:

1. Positions whose q-gram occurs in the benchmark are found through a hashed bitmap and a
   sorted table; positions in stretches with fewer hits than the bound are dropped.
2. Hits are dealt to (item, diagonal band); bands of width 2 k overlap by half, so some band
   holds every alignment. Bands with a stretch that meets the bound are retained.
3. Retained regions are verified by a banded alignment of the item window with the text; a
   text with a verified region is contaminated.

Hits are listed for rectangles of text positions by benchmark positions, which overlap by the
reach of an alignment and are halved until they have at most ``HITS`` hits; rectangles of a text
and an item already found together are passed over. So memory stays bounded however often a
gram repeats on both sides.

Items of fewer than ``MIN_ITEM`` signs are matched whole, without edits, where words begin and
end. The benchmark is worked through in parts of ``MOST_BYTES`` characters: each is sent to the
tasks (at most 41 bytes for each normalised byte of its items and 4 MB more), applied to all
texts, and released before the next, the rows being written to the shared folder in between; a
single part needs no such table. Null and empty texts are clean, null items and items without a
letter or digit are never matched. Whole texts and items are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectaria.functions.state import Scratch
from vectaria.llm.bpe import spread
from vectaria.llm.textbatch import LOWER, U64, SpanHash, TextBatch, annotate, col, in_slices, same_bytes

Q = 8
WINDOW = 64
EDITS = 4
MIN_ITEM = 32
#: Characters of benchmark text in one broadcast table.
MOST_BYTES = 4 << 20
#: Hits listed at once.
HITS = 1 << 18
_BITS = 22
#: Keeps diagonals positive.
_ORIGIN = 1 << 40

_FOLD = LOWER.copy()
_FOLD[[c for c in range(128) if not chr(c).isalnum()]] = 0x20


def folded(texts: pa.Array) -> TextBatch:
    """The texts with all letters case-folded; ``normalised`` lower-cases what is ASCII alone."""
    return TextBatch(pa.array([t if t is None or t.isascii() else t.casefold() for t in texts.to_pylist()], pa.large_string()))


def normalised(b: TextBatch) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes of all texts, each after one blank, and where each text starts."""
    d = _FOLD[b.data]
    blank = d == 0x20
    blank[b.beg - 1] = False  # separators stay
    keep = np.ones(len(d), bool)
    keep[1:] = ~(blank[1:] & (d[:-1] == 0x20))
    keep[b.beg - 1] = True
    keep[-1] = True
    at = np.cumsum(keep) - 1
    return d[keep], at[b.beg - 1] + 1


def grams(d: np.ndarray) -> np.ndarray:
    """The 8-byte gram that starts at each position (Q is 8)."""
    if len(d) < Q:
        return np.zeros(0, U64)
    return np.lib.stride_tricks.sliding_window_view(d, Q).copy().view(U64).ravel()


def _slot(g: np.ndarray) -> np.ndarray:
    return ((g * U64(0x9E3779B97F4A7C15)) >> U64(64 - _BITS)).astype(np.int64)


def budget(size: int) -> tuple[int, int, int]:
    """Window, edits and least shared q-grams for an item of ``size`` signs."""
    w = min(WINDOW, size)
    k = min(EDITS, max(0, (w - Q) // Q))
    return w, k, w - Q + 1 - Q * k


class Items:
    """Normalised benchmark items and their gram table."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        d, start = normalised(folded(pa.array(texts, pa.string())))
        stop = np.append(start[1:] - 1, len(d) - 1)[: len(start)]
        self.ids, self.texts, keys, item, offset = [], [], [], [], []
        short: dict[bytes, list[int]] = {}
        for i, a, z in zip(ids, start.tolist(), stop.tolist(), strict=True):
            t = d[a:z]
            t = t[1:] if len(t) and t[0] == 0x20 else t
            t = t[:-1] if len(t) and t[-1] == 0x20 else t
            if len(t) < MIN_ITEM:
                if len(t):
                    short.setdefault(t.tobytes(), []).append(i)
                continue
            g = grams(t)
            keys.append(g)
            item.append(np.full(len(g), len(self.ids)))
            offset.append(np.arange(len(g)))
            self.ids.append(i)
            self.texts.append(t)
        whole = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        keys, item, offset = whole(keys, U64), whole(item, np.int64), whole(offset, np.int64)
        order = np.argsort(keys, kind="stable")
        keys, self.item, self.offset = keys[order], item[order], offset[order]
        self.keys, self.first = np.unique(keys, return_index=True)
        self.count = np.diff(np.append(self.first, len(keys)))
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[_slot(self.keys)] = True
        budgets = [budget(len(t)) for t in self.texts]
        self.window, self.edits, self.least = (np.array([b[k] for b in budgets], np.int64) for k in range(3))
        #: where each long item stands in all of them laid end to end
        self.begin = np.cumsum([0, *map(len, self.texts)])
        self.short = ShortItems(short)


class ShortItems:
    """Items that are matched whole: their normalised texts by number of words."""

    def __init__(self, items: dict[bytes, list[int]]):
        self.ids, self.n_words = list(items.values()), np.array([t.count(b" ") + 1 for t in items], np.int64)
        size = np.array([len(t) for t in items], np.int64)
        self.stop = np.cumsum(size)
        self.start = self.stop - size
        self.data = SpanHash(np.frombuffer(b"".join(items), np.uint8))
        self.key = self.data(self.start, self.stop)

    def found(self, d: np.ndarray, start: np.ndarray) -> list[tuple[int, int]]:
        """(text, item row) of items that stand in normalised texts as whole words."""
        out = []
        blank = np.concatenate([[True], d == 0x20, [True]])
        first = np.flatnonzero(blank[:-1] & ~blank[1:])
        last = np.flatnonzero(~blank[:-1] & blank[1:])
        doc, hashed = np.searchsorted(start, first, "right") - 1, SpanHash(d)
        for n in np.unique(self.n_words).tolist():
            at = np.arange(max(0, len(first) - n + 1))
            at = at[doc[at] == doc[at + n - 1]]
            own = np.flatnonzero(self.n_words == n)
            own = own[np.argsort(self.key[own], kind="stable")]
            keys = self.key[own]
            h = hashed(first[at], last[at + n - 1])
            row = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            # equal hashes of different items would only hide one of them; there are none among distinct texts but by chance
            hit = np.flatnonzero(keys[row] == h)
            at, row = at[hit], own[row[hit]]
            ok = same_bytes(hashed, first[at], last[at + n - 1], self.data, self.start[row], self.stop[row])
            out += list(zip(doc[at[ok]].tolist(), row[ok].tolist(), strict=True))
        return out


def banded_distance(x: np.ndarray, y: np.ndarray, k: int) -> int:
    """Least edits of all of ``x`` against some substring of ``y`` that starts within its first 2 k + 1 signs; over k: k + 1."""
    wide = 4 * k + 1
    far = k + 1
    # diagonals -k to 3 k: alignments of at most k edits that start on 0 to 2 k never leave them
    row = [far] * k + [0] * (2 * k + 1) + [far] * k
    m = len(y)
    xs, ys = x.tolist(), y.tolist()
    for s in range(k, min(3 * k + 1, wide)):
        if s - k > m:
            row[s] = far
    for i, c in enumerate(xs):
        new = [far] * wide
        for j in range(wide):
            # the next sign of y on this diagonal
            p = i + j - k
            best = row[j] + (ys[p] != c) if 0 <= p < m else far
            if j + 1 < wide and row[j + 1] + 1 < best:
                best = row[j + 1] + 1
            if j and 0 <= p < m and new[j - 1] + 1 < best:
                best = new[j - 1] + 1
            new[j] = min(best, far)
        row = new
        if min(row) >= far:
            return far
    return min(row)


class _Hits:
    """Positions of a slice's texts whose gram the benchmark has, and where it has it."""

    def __init__(self, d: np.ndarray, start: np.ndarray, items: Items):
        self.d, self.start, self.items = d, start, items
        g = grams(d)
        at = np.flatnonzero(items.bitmap[_slot(g)]) if len(items.keys) else np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(items.keys, g[at]), max(len(items.keys) - 1, 0))
        good = items.keys[k] == g[at]
        self.at, self.k = at[good], k[good]
        self.reach = int((items.window + 2 * items.edits).max(initial=0))
        # a stretch needs as many hits, over all items, as the smallest bound
        least = int(items.least.min()) if len(items.least) else 1
        near = np.zeros(len(self.at), bool)
        if len(self.at) >= least:
            ok = np.flatnonzero(self.at[least - 1 :] - self.at[: len(self.at) - least + 1] < self.reach)
            edge = np.zeros(len(self.at) + 1, np.int64)
            np.add.at(edge, ok, 1)
            np.add.at(edge, ok + least, -1)
            near = np.cumsum(edge[:-1]) > 0
        self.at, self.k = self.at[near], self.k[near]
        # occurrences in order of gram, then of where they stand in all items laid end to end
        self.total = int(items.begin[-1])
        occurs = items.begin[items.item] + items.offset if len(items.item) else np.zeros(0, np.int64)
        self.occurs = np.repeat(np.arange(len(items.keys)), items.count) * self.total + occurs

    def counted(self, a: int, z: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """For hits a to z: the first of their occurrences between positions lo and hi, and how many."""
        k = self.k[a:z]
        if lo == 0 and hi == self.total:
            return self.items.first[k], self.items.count[k]
        first = np.searchsorted(self.occurs, k * self.total + lo)
        return first, np.searchsorted(self.occurs, k * self.total + hi) - first

    def rectangles(self, done: set[tuple[int, int]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """First hit, first occurrences and their numbers, for rectangles that together hold every alignment whole."""
        todo = [(0, len(self.at), 0, self.total)]
        least = 4 * self.reach
        while todo:
            a, z, lo, hi = todo.pop()
            if a >= z:
                continue
            p, q = int(self.at[a]), int(self.at[z - 1])
            doc = int(np.searchsorted(self.start, p, "right")) - 1
            item = int(np.searchsorted(self.items.begin, lo, "right")) - 1
            # the hits of one text in one item that were already found together
            if (doc, item) in done and hi <= self.items.begin[item + 1] and (doc + 1 == len(self.start) or q < self.start[doc + 1]):
                continue
            first, count = self.counted(a, z, lo, hi)
            n = int(count.sum())
            if n <= HITS or (q - p <= least and hi - lo <= least):
                if n:
                    yield a, first, count
            elif q - p > least and (q - p >= hi - lo or hi - lo <= least):
                mid = (p + q) // 2
                todo += [(int(np.searchsorted(self.at, mid - self.reach)), z, lo, hi), (a, int(np.searchsorted(self.at, mid + self.reach)), lo, hi)]
            else:
                mid = (lo + hi) // 2
                todo += [(a, z, mid - self.reach, hi), (a, z, lo, mid + self.reach)]


def matches(b: TextBatch, items: Items) -> list[tuple[int, int, int, int]]:
    """(text, item row, first sign of the item window, edits) of verified regions, at least one per contaminating item."""
    d, start = normalised(b)
    out: list[tuple[int, int, int, int]] = []
    done: set[tuple[int, int]] = set()
    if len(d) >= Q and len(items.keys):
        hits = _Hits(d, start, items)
        for a, first, count in hits.rectangles(done):
            _verify(hits, a, first, count, out, done)
    return out


def _verify(hits: _Hits, a: int, first: np.ndarray, count: np.ndarray, out: list, done: set[tuple[int, int]]) -> None:
    """Deals the hits of a rectangle to bands and aligns the regions that meet the bound."""
    items, d, start = hits.items, hits.d, hits.start
    row = spread(first, count)
    pos = np.repeat(hits.at[a : a + len(count)], count)
    item, doc = items.item[row], np.searchsorted(start, pos, "right") - 1
    if done:
        known = np.array([t * len(items.ids) + i for t, i in done])
        new = ~np.isin(doc * len(items.ids) + item, known)
        row, pos, item, doc = row[new], pos[new], item[new], doc[new]
    diagonal = pos - items.offset[row] + _ORIGIN
    width = 2 * np.maximum(items.edits[item], 1)
    found = []
    for shift in (0, 1):
        band = (diagonal + shift * (width // 2)) // width
        order = np.lexsort((pos, band, item, doc))
        o_doc, o_item, o_band, o_pos, o_diag = doc[order], item[order], band[order], pos[order], diagonal[order]
        need = items.least[o_item]
        head = np.arange(len(order))
        tail = np.minimum(head + need - 1, len(order) - 1)
        full = (head + need - 1 < len(order)) & (o_doc[tail] == o_doc) & (o_item[tail] == o_item) & (o_band[tail] == o_band)
        full &= o_pos[tail] - o_pos <= items.window[o_item] - Q + items.edits[o_item]
        found.append(np.stack([o_doc, o_item, o_pos, o_diag], 1)[full])
    regions = np.concatenate(found)
    regions = regions[np.lexsort((regions[:, 2], regions[:, 1], regions[:, 0]))]
    cuts = np.flatnonzero((regions[1:, :2] != regions[:-1, :2]).any(1)) + 1
    for own in np.split(regions, cuts) if len(regions) else []:
        t, i = own[0, :2].tolist()
        if (hit := _aligned(hits, t, i, own[:, 2:])) is not None:
            out.append((t, i, *hit))
            done.add((t, i))


def _aligned(hits: _Hits, t: int, i: int, regions: np.ndarray) -> tuple[int, int] | None:
    """First sign of an item window that stands in a text, and its edits, from (position, diagonal) of regions' first hits."""
    items, d, start = hits.items, hits.d, hits.start
    text, w, e = items.texts[i], int(items.window[i]), int(items.edits[i])
    lo = int(start[t])
    hi = int(start[t + 1] - 1) if t + 1 < len(start) else len(d) - 1
    tried = set()
    for k in range(len(regions)):
        p, dg = regions[k].tolist()
        item_at = p - (dg - _ORIGIN)  # where in the item the hit's gram starts
        # windows of the item that may hold the hit as one of their first grams; the alignment starts no further than e from the hit's diagonal
        for a in sorted({max(0, min(item_at - s, len(text) - w)) for s in range(Q * e + 1)}, reverse=True):
            if (a, dg) in tried:
                continue
            tried.add((a, dg))
            y0 = p - (item_at - a) - e
            y = d[max(lo, y0) : max(lo, min(hi, y0 + w + 6 * e + 1))]
            pad = max(0, lo - y0)
            y = np.concatenate([np.zeros(pad, np.uint8), y]) if pad else y
            edits = banded_distance(text[a : a + w], y, e) if e else (0 if len(y) >= w and (y[:w] == text[a : a + w]).all() else 1)
            if edits <= e:
                return a, edits
    return None


def items_found(b: TextBatch, items: Items) -> list[set]:
    """Ids of the items found in each text."""
    found: list[set] = [set() for _ in range(b.n)]
    for t, i, _, _ in matches(b, items):
        found[t].add(items.ids[i])
    if items.short.ids:
        for t, i in items.short.found(*normalised(b)):
            found[t].update(items.short.ids[i])
    return found


def _parts(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    """The benchmark part by part; a part has at most MOST_BYTES characters of text, or one item."""
    rows = benchmark.where(col(text_col).isNotNull()).select(col(id_col).cast("long").alias("i"), col(text_col).alias("t")).orderBy("i", "t")
    ids, texts, size = [], [], 0
    for i, t in rows.toLocalIterator():
        if ids and size + len(t) > MOST_BYTES:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(i)
        texts.append(t)
        size += len(t)
    yield Items(ids, texts)


def contamination(df: DataFrame, benchmark: DataFrame, text_col: str = "text", name: str = "leak", *, item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` with a struct column: contaminated, and the ids of the items found in each text (sorted; null ids last)."""
    spark = df.sparkSession

    def one_pass(rows: DataFrame, text: str, part: Items, to: str, keep: list[str]) -> tuple[DataFrame, object]:
        shared = spark.sparkContext.broadcast(part)

        def compute(texts: pa.Array) -> list:
            def each(t: pa.Array) -> list:
                found = items_found(folded(t), shared.value)
                return [pa.array([bool(f) for f in found], pa.bool_()), pa.array([sorted(f, key=lambda v: (v is None, v)) for f in found], pa.list_(pa.int64()))]

            return in_slices(texts, each)

        return annotate(rows, text, to, "contaminated boolean, items array<bigint>", compute, keep), shared

    parts = _parts(benchmark.select(item_id, item_text), item_id, item_text)
    first, second = next(parts), next(parts, None)
    keep = [c for c in (df.columns if keep is None else keep) if c != name]
    if second is None:
        return one_pass(df, text_col, first, name, keep)[0]
    # columns are renamed by position, so that none clashes with those made here
    tables = Scratch(spark, "contamination")
    rows = df.select(*[col(c).alias(f"c{k}") for k, c in enumerate(keep)], col(text_col).cast("string").alias("text"), F.array().cast("array<bigint>").alias("items"))
    for part in chain([first, second], parts):
        made, shared = one_pass(rows, "text", part, "leak", rows.columns)
        made = made.withColumn("items", F.array_sort(F.array_union("items", "leak.items"))).drop("leak")
        rows = tables.write("rows", made)
        shared.destroy()
    leak = F.struct((F.size("items") > 0).alias("contaminated"), F.col("items").alias("items"))
    return rows.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(keep)], leak.alias(name))


def keep_uncontaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` without benchmark passages, with the columns of ``df`` alone."""
    name = "__leak"
    while name in df.columns:
        name += "_"
    return contamination(df, benchmark, text_col, name).where(~F.col(f"{name}.contaminated")).drop(name)


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    r = contamination(docs, benchmark, keep=["doc_id"])
    return r.select("doc_id", "leak.contaminated", F.coalesce("leak.items", F.array()).alias("items"))

"""Edit-aware token counts: a segment tree of pre-tokens for each document.

The leaves of a document's tree are runs of at most ``LEAF`` consecutive pre-tokens with their
bytes and their tokens; inner nodes hold sums. All edits of a document are applied in one pass:
the text is put together once, and from the leaf ``CONTEXT`` characters before an edit (the
pattern looks at most two characters past a pre-token's end) pre-tokens are found anew, through
all edits that lie before, up to the first old leaf boundary after an edit at which a new
pre-token ends as well; from there on the old pre-tokens hold. The leaves of such a region are
replaced by new ones of ``LEAF`` pre-tokens, whose tokens are counted anew, once each. Where a
region keeps its number of leaves only the sums on their paths to the root change; otherwise
inner sums are made anew from the leaves. Everything else keeps its counts.

Edits are arrays of (start, stop, text): code points of the unedited text, end exclusive.
Those out of range are clipped, null ones and those that overlap an edit which starts before
them (or comes first, on ties) are skipped. Null texts count as empty; whole texts are
counted. Token counts are those of byte-level BPE without special tokens.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vectaria.functions.kernels import on_workers
from vectaria.llm.bpe import GROUP_BYTES, Vocabulary, encode_group, encode_spans, vocabulary
from vectaria.llm.textbatch import TextBatch, annotate, col, in_slices, repeats_earlier, slices

LEAF = 16
CONTEXT = 12
_pattern = regex.compile(public_tokenizers.PATTERN)

TREE = "n_tokens bigint, leaf_bytes array<int>, leaf_tokens array<int>"


def _trees(texts: pa.Array, vocab: Vocabulary) -> list:
    out: list[list] = [[], [], []]
    for a, z in slices(texts, GROUP_BYTES):
        for _, _, b, start, bounds, count in encode_group(texts.slice(a, z - a), vocab):
            per = np.diff(bounds)
            n_leaves = -(-per // LEAF)
            total = np.concatenate([[0], np.cumsum(count)])
            # first pre-token of each leaf
            within = np.arange(n_leaves.sum()) - np.repeat(np.cumsum(n_leaves) - n_leaves, n_leaves)
            first = np.repeat(bounds[:-1], n_leaves) + LEAF * within
            last = np.minimum(first + LEAF, np.repeat(bounds[1:], n_leaves))
            begin = start[first] if len(first) else first
            final = last == np.repeat(bounds[1:], n_leaves)
            stop = np.where(final, np.repeat(b.end, n_leaves), start[np.minimum(last, len(start) - 1)]) if len(first) else first
            offs = pa.array(np.concatenate([[0], np.cumsum(n_leaves)]).astype(np.int32))
            out[0].append(pa.array(total[bounds[1:]] - total[bounds[:-1]]))
            out[1].append(pa.ListArray.from_arrays(offs, pa.array((stop - begin).astype(np.int32))))
            out[2].append(pa.ListArray.from_arrays(offs, pa.array((total[last] - total[first]).astype(np.int32))))
    kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
    return [pa.concat_arrays(c) if c else pa.array([], k) for c, k in zip(out, kinds, strict=True)]


def token_trees(df: DataFrame, text_col: str = "text", name: str = "tree", *, ranks: str, keep: list[str] | None = None) -> DataFrame:
    """``df`` with a struct column: tokens of each text, and bytes and tokens of its tree's leaves."""

    def compute(texts: pa.Array) -> list:
        return _trees(texts, vocabulary(ranks))

    return annotate(df, text_col, name, TREE, compute, keep)


class TokenTree:
    """Sums of bytes and tokens over leaves, in heap order."""

    def __init__(self, leaf_bytes: list[int], leaf_tokens: list[int]):
        self.encoded = 0
        self.regions: list[tuple[int, int, list[bytes]]] = []
        self._sum_up([list(leaf_bytes), list(leaf_tokens)])

    def _sum_up(self, leaves: list[list[int]]) -> None:
        self.n = len(leaves[0])
        self.base = 1 << (max(1, self.n) - 1).bit_length()
        self.sums = []
        for own in leaves:
            level = np.zeros(self.base, np.int64)
            level[: self.n] = own
            levels = [level]
            while len(level) > 1:
                level = level[::2] + level[1::2]
                levels.append(level)
            self.sums.append([0, *np.concatenate(levels[::-1]).tolist()])

    @property
    def n_bytes(self) -> int:
        return self.sums[0][1]

    @property
    def n_tokens(self) -> int:
        return self.sums[1][1]

    def leaves(self, which: int) -> list[int]:
        return self.sums[which][self.base : self.base + self.n]

    def put(self, which: int, leaf: int, value: int) -> None:
        s, k = self.sums[which], leaf + self.base
        more = value - s[k]
        while k and more:
            s[k] += more
            k >>= 1

    def edit(self, data: bytes, edits: list[tuple[int, int, bytes]]) -> bytes:
        """Applies edits (sorted, disjoint byte ranges) to the text ``data``; returns the new text.

        Sets ``regions``: first and last (exclusive) old leaf, and the pre-tokens that replace them.
        """
        self.regions = []
        if not edits:
            return data
        text, ends = data.decode(), np.concatenate([[0], np.cumsum(np.array(self.leaves(0), np.int64))])
        todo = [(a, z, new.decode()) for a, z, new in edits]
        if len(text) != len(data):
            lead = np.append(np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80), len(data))
            ends = np.searchsorted(lead, ends)
            todo = [(int(np.searchsorted(lead, a)), int(np.searchsorted(lead, z)), new) for a, z, new in todo]
        pieces, at = [], 0
        for a, z, new in todo:
            pieces += [text[at:a], new]
            at = z
        edited = "".join([*pieces, text[at:]])
        # the leaf from which pre-tokens may change with each edit, and where it begins
        leaf = np.clip(np.searchsorted(ends, [a - CONTEXT for a, _, _ in todo], "right") - 1, 0, max(self.n - 1, 0)).tolist()
        ends = ends.tolist()
        begin = [ends[k] for k in leaf]
        boundary = {e: k for k, e in enumerate(ends)}
        k = shift = 0
        while k < len(todo):
            first, start = leaf[k], begin[k] + shift
            a, z, new = todo[k]
            shift += len(new) - (z - a)
            past, k, last = z + shift, k + 1, self.n
            tokens = []
            for m in _pattern.finditer(edited, start):
                tokens.append(m[0].encode())
                end = m.end()
                # edits whose first leaf begins before here belong to this region
                while end >= past and k < len(todo) and begin[k] < end - shift:
                    a, z, new = todo[k]
                    shift += len(new) - (z - a)
                    past, k = z + shift, k + 1
                if end >= past and (at := boundary.get(end - shift)) is not None:
                    last = at
                    break
            else:
                # the new text ends here; what edits are left only removed text
                k = len(todo)
            self.regions.append((first, last, tokens))
        return edited.encode()

    def renew(self, count: dict[bytes, int]) -> None:
        """Puts the regions' new leaves in place, with the tokens that ``count`` has for each pre-token."""
        made = []
        for first, last, tokens in self.regions:
            runs = [tokens[k : k + LEAF] for k in range(0, len(tokens), LEAF)]
            made.append((first, last, [sum(map(len, r)) for r in runs], [sum(map(count.__getitem__, r)) for r in runs]))
            self.encoded += sum(map(len, tokens))
        self.regions = []
        if all(last - first == len(size) for first, last, size, _ in made):
            for first, _, *new in made:
                for which in (0, 1):
                    for k, value in enumerate(new[which]):
                        self.put(which, first + k, value)
            return
        leaves = []
        for which in (0, 1):
            old, at, parts = self.leaves(which), 0, []
            for first, last, *new in made:
                parts += old[at:first]
                parts += new[which]
                at = last
            leaves.append(parts + old[at:])
        self._sum_up(leaves)


def apply_edits(rows: list[tuple[TokenTree, bytes, list[tuple[int, int, bytes]]]], vocab: Vocabulary) -> list[bytes]:
    """Edits (byte ranges of the unedited text, sorted, disjoint) of several documents; counts renewed in one go."""
    out = [tree.edit(data, edits) for tree, data, edits in rows]
    distinct = list({t: None for tree, _, _ in rows for _, _, tokens in tree.regions for t in tokens})
    _, count = encode_spans(np.frombuffer(b"".join(distinct), np.uint8), np.array([len(t) for t in distinct], np.int64), vocab)
    counted = dict(zip(distinct, count.tolist(), strict=True))
    for tree, _, _ in rows:
        tree.renew(counted)
    return out


def _disjoint(edits: list[dict | None] | None, text: str) -> list[tuple[int, int, bytes]]:
    """Edits in order, clipped, without overlaps, as byte ranges."""
    n, at, kept = len(text), 0, []
    for e in sorted((e for e in edits or [] if e and e["start"] is not None and e["stop"] is not None), key=lambda e: e["start"]):
        a, z = max(0, min(e["start"], n)), max(0, min(e["stop"], n))
        if a >= at and z >= a:
            kept.append((a, z, (e["text"] or "").encode()))
            at = z
    if len(text) == len(data := text.encode()):
        return kept
    where = np.append(np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80), len(data))
    return [(int(where[a]), int(where[z]), t) for a, z, t in kept]


def recount(
    df: DataFrame, text_col: str = "text", edits: str | Callable[[pa.Array], pa.Array] = "edits", tree_col: str | None = None, name: str = "edited", *, ranks: str, keep: list[str] | None = None
) -> DataFrame:
    """``df`` with a struct column: tokens before and after the edits, number of edits applied, bytes encoded again, and the new leaves.

    ``edits`` is a column, or a function that makes an array of edits of an array of texts.
    Trees are those of ``tree_col``, or are made in the same pass without it.
    """
    on_workers(df.sparkSession)
    keep = [c for c in (df.columns if keep is None else keep) if c != name]
    more = [col(c).alias(a) for c, a in ((edits if isinstance(edits, str) else None, "edits"), (tree_col, "tree")) if c]
    # columns are named by position here, so that none clashes
    source = df.select(*[col(c).alias(f"c{k}") for k, c in enumerate(keep)], col(text_col).cast("string").alias("text"), *more)
    ddl = "n_before bigint, n_tokens bigint, n_edits bigint, encoded_bytes bigint, leaf_bytes array<int>, leaf_tokens array<int>"
    schema = T.StructType([*[T.StructField(c, f.dataType) for c, f in zip(keep, source.schema.fields, strict=False)], T.StructField(name, T.StructType.fromDDL(ddl))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(ranks)
        for batch in batches:
            for a, z in slices(batch.column(len(keep)), GROUP_BYTES):
                part = batch.slice(a, z - a)
                text = pc.fill_null(part.column(len(keep)), "")
                todo = part.column(len(keep) + 1) if isinstance(edits, str) else edits(text)
                tree = [part.column(part.num_columns - 1).field(c) for c in ("n_tokens", "leaf_bytes", "leaf_tokens")] if tree_col else _trees(text, vocab)
                made = _edited(text, tree, todo, vocab)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.StructArray.from_arrays(made, names=["n_before", "n_tokens", "n_edits", "encoded_bytes", "leaf_bytes", "leaf_tokens"])], names=[*keep, name])

    return source.mapInArrow(run, schema)


def _edited(text: pa.Array, tree: list[pa.Array], edits: pa.Array, vocab: Vocabulary) -> list[pa.Array]:
    before = pc.fill_null(tree[0], 0)
    has = np.flatnonzero(np.asarray(pc.fill_null(pc.list_value_length(edits), 0)) > 0)
    if not len(has):
        zero = pa.array(np.zeros(len(text), np.int64))
        return [before, before, zero, zero, *tree[1:]]
    rows = []
    for k in has.tolist():
        plain = text[k].as_py()
        rows.append((TokenTree(tree[1][k].as_py() or [], tree[2][k].as_py() or []), plain.encode(), _disjoint(edits[k].as_py(), plain)))
    apply_edits(rows, vocab)
    after, n_edits, encoded = np.array(before), np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
    leaves = []
    for c in (0, 1):
        # unedited trees stay as they are; only edited ones are replaced
        new = pa.array([own.leaves(c) for own, _, _ in rows], pa.list_(pa.int32()))
        take = np.arange(len(text))
        take[has] = len(text) + np.arange(len(has))
        leaves.append(pa.concat_arrays([tree[1 + c].cast(pa.list_(pa.int32())), new]).take(pa.array(take)))
    for k, (own, _, todo) in zip(has.tolist(), rows, strict=True):
        after[k], n_edits[k], encoded[k] = own.n_tokens, len(todo), own.encoded
    return [before, pa.array(after), pa.array(n_edits), pa.array(encoded), *leaves]


_NUMBER = re.compile(r"[0-9]{2,}")


def cleaning_edits(texts: pa.Array) -> list:
    """Edits that remove lines equal to an earlier line of their text and write numbers as 0."""
    b = TextBatch(texts)
    breaks = np.flatnonzero(b.data == 10)
    begun, ended = breaks[:-1] + 1, breaks[1:]
    filled = ended > begun
    begun, ended = begun[filled], ended[filled]
    doc = np.searchsorted(b.beg, begun, "right") - 1
    again, _ = repeats_earlier(doc, b.hasher()(begun, ended))
    dups = np.bincount(doc[again], minlength=b.n) > 0
    digits = b.per_text((b.data >= 48) & (b.data <= 57)) > 1
    out: list[list[dict]] = [[] for _ in range(b.n)]
    for k in np.flatnonzero(dups | digits).tolist():
        text = texts[k].as_py() or ""
        gone, seen, at = [], set(), 0
        for line in text.split("\n"):
            if line and line in seen:
                gone.append({"start": at, "stop": min(at + len(line) + 1, len(text)), "text": ""})
            seen.add(line)
            at += len(line) + 1
        spans = iter([*gone, {"start": len(text) + 1, "stop": len(text) + 1}])
        now = next(spans)
        for m in _NUMBER.finditer(text):
            while now["stop"] <= m.start():
                now = next(spans)
            if m.end() <= now["start"]:
                out[k].append({"start": m.start(), "stop": m.end(), "text": "0"})
        out[k] = sorted(out[k] + gone, key=lambda e: e["start"])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("text", pa.string())]))
    return [pa.array(out, kind)]


def op3(spark, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after the cleaning edits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    r = recount(docs, edits=lambda t: pa.concat_arrays([c for c in in_slices(t, cleaning_edits)]), ranks=ranks, keep=["doc_id"])
    return r.selectExpr("doc_id", "edited.n_before AS n_tokens", "edited.n_edits AS n_edits", "edited.n_tokens AS n_tokens_edited", "edited.encoded_bytes AS encoded_bytes")

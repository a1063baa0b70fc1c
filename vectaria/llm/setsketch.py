"""Near-duplicates by SetSketch registers, banding, joint likelihood and verification.

A text's set holds the hashes of its distinct word shingles, A-Z lower-cased; a text with
fewer words than a shingle has its whole sequence as the one element, and without words the set
is empty and links with nothing. A SetSketch keeps, for each of ``REGISTERS`` registers, the
truncated logarithm of the least of exponentially spaced values that the elements throw at it:
each element is a Poisson process whose points go to random registers, so only points below a
bound that falls with the set's size are ever made. Registers merge by maximum, and two sets
agree in a register with a probability near their Jaccard similarity.

Steps, all of them joins and aggregations over tables in the shared folder, each dropped once
its successors are written:

1. Sets and sketches; equal sets become one class (its smallest id stands for it).
2. Bands of ``ROWS`` registers; classes that share a band's values share a bucket. Each member
   is paired with its bucket's pivot, the member whose id has the least hash, so a bucket of any
   size gives as many pairs as members, and buckets of the same group have the same pivot.
3. Pairs are dropped if the joint likelihood of their registers rules out the threshold (log
   likelihood ratio over ``RULED_OUT``); the rest are confirmed on the full sets, which are made
   anew for members of shared buckets alone.
4. Components of confirmed links. In buckets that still span several components, members
   outside the bucket's largest component are compared with all others, in blocks of
   ``BLOCK`` by ``BLOCK``: a bit of each register, the likelihood of their sketches and then an
   upper bound of their intersection, from how their elements fall into cells, rule pairs out;
   the few that are left are confirmed as before and join components. So no link between bucket
   members goes lost, and nothing grows with the square of a group of copies that are already
   linked.

A pair at the threshold of 0.8 shares no bucket with probability below 1e-6; links are never
made without confirmation. Rows with a null id are left out; rows that repeat an id are the
same document, whose set is that of its row with the smallest hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vectaria.functions.state import Scratch, settings
from vectaria.llm.textbatch import U64, TextBatch, annotate, col, in_slices, mix

SHINGLE = 2
#: Links have PERCENT * union <= 100 * intersection.
PERCENT = 80
BANDS, ROWS = 36, 5
REGISTERS = BANDS * ROWS
#: Base of the registers' scale and their number of values.
BASE, LEVELS = 1.001, 65534
#: Scale of the least values: registers of sets from one to about 1e12 elements fit.
RATE = 20.0
RULED_OUT = 12.0
BLOCK = 512
#: Pairs of sketches compared in one step.
COMPARED = 8_192
#: Bytes of cells compared in one step.
CELLS_COMPARED = 1 << 20
#: Ids that are sent to all tasks at most (about 56 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Rows with full sets in one Arrow batch.
SET_ROWS = "256"


# ---- sets and sketches


def shingle_sets(b: TextBatch, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of every distinct shingle, in order of text, then of hash."""
    hashed = b.hasher(lower=True)
    start, stop = b.words
    word, bounds, doc = hashed(start, stop), b.word_bounds, b.word_doc
    n = np.diff(bounds)
    # windows of `shingle` words, or of all words of a shorter text
    size = np.minimum(n, shingle)[doc] if len(doc) else np.zeros(0, np.int64)
    first = np.flatnonzero(np.arange(len(word)) + size <= bounds[1:][doc]) if len(doc) else np.zeros(0, np.int64)
    short = n[doc[first]] < shingle if len(first) else np.zeros(0, bool)
    keep = ~short | (first == bounds[:-1][doc[first]])
    first = first[keep]
    h = mix(size[first].astype(U64))
    for k in range(shingle):
        more = size[first] > k
        h[more] = mix(h[more] * U64(0x9E3779B97F4A7C15) + word[first[more] + k])
    own = doc[first]
    order = np.lexsort((h, own))
    own, h = own[order], h[order]
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, bool)
    return own[new], h[new]


def sketches(own: np.ndarray, h: np.ndarray, n_sets: int, registers: int) -> np.ndarray:
    """SetSketch registers (uint16) of sets given as (set, element hash) rows; 0 for empty sets."""
    count = np.bincount(own, minlength=n_sets)
    least = np.full(n_sets * registers, np.inf)
    todo = count > 0
    bound = np.full(n_sets, (np.log(registers) + 3.0)) / np.maximum(count, 1)
    # each element's process goes on from where the last bound stopped it
    elements = np.arange(len(h))
    step = np.zeros(len(h), U64)
    value = _gap(h, step, registers)
    while todo.any():
        live = elements[todo[own]]
        at_live = value[live]
        while True:
            inside = at_live < bound[own[live]]
            live, at_live = live[inside], at_live[inside]
            if not len(live):
                break
            r = mix(h[live] ^ mix(step[live] * U64(2) + U64(1)))
            register = ((r >> U64(32)) * U64(registers)) >> U64(32)
            np.minimum.at(least, own[live] * registers + register.astype(np.int64), at_live)
            step[live] += U64(1)
            at_live = at_live + _gap(h[live], step[live], registers)
            value[live] = at_live
        empty = np.isinf(least.reshape(n_sets, registers)).any(1)
        todo &= empty
        bound[todo] *= 2
    least = least.reshape(n_sets, registers)
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(least / RATE) / np.log(BASE))
    return np.where(count[:, None] > 0, np.clip(k, 0, LEVELS), 0).astype(np.uint16)


def _gap(h: np.ndarray, step: np.ndarray, registers: int) -> np.ndarray:
    """Exponential distance to an element's next point."""
    r = mix(h + mix(step * U64(2)) + U64(0x2545F4914F6CDD1D))
    return -np.log(((r >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53) / registers


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union of two sets."""
    return np.maximum(a, b)


def band_buckets(sketch: str) -> Column:
    """For each band, a hash of its number and register values."""
    width = 2 * ROWS
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring(F.col(sketch), k * width + 1, F.lit(width))))


def log_likelihood_ratio(more: np.ndarray, less: np.ndarray, same: np.ndarray, nu: np.ndarray, nv: np.ndarray, target: float) -> np.ndarray:
    """How much better the likeliest similarity explains the registers than the target, if it is below the target; else 0.

    ``more``, ``less`` and ``same`` count the registers that are larger in u, larger in v, equal.
    With sizes nu and nv known, a register is larger in u with the probability p(u - v J), in v
    with p(v - u J), where p(x) = -log_b(1 - x (b - 1) / b) of the relative sizes. A pair whose
    sizes alone exclude the target gets infinity.
    """
    u = nu / np.maximum(nu + nv, 1)
    v = 1 - u
    most = np.minimum(u / np.maximum(v, 1e-12), v / np.maximum(u, 1e-12))
    p = lambda x: -np.log1p(-np.clip(x, 1e-9, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def log_of(j: np.ndarray) -> np.ndarray:
        a, b = np.minimum(p(u - v * j), 1 - 2e-9), np.minimum(p(v - u * j), 1 - 2e-9)
        return more * np.log(np.maximum(a, 1e-9)) + less * np.log(np.maximum(b, 1e-9)) + same * np.log(np.maximum(1 - a - b, 1e-9))

    # the likeliest J by Newton steps on the log-likelihood, in which p(x) is x but for terms of b - 1
    top = np.minimum(most, target)
    j = np.clip(same / np.maximum(more + less + same, 1), 1e-6, np.maximum(top - 1e-6, 1e-6))
    for _ in range(4):
        a, b = np.maximum(u - v * j, 1e-9), np.maximum(v - u * j, 1e-9)
        slope = same / j - more * v / a - less * u / b
        bend = -same / j**2 - more * (v / a) ** 2 - less * (u / b) ** 2
        j = np.clip(j - slope / np.minimum(bend, -1e-9), 1e-6, np.maximum(top - 1e-6, 1e-6))
    return np.where(most < target - 1e-12, np.inf, np.maximum(log_of(j) - log_of(np.minimum(target, most)), 0))


def compared(ku: np.ndarray, kv: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Registers of paired sketches that are larger in u, larger in v, equal."""
    more, less = (ku > kv).sum(1), (ku < kv).sum(1)
    return more, less, ku.shape[1] - more - less


def cells_of(h: np.ndarray) -> bytes:
    """Numbers of a set's elements by cell, two cells a byte, for at least twice as many cells as elements; 15 stands for 15 or more."""
    size = max(16, 1 << int(2 * len(h) - 1).bit_length()) if len(h) else 16
    count = np.minimum(np.bincount((mix(h) & U64(size - 1)).astype(np.int64), minlength=size), 15).astype(np.uint8)
    return (count[: size // 2] << 4 | count[size // 2 :]).tobytes()


def unpacked(cells: list[bytes], size: int) -> np.ndarray:
    """Cell numbers of several sets, larger ones folded to ``size`` cells."""
    out = np.empty((len(cells), size), np.uint8)
    for k, c in enumerate(cells):
        both = np.frombuffer(c, np.uint8)
        row = np.concatenate([both >> 4, both & 15])
        row = np.where(row == 15, 255, row) if (row == 15).any() else row
        while len(row) > size:
            a, b = row[: len(row) // 2].astype(np.int64), row[len(row) // 2 :]
            row = np.minimum(a + b, 255).astype(np.uint8)
        out[k] = row
    return out


def at_most_shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Upper bounds of the intersections of paired sets, from their cells."""
    return np.minimum(x, y).sum(1, dtype=np.int64)


FIELDS = "n bigint, fp_a bigint, fp_b bigint, sketch binary, cells binary, elements binary"


def sets(df: DataFrame, id_col: str, text_col: str, *, shingle: int, sketch: bool = True, elements: bool = False) -> DataFrame:
    """id, size and fingerprint of each text's set, with its sketch, or its cells and elements."""

    def part(texts: pa.Array) -> list:
        b = TextBatch(texts)
        own, h = shingle_sets(b, shingle)
        n = np.bincount(own, minlength=b.n)
        cut = np.concatenate([[0], np.cumsum(n)])
        total = lambda x: np.diff(np.concatenate([np.zeros(1, U64), np.cumsum(x, dtype=U64)])[cut])
        each = lambda f: pa.array([f(h[i:j]) for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.binary())
        out = [pa.array(n), pa.array(total(mix(h)).view(np.int64)), pa.array(total(mix(h ^ U64(0x5851F42D4C957F2D))).view(np.int64))]
        out.append(pa.array([r.tobytes() for r in sketches(own, h, b.n, REGISTERS)], pa.binary()) if sketch else pa.nulls(b.n, pa.binary()))
        return [*out, *([each(cells_of), each(np.ndarray.tobytes)] if elements else [pa.nulls(b.n, pa.binary())] * 2)]

    source = df.where(col(id_col).isNotNull()).select(col(id_col).alias("id"), col(text_col).alias("text"))
    fields = ["n", "fp_a", "fp_b", *(["sketch"] if sketch else []), *(["cells", "elements"] if elements else [])]
    return annotate(source, "text", "s", FIELDS, lambda t: in_slices(t, part), ["id"]).select("id", *[F.col(f"s.{f}") for f in fields])


# ---- links


def _binary(column: pa.Array, kind: type) -> np.ndarray:
    """Rows of binary values of one length, as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _likely(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that the joint likelihood of their sketches (ka, kb) and sizes (na, nb) doesn't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = (np.asarray(batch.column(c)).astype(float) for c in (4, 5))
            keep = log_likelihood_ratio(*compared(*(_binary(batch.column(c), np.uint16) for c in (2, 3))), na, nb, percent / 100) <= RULED_OUT
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])

    return pairs.select("a", "b", "ka", "kb", "na", "nb").mapInArrow(run, "a bigint, b bigint")


def _confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets are similar enough; ``full`` has the elements of each id."""
    a, b = (full.select(F.col("id").alias(x), F.col("elements").alias(f"e{x}")) for x in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64)
                # both are sorted and distinct
                at = np.minimum(np.searchsorted(x, y), max(len(x) - 1, 0))
                both = int((x[at] == y).sum()) if len(x) and len(y) else 0
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return pairs.join(a, "a").join(b, "b").select("a", "b", "ea", "eb").mapInArrow(run, "a bigint, b bigint")


def _one_row_each(rows: DataFrame) -> DataFrame:
    """One row for each id: the one with the smallest fingerprint."""
    rest = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.min_by(F.struct(*rest), F.struct("fp_a", "fp_b", "n")).alias("r")).select("id", *[F.col(f"r.{c}") for c in rest])


def among(rows: DataFrame, ids: DataFrame, n: int, how: str = "left_semi") -> DataFrame:
    """``rows`` whose id is (or isn't) one of ``n`` ids; few ids go to all tasks, so rows aren't shuffled."""
    return rows.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "id", how)


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) of all ids of ``nodes``: the smallest id reachable over ``links`` (a, b)."""
    return nodes.join(_stars(links, Scratch(nodes.sparkSession, "components"), "stars"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _stars(links: DataFrame, tables: Scratch, name: str) -> DataFrame:
    """(id, component) of all ids of ``links`` but each component's smallest: the smallest id reachable.

    Alternates large-star and small-star steps, each written as a table, until they no longer
    change it.
    """
    edges = tables.write(name, links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    mark = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("u", F.col("m").alias("v")).union(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        seen = Observation()
        edges = tables.write(name, small.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")))
        now = (seen.get["n"], seen.get["h"])
        if mark == now:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        mark = now


def _least_equal(registers: int, percent: int) -> int:
    """Equal registers below which likelihood rules the threshold out twice over."""
    t = percent / 100
    p = np.arange(1, registers) / registers
    far = registers * (p * np.log(p / t) + (1 - p) * np.log((1 - p) / (1 - t))) > 2 * RULED_OUT
    return int(np.flatnonzero(far & (p < t)).max(initial=-1)) + 2


def _bits(k: np.ndarray) -> np.ndarray:
    """A bit of each register's hash, packed in 64-bit words."""
    bit = (k.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(31)
    packed = np.packbits(bit.astype(np.uint8), axis=1)
    out = np.zeros((len(k), -(-packed.shape[1] // 8) * 8), np.uint8)
    out[:, : packed.shape[1]] = packed
    return out.view(U64)


def _block_pairs(x: slice, y: slice, t: dict[str, np.ndarray], percent: int, least: int, most_unlike: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pairs of a block's left and right rows that no bound rules out."""
    band = int(t["band"][x.start])
    kx, ky, bx, by = t["sketch"][x], t["sketch"][y], t["bits"][x], t["bits"][y]
    ix, iy, cx, cy, nx, ny, main = t["id"][x], t["id"][y], t["component"][x], t["component"][y], t["n"][x], t["n"][y], t["main"][y]
    found = []
    for k in range(0, len(ix), step := max(1, COMPARED // len(iy))):
        own = slice(k, k + step)
        # of two members outside the main component, the smaller id takes the pair up
        go = (cy[None] != cx[own, None]) & ((cy == main)[None] | (iy[None] > ix[own, None]))
        go &= 100 * np.minimum(ny[None], nx[own, None]) >= percent * np.maximum(ny[None], nx[own, None])
        if not go.any():
            continue
        row, at = np.nonzero(go)
        row += k
        ok = np.bitwise_count(bx[row] ^ by[at]).sum(1, dtype=np.uint16) <= most_unlike
        row, at = row[ok], at[ok]
        equal = kx[row] == ky[at]
        # a pair is taken up in the first band that it shares
        ok = (equal.sum(1) >= least) & ~equal[:, : band * ROWS].reshape(len(row), band, ROWS).all(2).any(1)
        row, at = row[ok], at[ok]
        if len(row):
            ok = log_likelihood_ratio(*compared(kx[row], ky[at]), nx[row].astype(float), ny[at].astype(float), percent / 100) <= RULED_OUT
            found.append((row[ok], at[ok]))
    row, at = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    if len(row):
        # the pairs of each smaller number of cells together
        sx, sy = (np.array([2 * len(c) for c in t["cells"][s]]) for s in (x, y))
        size, keep = np.minimum(sx[row], sy[at]), np.zeros(len(row), bool)
        for c in np.unique(size).tolist():
            own = np.flatnonzero(size == c)
            rx, vx = np.unique(row[own], return_inverse=True)
            ry, vy = np.unique(at[own], return_inverse=True)
            ux, uy = unpacked([t["cells"][x.start + k] for k in rx], c), unpacked([t["cells"][y.start + k] for k in ry], c)
            for k in range(0, len(own), step := max(1, CELLS_COMPARED // c)):
                part = own[k : k + step]
                both = at_most_shared(ux[vx[k : k + step]], uy[vy[k : k + step]])
                keep[part] = (100 + percent) * both >= percent * (nx[row[part]] + ny[at[part]])
        row, at = row[keep], at[keep]
    return ix[row], iy[at]


def _rest_pairs(members: DataFrame, slim: Callable[[DataFrame], DataFrame], percent: int, tables: Scratch) -> DataFrame:
    """Pairs across components within buckets, of (bucket, band, id, component) rows, that no bound rules out.

    Members outside their bucket's largest component meet all members, in blocks; a pair is
    taken up in the first band that it shares. ``slim`` gives n, sketch and cells of the ids of
    its argument, which join once the blocks are dealt.
    """
    sizes = members.groupBy("bucket", "component").count()
    wide = sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), F.sum("count").alias("total"), F.max(F.struct("count", "component")).alias("most"))
    wide = wide.where("parts > 1").select("bucket", F.col("most.component").alias("main"), (F.col("total") - F.col("most.count")).alias("outside"), "total")
    rows = tables.write("rows", members.join(wide, "bucket"))
    block = lambda n: F.ceil(F.col(n) / F.lit(float(BLOCK))).cast("int")
    spot = lambda seed, n: F.pmod(F.xxhash64("id", F.lit(seed)), block(n)).cast("int")
    left = rows.where("component != main").withColumn("i", spot(1, "outside")).withColumn("j", F.explode(F.sequence(F.lit(0), block("total") - 1)))
    right = rows.withColumn("j", spot(2, "total")).withColumn("i", F.explode(F.sequence(F.lit(0), block("outside") - 1)))
    key = ["bucket", "i", "j", "side"]
    dealt = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1))).select(*key, "id", "component", "main", "band")
    dealt = dealt.join(slim(rows), "id").select(*key, "id", "component", "main", "band", "n", "sketch", "cells")
    least = _least_equal(REGISTERS, percent)
    # a bit of an unequal register differs half the time; six deviations are allowed
    p = (1 - percent / 100) / 2
    most_unlike = int(REGISTERS * p + 6 * (REGISTERS * p * (1 - p)) ** 0.5) + 1

    def blocks(rows: pa.Table) -> pa.RecordBatch:
        at = [np.asarray(rows.column(c).combine_chunks()) for c in range(8)]
        t = dict(zip(("id", "component", "main", "band", "n"), [*at[4:], np.asarray(rows.column(8).combine_chunks())], strict=True))
        t |= {"sketch": _binary(rows.column(9).combine_chunks(), np.uint16), "cells": rows.column(10).to_pylist()}
        t["bits"] = _bits(t["sketch"])
        same = (at[0][1:] == at[0][:-1]) & (at[1][1:] == at[1][:-1]) & (at[2][1:] == at[2][:-1])
        cuts = [0, *(np.flatnonzero(~same) + 1).tolist(), len(at[0])]
        # left rows come first in a block
        turns = np.concatenate([[0], np.cumsum(at[3] == 0)])
        found = []
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            mid = a + int(turns[z] - turns[a])
            if a < mid < z:
                found.append(_block_pairs(slice(a, mid), slice(mid, z), t, percent, least, most_unlike))
        a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []  # rows of the last block so far
        for batch in batches:
            if not batch.num_rows:
                continue
            last = [batch.column(c)[batch.num_rows - 1].as_py() for c in range(3)]
            of_last = np.logical_and.reduce([np.asarray(batch.column(c)) == v for c, v in enumerate(last)])
            at = int(of_last.argmax())
            if at:
                yield blocks(pa.Table.from_batches([*kept, batch.slice(0, at)]))
                kept = []
            elif kept and any(kept[0].column(c)[0].as_py() != v for c, v in enumerate(last)):
                yield blocks(pa.Table.from_batches(kept))
                kept = []
            kept.append(batch.slice(at))
        if kept:
            yield blocks(pa.Table.from_batches(kept))

    return dealt.repartition("bucket", "i", "j").sortWithinPartitions(*key).mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each id of ``docs``; see the module for the steps.

    Ids must be integers. Other columns are neither read nor returned.
    """
    spark = docs.sparkSession
    tables = Scratch(spark, "near-duplicates")
    docs = docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text")).where(F.col("id").isNotNull())
    every = tables.write("every", sets(docs, "id", "text", shingle=shingle))
    # tables with unique ids need no shuffle of their sketches
    repeated = not every.groupBy("id").count().where("count > 1").isEmpty()
    every = tables.write("every", _one_row_each(every)) if repeated else every

    # equal sets are one class; the ids of all but its smallest meet nothing
    keys = ["fp_a", "fp_b", "n"]
    classes = tables.write("classes", every.where("n > 0").groupBy(*keys).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select(*keys, "rep"))
    copies = tables.write("copies", every.select("id", *keys).join(classes, keys).where("id != rep").select("id"))
    reps = among(every.where("n > 0"), copies, copies.count(), "left_anti")

    # buckets with more than one class
    banded = reps.select("id", F.posexplode(band_buckets("sketch")).alias("band", "bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct(F.xxhash64("id"), "id")).alias("pivot"))
    shared = tables.write("shared", shared.where("members > 1").select("bucket", F.col("pivot.id").alias("pivot")))
    multi = tables.write("multi", banded.join(shared, "bucket"))
    tables.drop("shared")
    met = tables.write("met", multi.select("id").distinct())
    n_met = met.count()
    near = tables.write("near", among(every, met, n_met).select("id", "n", "sketch"))

    full = sets(among(docs, met, n_met), "id", "text", shingle=shingle, sketch=False, elements=True)
    full = tables.write("full", (_one_row_each(full) if repeated else full).select("id", "cells", "elements"))
    pairs = multi.where("id != pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
    side = lambda x: near.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"k{x}"))
    likely = tables.write("likely", _likely(pairs.join(side("a"), "a").join(side("b"), "b"), percent))
    with settings(spark, **{"spark.sql.execution.arrow.maxRecordsPerBatch": SET_ROWS}):
        links = tables.write("links", _confirmed(likely, full, percent))
    first = _stars(links, tables, "first")

    members = multi.select("bucket", "band", "id").join(first, "id", "left").withColumn("component", F.coalesce("component", "id"))
    slim = lambda rows: near.join(full.select("id", "cells"), "id").join(rows.select("id").distinct(), "id", "left_semi")
    rest = tables.write("rest", _rest_pairs(members, slim, percent, tables).distinct())
    tables.drop("rows", "near", "multi", "met")
    with settings(spark, **{"spark.sql.execution.arrow.maxRecordsPerBatch": SET_ROWS}):
        more = tables.write("more", _confirmed(rest.join(likely, ["a", "b"], "left_anti"), full, percent))
    tables.drop("full", "rest", "likely", "links")

    # links found last join whole components
    if not more.isEmpty():
        of = lambda x: first.select(F.col("id").alias(x), F.col("component").alias(f"c{x}"))
        joined = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        then = _stars(joined, tables, "then").select(F.col("id").alias("component"), F.col("component").alias("least"))
        ids = first.unionByName(joined.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.col("id").alias("component")))
        first = tables.write("final", ids.join(then, "component", "left").select("id", F.coalesce("least", "component").alias("component")).where("id != component").distinct())
        tables.drop("first", "then")
    tables.drop("more")

    # documents that aren't the least of their component: by class, as copies have no row of their own
    of_class = every.select("id", *keys).join(first, "id")
    moved = of_class.select(*keys, "component").unionByName(classes.join(of_class.select(*keys), keys, "left_anti").withColumnRenamed("rep", "component"))
    moved = tables.write("moved", moved)
    tables.drop("classes", "copies", "first", "final")
    r = every.select("id", *keys).join(moved, keys, "left")
    component = F.coalesce("component", F.col("id"))
    return r.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).withColumnRenamed("id", "doc_id")


OP1_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws] ELSE list_transform(range(1, len(ws)), lambda i: [ws[i], ws[i + 1]]) END) AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
c AS (SELECT g, count(*) AS f FROM e GROUP BY g),
o AS (SELECT doc_id, n, e.g, row_number() OVER (PARTITION BY doc_id ORDER BY f, e.g) AS k FROM e JOIN c USING (g)),
p AS (SELECT * FROM o WHERE k <= n - ((n * {PERCENT} + 99) // 100) + 1),
q AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n)),
x AS (SELECT q.a, q.b, na, nb, count(*) AS common FROM q JOIN e y ON y.doc_id = q.a JOIN e z ON z.doc_id = q.b AND z.g = y.g GROUP BY ALL),
l AS (SELECT a, b FROM x WHERE 100 * common >= {PERCENT} * (na + nb - common)),
d AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM s UNION SELECT d.v, r.root FROM r JOIN d ON d.u = r.doc_id WHERE d.v > r.root),
m AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN m USING (doc_id)
"""

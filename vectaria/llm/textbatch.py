"""Vectorised views of a batch of texts: bytes, words, lines and their hashes.

A ``TextBatch`` lays the UTF-8 bytes of many texts in one array, each text between two
newline bytes, so that words and lines never run from one text into the next. Word
separators are the ASCII white space characters 0x20 and 0x09-0x0D; a null text is empty.

Hashes of spans mix their bytes in pieces of eight, for all spans at once; spans of more than
``LONG_SPAN`` bytes are hashed with BLAKE2. Different spans of over seven bytes have equal
hashes with a probability of about 2**-64; where that would not do, ``same_bytes`` compares them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectaria.functions.kernels import on_workers

#: Bytes of text that one vectorised pass holds at most; a longer text is a pass of its own.
SLICE_BYTES = 1 << 20
#: Bytes of text in one batch of results, likewise.
BATCH_BYTES = 4 << 20
#: Rows of an Arrow batch in a session that has Spark's default of 10,000: texts may be long.
BATCH_ROWS = "2000"
#: Longer spans are hashed with BLAKE2.
LONG_SPAN = 512

U64 = np.uint64

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> U64(29))
    h = h * U64(0xBF58476D1CE4E5B9)
    return h ^ (h >> U64(32))


class TextBatch:
    """Texts of one slice. ``beg`` and ``end`` are byte positions in ``data``."""

    def __init__(self, texts: pa.Array):
        raw, offs = utf8(texts)
        n = len(offs) - 1
        sizes = np.diff(offs)
        self.n = n
        self.raw, self.offs = raw, offs
        self.beg = offs[:-1] - offs[0] + np.arange(1, n + 1)
        self.end = self.beg + sizes
        self.data = np.full(int(sizes.sum()) + n + 1, 10, np.uint8)
        inside = np.ones(len(self.data), bool)
        inside[np.concatenate([[0], self.end])] = False
        self.data[inside] = raw

    @cached_property
    def white(self) -> np.ndarray:
        return WHITE[self.data]

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of all words."""
        turn = np.flatnonzero(self.white[1:] != self.white[:-1]) + 1
        return turn[::2], turn[1::2]

    @cached_property
    def word_bounds(self) -> np.ndarray:
        """Words of text d are word_bounds[d] up to word_bounds[d + 1]."""
        return np.searchsorted(self.words[0], np.append(self.beg, len(self.data)))

    @cached_property
    def word_doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.word_bounds))

    def hasher(self, lower: bool = False, salt: int = 0) -> SpanHash:
        return SpanHash(LOWER[self.data] if lower else self.data, salt)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a value per byte over each text."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.end] - total[self.beg]

    def per_text_words(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value per word over each text."""
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return np.diff(total[self.word_bounds])


class SpanHash:
    """64-bit hashes of byte spans of one array.

    A span is read in pieces of eight bytes, each mixed into the value of those before it by a
    bijection, so spans of up to seven bytes never collide with each other. ``salt`` gives
    another function.
    """

    def __init__(self, data: np.ndarray, salt: int = 0):
        self.data, self.salt = data, U64(salt)
        self.words = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(8, np.uint8)), 8)

    def piece(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The ``size`` bytes (8 at most) from each position on, as numbers."""
        return self.words[at].view("<u8").ravel() & _MASK[np.minimum(size, 8)]

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        size = stop - start
        if not len(size):
            return np.zeros(0, U64)
        # a size up to seven stands in the byte that no such span fills
        first = self.piece(start, size) | np.where(size < 8, size, 0).astype(U64) << U64(56)
        h = mix(first ^ self.salt)
        todo = np.flatnonzero((size >= 8) & (size <= LONG_SPAN))
        h[todo] = mix(h[todo] + size[todo].astype(U64) * U64(0xA0761D6478BD642F))
        done = 8
        while len(todo := todo[size[todo] > done]):
            h[todo] = mix((h[todo] * U64(0x9E3779B97F4A7C15)) ^ self.piece(start[todo] + done, size[todo] - done))
            done += 8
        for k in np.flatnonzero(size > LONG_SPAN):
            digest = hashlib.blake2b(self.data[start[k] : stop[k]].tobytes(), digest_size=8, salt=int(self.salt).to_bytes(8, "little")).digest()
            h[k] = int.from_bytes(digest, "little")
        return h


def same_bytes(a: SpanHash, start: np.ndarray, stop: np.ndarray, b: SpanHash, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For paired spans of two arrays: are their bytes the same."""
    size = stop - start
    same = size == end - begin
    done, todo = 0, np.flatnonzero(same)
    while len(todo := todo[size[todo] > done]):
        if done >= LONG_SPAN:
            for k in todo.tolist():
                same[k] = np.array_equal(a.data[start[k] + done : stop[k]], b.data[begin[k] + done : end[k]])
            break
        left = size[todo] - done
        ok = a.piece(start[todo] + done, left) == b.piece(begin[todo] + done, left)
        same[todo[~ok]] = False
        todo = todo[ok]
        done += 8
    return same


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from the first byte) of a string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    buffers = texts.buffers()
    offs = np.frombuffer(buffers[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts together have at most ``most`` bytes, or one longer text."""
    _, offs = utf8(texts)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(offs, offs[at] + most, "right")) - 1
        to = min(max(to, at + 1), len(texts))
        yield at, to
        at = to


def in_slices(texts: pa.Array, compute: Callable[[pa.Array], list], most: int = SLICE_BYTES) -> list[pa.Array]:
    """``compute`` over slices of the texts; its columns are joined again."""
    parts = [[pa.array(c) if not isinstance(c, pa.Array) else c for c in compute(texts.slice(a, b - a))] for a, b in slices(texts, most)]
    return [pa.concat_arrays(list(c)) for c in zip(*parts, strict=True)] if parts else []


def repeats_earlier(group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items in order: is an equal (group, key) found before; is one found before or after."""
    if not len(key):
        return np.zeros(0, bool), np.zeros(0, bool)
    mixed = mix(key + group.astype(U64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(mixed, kind="stable")
    m = mixed[order]
    same = np.concatenate([[False], m[1:] == m[:-1]])
    before, either = np.zeros(len(key), bool), np.zeros(len(key), bool)
    before[order] = same
    either[order] = same | np.append(same[1:], False)
    return before, either


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def annotate(df: DataFrame, text_col: str, name: str, ddl: str, compute: Callable[[pa.Array], list], keep: list[str] | None = None) -> DataFrame:
    """Rows of ``df`` with a struct column ``name`` that ``compute`` makes of each text.

    ``keep`` lists the input columns to return (default: all). As with withColumn, a column
    called ``name`` is replaced. Rows, their order within a partition and repeated ids stay as
    they are; there is no shuffle. ``compute`` takes a string array (null: empty text) and
    returns one array per field of ``ddl``. A session with Spark's default size of Arrow batches
    gets BATCH_ROWS instead.
    """
    on_workers(df.sparkSession)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(rows) == "10000":
        df.sparkSession.conf.set(rows, BATCH_ROWS)
    keep = [c for c in (df.columns if keep is None else keep) if c != name]
    source = df.select(*[col(c).alias(f"c{k}") for k, c in enumerate(keep)], col(text_col).cast("string").alias("text"))
    result = T.StructType.fromDDL(ddl) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(ddl)
    fields = [f.name for f in result.fields]
    schema = T.StructType([*[T.StructField(c, f.dataType) for c, f in zip(keep, source.schema.fields, strict=False)], T.StructField(name, result)])
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in result.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for a, z in slices(batch.column(batch.num_columns - 1), BATCH_BYTES):
                part = batch.slice(a, z - a)
                text = part.column(part.num_columns - 1)
                text = pc.fill_null(text, "") if text.null_count else text
                made = [pa.array(c).cast(k) if not isinstance(c, pa.Array) else c.cast(k) for c, k in zip(compute(text), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.StructArray.from_arrays(made, names=fields)], names=[*keep, name])

    return source.mapInArrow(run, schema)

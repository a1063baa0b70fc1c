"""Quality rules from repeated substrings: suffix arrays over words.

For every text a suffix array of its words is built by prefix doubling, for all texts of a
slice at once; only suffixes that still share their prefix with another take part in the next
doubling. Longest common prefixes of neighbours come from the ranks of the doublings. The
longest LCP interval that holds a suffix gives the longest repeat that starts there; the union
of these spans is the repeated part of the text.

A text is rejected if repeats of at least ``min_repeat`` words cover more than
``max_covered`` percent of its words, or if some repeat has ``long_repeat`` words or more, or
if the base rules fail (fewer than 50 words, or over half the words in repeated 3-word
windows). Null and empty texts have no words, so they fail the base rules. Whole texts are
read, with no limit on their length; rows that occur more than once are judged each. A longest
repeat of fewer than three words is given as 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectaria.llm.textbatch import U64, TextBatch, annotate, in_slices, mix, repeats_earlier

MIN_REPEAT = 6
MAX_COVERED = 45
LONG_REPEAT = 120
MIN_WORDS = 50
MAX_TRIPLES = 50

FIELDS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint,"
    " covered_words bigint, longest_repeat bigint, base_failed boolean, kept boolean"
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def suffix_array(symbol: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of several symbol sequences laid end to end, suffixes ending with their doc.

    Returns the array and the ranks before each doubling: in the k-th, suffixes have equal
    ranks if and only if their first 2**k symbols exist and are equal and they are of one doc.
    """
    n = len(symbol)
    if not n:
        return np.zeros(0, np.int64), []
    order = np.lexsort((symbol, doc))
    s, d = symbol[order], doc[order]
    head = np.concatenate([[True], (s[1:] != s[:-1]) | (d[1:] != d[:-1])])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    stop = np.searchsorted(doc, doc, "right")
    levels, h = [rank.astype(np.int32)], 1
    while True:
        tied = ~(head & np.append(head[1:], True))
        slots = np.flatnonzero(tied)
        if not len(slots):
            return order, levels
        at = order[slots]
        ahead = at + h
        second = np.where(ahead < stop[at], rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.lexsort((second, rank[at]))
        at, second = at[by], second[by]
        first = rank[at]
        order[slots] = at
        new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        head[slots] = new
        rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        levels.append(rank.astype(np.int32))
        h *= 2


def neighbour_lcp(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Longest common prefix of each suffix in the array with the one before it (0 at first)."""
    n = len(order)
    lcp = np.zeros(n, np.int64)
    live = np.arange(1, n)
    live = live[levels[0][order[live]] == levels[0][order[live - 1]]] if n else live
    i, j = order[live].copy(), order[live - 1].copy()
    for k in range(len(levels) - 1, -1, -1):
        inside = np.maximum(i, j) < n
        same = np.zeros(len(live), bool)
        same[inside] = levels[k][i[inside]] == levels[k][j[inside]]
        lcp[live[same]] += 1 << k
        i[same] += 1 << k
        j[same] += 1 << k
    return lcp


def longest_repeat_at(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Length of the longest repeat that starts at each position: its deepest LCP interval."""
    lcp = neighbour_lcp(order, levels)
    out = np.zeros(len(order), np.int64)
    if len(order):
        out[order] = np.maximum(lcp, np.append(lcp[1:], 0))
    return out


def _slice(texts: pa.Array, min_repeat: int, max_covered: int, long_repeat: int) -> list:
    b = TextBatch(texts)
    start, stop = b.words
    doc, bounds, hashed = b.word_doc, b.word_bounds, b.hasher()
    word = hashed(start, stop)
    n_words = np.diff(bounds)
    lead = (b.data & 0xC0) != 0x80
    word_chars = b.per_text(lead & ~b.white)
    n_symbols = b.per_text(_SYMBOL[b.data])

    # lines with a word, equal to an earlier line of their text
    breaks = np.flatnonzero(b.data == 10)
    begun, ended = breaks[:-1] + 1, breaks[1:]
    has_word = np.searchsorted(start, ended) > np.searchsorted(start, begun)
    begun, ended = begun[has_word], ended[has_word]
    line_doc = np.searchsorted(b.beg, begun, "right") - 1
    again, _ = repeats_earlier(line_doc, hashed(begun, ended))
    n_dup_lines = np.bincount(line_doc[again], minlength=b.n)

    # words in 3-word windows that occur twice or more
    k = max(len(word) - 2, 0)
    whole = np.flatnonzero(doc[2:] == doc[:k]) if k else np.zeros(0, np.int64)
    triple = mix(word[whole] * U64(3) + mix(word[whole + 1] * U64(5) + mix(word[whole + 2]))) if k else np.zeros(0, np.uint64)
    _, found = repeats_earlier(doc[whole], triple)
    marked = np.zeros(len(word), bool)
    for step in range(3):
        marked[whole[found] + step] = True
    n_repeat_words = b.per_text_words(marked)

    # only texts with a repeated 3-word window can have repeats of min_repeat words
    take = np.repeat(n_repeat_words > 0, n_words) if min_repeat >= 3 else np.ones(len(word), bool)
    order, levels = suffix_array(word[take], doc[take])
    reach = np.zeros(len(word), np.int64)
    reach[take] = longest_repeat_at(order, levels)
    spans = np.flatnonzero(reach >= min_repeat)
    edge = np.zeros(len(word) + 1, np.int64)
    np.add.at(edge, spans, 1)
    np.add.at(edge, spans + reach[spans], -1)
    covered = b.per_text_words(np.cumsum(edge[:-1]) > 0)
    longest = np.zeros(b.n, np.int64)
    np.maximum.at(longest, doc, reach)

    base_failed = (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_TRIPLES * n_words)
    kept = ~base_failed & (100 * covered <= max_covered * n_words) & (longest < long_repeat)
    return [n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered, longest, base_failed, kept]


def repetition(
    df: DataFrame, text_col: str = "text", name: str = "repetition", *, min_repeat: int = MIN_REPEAT, max_covered: int = MAX_COVERED, long_repeat: int = LONG_REPEAT, keep: list[str] | None = None
) -> DataFrame:
    """``df`` with a struct column ``name`` of FIELDS; see the module for the rules and edge cases."""

    def compute(texts: pa.Array) -> list:
        return in_slices(texts, lambda part: _slice(part, min_repeat, max_covered, long_repeat))

    return annotate(df, text_col, name, FIELDS, compute, keep)


def keep_clean(df: DataFrame, text_col: str = "text", **parameters: int) -> DataFrame:
    """The rows of ``df`` whose text passes the rules, with the columns of ``df`` alone."""
    name = "__repetition"
    while name in df.columns:
        name += "_"
    return repetition(df, text_col, name, **parameters).where(F.col(f"{name}.kept")).drop(name)


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    r = repetition(docs, keep=["doc_id"])
    return r.select("doc_id", *[f"repetition.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words")])


OP2_SQL = f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
b AS (
  SELECT doc_id, ws, len(ws)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM w),
p AS (SELECT doc_id, ws, unnest(range(1, n_words - 1)) AS i FROM b),
g3 AS (SELECT doc_id, i, [ws[i], ws[i + 1], ws[i + 2]] AS g FROM p),
r3 AS (SELECT doc_id, i FROM g3 QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c3 AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r3, range(3) AS o(o) GROUP BY doc_id),
q AS (SELECT doc_id, ws, n_words, unnest(range(1, n_words - {MIN_REPEAT} + 2)) AS i FROM b WHERE doc_id IN (SELECT doc_id FROM c3)),
gq AS (SELECT doc_id, i, ws[i : i + {MIN_REPEAT} - 1] AS g FROM q),
rq AS (SELECT doc_id, i FROM gq QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cq AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM rq, range({MIN_REPEAT}) AS o(o) GROUP BY doc_id),
gl AS (SELECT doc_id, hash(ws[i : i + {LONG_REPEAT} - 1]) AS g FROM q WHERE i + {LONG_REPEAT} - 1 <= n_words),
lr AS (SELECT DISTINCT doc_id FROM (SELECT doc_id FROM gl GROUP BY doc_id, g HAVING count(*) > 1)),
z AS (
  SELECT b.doc_id, n_words, word_chars, n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(c3.n, 0)::BIGINT AS n_repeat_words, coalesce(cq.n, 0)::BIGINT AS covered_words, lr.doc_id IS NOT NULL AS is_long
  FROM b LEFT JOIN c3 USING (doc_id) LEFT JOIN cq ON cq.doc_id = b.doc_id LEFT JOIN lr ON lr.doc_id = b.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_TRIPLES} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_TRIPLES} * n_words)
    AND 100 * covered_words <= {MAX_COVERED} * n_words AND NOT is_long AS kept,
  covered_words
FROM z
"""

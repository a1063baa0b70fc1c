"""Pre-tokens of byte-level BPE, found for a whole batch at once.

Splits texts exactly as the pattern of the public tokenizers does,
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``,
but from character classes and their changes rather than a scan by the regular expression:
a run of letters, digits or other signs takes one blank before it, white space before a
word leaves its last character to that word (a blank) or by itself (any other), and an
apostrophe that starts a token takes one of the listed endings.
"""

from __future__ import annotations

import numpy as np
import regex

from vectaria.llm.textbatch import TextBatch

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Endings of the pattern's first alternatives.
ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")

_space, _letter, _number = regex.compile(r"\s"), regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
_class_of = np.full(0x110000, -1, np.int8)


def _classify(points: np.ndarray) -> np.ndarray:
    todo = points[_class_of[points] < 0]
    for p in np.unique(todo).tolist():
        c = chr(p)
        _class_of[p] = SPACE if _space.match(c) else LETTER if _letter.match(c) else NUMBER if _number.match(c) else OTHER
    return _class_of[points]


_ascii = _classify(np.arange(128))
_byte_class = np.concatenate([_ascii, np.full(128, OTHER, np.int8)])


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, code points and byte lengths of the characters above ASCII."""
    at = np.flatnonzero(data >= 0xC0)
    if not len(at):
        return at, at, at
    lead = data[at].astype(np.int64)
    size = np.where(lead >= 0xF0, 4, np.where(lead >= 0xE0, 3, 2))
    last = len(data) - 1
    point = lead & np.where(size == 2, 0x1F, np.where(size == 3, 0x0F, 0x07))
    for k in range(1, 4):
        more = size > k
        point[more] = point[more] << 6 | (data[np.minimum(at[more] + k, last)] & 0x3F)
    return at, np.minimum(point, 0x10FFFF), size


def classes(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    cls = _byte_class[data]
    at, point, size = code_points(data)
    if len(at):
        kind = _classify(point)
        cls[at] = kind
        last = len(data) - 1
        for k in range(1, 4):
            more = size > k
            cls[np.minimum(at[more] + k, last)] = kind[more]
    return cls


def pretokens(b: TextBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes of ``b.data``) of all pre-tokens in order, and the bounds of each text's."""
    data, n = b.data, len(b.data)
    cls = classes(data)
    cls[b.beg - 1] = -1
    cls[n - 1] = -1
    edge = np.flatnonzero(cls[1:] != cls[:-1]) + 1
    # every text stands between two separators, so runs tile it; separators of empty texts adjoin
    start, stop = edge[:-1], edge[1:]
    real = cls[start] >= 0
    start, stop = start[real].copy(), stop[real].copy()
    kind = cls[start]
    if not len(start):
        return start, stop, np.zeros(b.n + 1, np.int64)

    blank = kind == SPACE
    final = np.ones(len(start), bool)
    final[:-1] = start[1:] != stop[:-1]
    inner = blank & ~final
    # size in bytes of the last character of white space that precedes a word
    tail = np.ones(len(start), np.int64)
    k = np.flatnonzero(inner & (data[stop - 1] >= 0x80))
    for step in (2, 3, 4):
        here = k[stop[k] - step >= start[k]]
        hit = here[(data[stop[here] - step] >= 0xC0) & (tail[here] == 1)]
        tail[hit] = step
    lent = inner & (data[stop - 1] == 0x20)
    takes = np.concatenate([[False], lent[:-1]])

    # apostrophes that start a token, with an ending after them
    cut = np.zeros(len(start), np.int64)
    apos = np.flatnonzero((kind == OTHER) & (stop - start == 1) & (data[start] == 0x27) & ~takes & ~final)
    apos = apos[kind[apos + 1] == LETTER] if len(apos) else apos
    if len(apos):
        first = stop[apos]
        one = data[first]
        two = np.where(first + 1 < stop[apos + 1], data[np.minimum(first + 1, n - 1)], 0)
        for ending in ENDINGS:
            hit = (cut[apos] == 0) & (one == ending[0])
            if len(ending) == 2:
                hit &= two == ending[1]
            cut[apos[hit]] = len(ending)

    # each run gives at most two tokens: the second is a lone white space character
    word_start = start - takes
    moved = np.concatenate([[0], cut[:-1]])
    word_start += moved
    word_stop = stop + cut
    first_stop = np.where(inner, stop - tail, word_stop)
    second = inner & ~lent
    a = np.stack([word_start, stop - tail], 1).ravel()
    z = np.stack([first_stop, stop], 1).ravel()
    there = np.stack([first_stop > word_start, second], 1).ravel()
    a, z = a[there], z[there]
    return a, z, np.searchsorted(a, np.append(b.beg, n))

"""Secret scans through a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams: literal strings
of a sequence are multiplied out, alternatives become OR, and a sequence becomes the AND of
its parts. For each slice of texts the postings of the trigrams that queries use are bitmaps
over the texts; queries intersect and unite them, and rules run on their candidates alone.
A rule without a mandatory trigram runs on every text. Trigrams are those of the text with
A-Z lower-cased, which suits rules of either case.

Spans of the three base rules come first and are never dropped; further rules find formats
of known issuers. A rule's matches are the leftmost non-overlapping ones; those that fail its
check are dropped without a retry. Null texts are empty and have no spans; whole texts are
scanned.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vectaria.llm.spans import SPANS_DDL, Span, as_array, digest, joined, ordered
from vectaria.llm.textbatch import LOWER, TextBatch, annotate, in_slices

#: Kind, expression, flags, check of a match.
RULES: tuple[tuple[str, str, int, Callable[[re.Match], bool] | None], ...] = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 6),
    ("access", r"AKIA[A-Z0-9]+", re.A, lambda m: len(m[0]) >= 20),
    ("hex", r"[0-9a-f]+", re.A, lambda m: len(m[0]) >= 24),
    ("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----", re.A, None),
    ("json_web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", re.A, None),
    ("forge_token", r"(?<![A-Za-z0-9_])gh[opsur]_[A-Za-z0-9]{36,}", re.A, None),
    ("chat_token", r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}", re.A, None),
    ("map_key", r"(?<![A-Za-z0-9_-])AIza[0-9A-Za-z_-]{35}", re.A, None),
    ("pay_key", r"(?<![A-Za-z0-9_])[rs]k_(?:live|test)_[0-9A-Za-z]{16,}", re.A, None),
    ("url_password", r"://[A-Za-z0-9._~-]+:[^\s/:@]{3,}@[A-Za-z0-9.-]+", re.A, None),
)
BASE = ("assign", "access", "hex")
KINDS = {r[0]: k for k, r in enumerate(RULES)}
#: Literal strings multiplied out at most, and characters of a class spelled out at most.
MOST_STRINGS, MOST_CHARS = 64, 6

TRUE = ("true",)


def _all(parts: list) -> tuple:
    parts = [p for p in parts if p != TRUE]
    return TRUE if not parts else parts[0] if len(parts) == 1 else ("and", *dict.fromkeys(parts))


def _any(parts: list) -> tuple:
    return TRUE if TRUE in parts or not parts else parts[0] if len(parts) == 1 else ("or", *dict.fromkeys(parts))


def _of_strings(strings: set[str]) -> tuple:
    """Some one of the strings occurs."""
    return _any([_all([("has", s.encode()[i : i + 3]) for i in range(len(s.encode()) - 2)]) if len(s.encode()) > 2 else TRUE for s in sorted(strings)])


def _item(op, arg) -> tuple[set[str] | None, tuple]:
    """Of one node: the strings it can match, if few, and what must hold besides."""
    if op is C.LITERAL:
        return {chr(arg).lower() if arg < 128 else chr(arg)}, TRUE
    if op is C.IN and all(o is C.LITERAL for o, _ in arg) and len(arg) <= MOST_CHARS:
        return {chr(a).lower() if a < 128 else chr(a) for _, a in arg}, TRUE
    if op is C.SUBPATTERN:
        return _sequence(arg[3])
    if op is C.BRANCH:
        parts = [_sequence(p) for p in arg[1]]
        if all(s is not None for s, _ in parts) and len(union := set().union(*(s for s, _ in parts))) <= MOST_STRINGS and all(q == TRUE for _, q in parts):
            return union, TRUE
        return None, _any([_all([q, TRUE if s is None else _of_strings(s)]) for s, q in parts])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        low, high, inner = arg
        strings, query = _sequence(inner)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, TRUE
        if low == high and strings is not None and len(strings) == 1 and low <= 16:
            return {s * low for s in strings}, query
        return None, TRUE if low == 0 else _all([query, TRUE if strings is None else _of_strings(strings)])
    if op in (C.AT, C.ASSERT, C.ASSERT_NOT):
        return {""}, TRUE
    return None, TRUE


def _sequence(nodes) -> tuple[set[str] | None, tuple]:
    run, queries, exact = {""}, [], True
    for op, arg in nodes:
        strings, query = _item(op, arg)
        queries.append(query)
        if strings is None or len(strings) * len(run) > MOST_STRINGS:
            exact = False
            queries.append(_of_strings(run))
            run = {""} if strings is None else strings
        else:
            run = {a + b for a in run for b in strings}
    if exact:
        return run, _all(queries)
    return None, _all([*queries, _of_strings(run)])


def trigram_query(expression: str, flags: int = 0) -> tuple:
    """What trigrams a lower-cased text must have for the expression to match in it."""
    strings, query = _sequence(_parser.parse(expression, flags))
    return query if strings is None else _all([query, _of_strings(strings)])


def trigrams(query: tuple) -> set[bytes]:
    return {query[1]} if query[0] == "has" else set().union(*(trigrams(q) for q in query[1:])) if len(query) > 1 else set()


class Index:
    """Postings, for slices of texts, of the trigrams that some rule's query uses."""

    def __init__(self, rules=RULES):
        self.rules = [(kind, re.compile(e, flags), check, trigram_query(e, flags)) for kind, e, flags, check in rules]
        used = sorted(set().union(*(trigrams(q) for *_, q in self.rules)))
        self.slot = {t: k for k, t in enumerate(used)}
        self.table = np.full(1 << 24, -1, np.int16)
        for t, k in self.slot.items():
            self.table[int.from_bytes(t, "big")] = k

    def postings(self, b: TextBatch) -> np.ndarray:
        """Bitmap: trigram slot by text."""
        d = LOWER[b.data].astype(np.int32)
        code = d[:-2] << 16
        code |= d[1:-1] << 8
        code |= d[2:]
        slot = self.table[code]
        at = np.flatnonzero(slot >= 0)
        out = np.zeros((len(self.slot), b.n), bool)
        out[slot[at], np.maximum(np.searchsorted(b.beg, at, "right") - 1, 0)] = True
        return out

    def candidates(self, query: tuple, postings: np.ndarray) -> np.ndarray:
        if query[0] == "has":
            return postings[self.slot[query[1]]]
        if query == TRUE:
            return np.ones(postings.shape[1], bool)
        parts = [self.candidates(q, postings) for q in query[1:]]
        return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)

    def find(self, texts: pa.Array) -> list[list[Span]]:
        postings = self.postings(TextBatch(texts))
        plain = texts.to_pylist()
        out: list[list[Span]] = [[] for _ in plain]
        for kind, expression, check, query in self.rules:
            if kind == "hex":
                expression = _HEX_RUN
            for k in np.flatnonzero(self.candidates(query, postings)).tolist():
                for m in expression.finditer(plain[k] or ""):
                    if check is None or check(m):
                        out[k].append((kind, *m.span()))
        return [ordered(s, KINDS) for s in out]


#: Maximal runs of 24 or more are the matches of the rule ``hex`` that pass its check.
_HEX_RUN = re.compile(r"[0-9a-f]{24,}", re.A)
_index: dict[str, Index] = {}


def find(texts: pa.Array) -> list[list[Span]]:
    if "own" not in _index:
        _index["own"] = Index()
    return _index["own"].find(texts)


DIGESTS = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"


def _digests(texts: pa.Array) -> list:
    rows = find(texts)
    base = [[s for s in r if s[0] in BASE] for r in rows]
    return [*(pa.array([sum(s[0] == k for s in r) for r in base], pa.int64()) for k in BASE), pa.array([digest(r) for r in base], pa.string()), pa.array([joined(r) for r in rows], pa.string())]


def secrets(df: DataFrame, text_col: str = "text", name: str = "secrets", *, digests: bool = False, keep: list[str] | None = None) -> DataFrame:
    """``df`` with a struct column of each text's secret spans, or (``digests``) their counts and digests."""

    def compute(texts: pa.Array) -> list:
        return in_slices(texts, _digests if digests else lambda t: [as_array(find(t))])

    return annotate(df, text_col, name, DIGESTS if digests else f"spans {SPANS_DDL}", compute, keep)


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    r = secrets(docs, digests=True, keep=["doc_id"])
    return r.select("doc_id", *[f"secrets.{c}" for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")])

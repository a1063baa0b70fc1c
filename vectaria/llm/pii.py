"""Personal data: high-recall generators, boosted trees, calibrated thresholds.

Base spans (email, ip, card, phone) follow fixed expressions and checks and are always kept.
Beyond them, generators propose overlapping candidates: number groups, account numbers and
addresses written out with (at) and (dot). Boosted trees score a candidate from its format
and the words around it. They are trained on the driver on candidates made from templates
with a fixed seed, half of which set each kind's threshold: the lowest score at which no more
than ``MOST_FALSE`` of the held-out negatives of the kind would pass. Of the selected ones
that overlap each other the highest score wins, and none may overlap a base span.

Null texts are empty and have no spans. Whole texts are read; matching takes time linear in
their length. Redaction replaces spans by ``[KIND]``; overlapping base spans are replaced as
one, under the kind of the first.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectaria.llm.boosting import Boosted
from vectaria.llm.spans import SPANS_DDL, Span, as_array, digest, joined, ordered
from vectaria.llm.textbatch import TextBatch, annotate, col, in_slices

BASE = ("email", "ip", "card", "phone")
MORE = ("card_number", "dialled_phone", "national_id", "account", "local_phone", "spelled_email")
KINDS = {k: i for i, k in enumerate((*BASE, *MORE))}
MOST_FALSE = 0.002
SEED = 11

#: The base expressions, written so that they start only at the start of a run.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", re.A)
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)", re.A)
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+", re.A)
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]", re.A)
_LOCAL_CHAR = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if k & 1:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[Span]:
    """Leftmost matches: at each @, the run of local characters before it and a domain after it."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHAR:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(free, at + 1))
    return out


def base_spans(text: str) -> list[Span]:
    out = emails(text)
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:] if len(p) > 3 else p) <= 255 for p in m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(_digits(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return ordered(out, KINDS)


# ---- candidates

_GROUPS = re.compile(r"(?<![0-9A-Za-z+.-])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,17}(?![0-9A-Za-z])", re.A)
_CARD_GROUP = re.compile(r"(?<![0-9A-Za-z])(?:[0-9]{14,19}|[0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{2,4}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![0-9A-Za-z])", re.A)
_DIALLED = re.compile(r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[\x20.-]?[0-9]{2,4}){2,3}(?![0-9])", re.A)
_ACCOUNT = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![0-9A-Za-z])", re.A)
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]{2,64}\x20?[(\[{]at[)\]}]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[(\[{]dot[)\]}])\x20?[A-Za-z0-9-]{2,63}){1,4}", re.A | re.I)
#: Context words by topic.
_CONTEXT = {
    "identity": re.compile(r"ssn|social|security|passport|national|identit|tax", re.I),
    "phone": re.compile(r"phone|call|tel|mobile|cell|fax|contact|reach", re.I),
    "account": re.compile(r"iban|account|acct|bank|transfer|routing", re.I),
    "mail": re.compile(r"mail|write|contact|address", re.I),
    "thing": re.compile(r"order|invoice|isbn|version|serial|part|item|ticket|page|date|ref|model|build|sku", re.I),
}
CONTEXT_CHARS = 32
_LAST_WORD = re.compile(r"[A-Za-z]*$", re.A)


def candidates(text: str) -> list[Span]:
    """Overlapping proposals of the kinds in MORE; card and phone numbers too, where a base match ran on and failed."""
    out: list[Span] = []
    for m in _GROUPS.finditer(text):
        out += [("national_id", *m.span()), ("local_phone", *m.span())]
    out += [("card_number", *m.span()) for m in _CARD_GROUP.finditer(text)]
    out += [("dialled_phone", *m.span()) for m in _DIALLED.finditer(text)] if "+" in text else []
    out += [("account", *m.span()) for m in _ACCOUNT.finditer(text)]
    if "(" in text or "[" in text or "{" in text:
        out += [("spelled_email", *m.span()) for m in _SPELLED.finditer(text)]
    return out


def _mod97(s: str) -> bool:
    s = s.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def describe(text: str, span: Span) -> list[float]:
    """Format and context features of a candidate."""
    kind, a, z = span
    s = text[a:z]
    d = _digits(s)
    before, after = text[max(0, a - CONTEXT_CHARS) : a], text[z : z + 12]
    groups = [len(g) for g in re.split(r"[^0-9]+", s) if g]
    shape = groups[:4] + [0] * (4 - len(groups[:4]))
    return [
        *[float(kind == k) for k in MORE], float(z - a), float(len(d)), *map(float, shape), float(len(groups)),
        float(len(set(d))), float(s.count("-")), float(s.count(" ")), float(s.count(".")), float("(" in s), float(bool(d) and luhn(d)),
        float(bool(d) and d[:2] in ("19", "20")), float(kind == "account" and _mod97(s)),
        float(len(_LAST_WORD.search(s)[0])), float(_LAST_WORD.search(s)[0].islower()), float(". " in s), float("dot" in s.lower()),
        *[float(bool(p.search(before))) for p in _CONTEXT.values()], float(before[-1:].isalnum()), float(after[:1] in tuple("%$€")), float(before.rstrip()[-1:] in (":", "=", "#")),
    ]


def _training(rng: random.Random, n: int) -> list[tuple[str, Span, int]]:
    """Texts made from templates, each with a candidate and whether it is personal data."""
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdeghilmnorstu") for _ in range(rng.randint(2, 9)))
    some = lambda *x: rng.choice(x)

    def iban(valid: bool) -> str:
        body = num(18)
        check = 98 - int(body + "131400") % 97
        check = check if valid else (check + rng.randint(1, 90)) % 97 + 2
        return some("DE", "FR", "ES") + f"{check:02d}{body}" if not valid else f"DE{check:02d}{body}"

    out = []
    while len(out) < n:
        kind = rng.choice(MORE)
        good = rng.random() < 0.5
        plain = some(f"{word()} {word()} ", f"{word()}, ", f"{word()} the ")
        thing = some("order ", "invoice no ", "ISBN ", "version ", "serial ", "ref: ", "item ", "date ", plain, plain)
        if kind == "card_number":
            body = some("4", "5", "3", "6") + num(14)
            check = next(c for c in "0123456789" if luhn(body + c)) if good else next(c for c in "5036174928" if not luhn(body + c))
            card = body + check
            text, lead = some(card, f"{card[:4]} {card[4:8]} {card[8:12]} {card[12:]}"), some("card ", f"({num(3)}) {num(3)}-{num(4)} ", plain) if good else thing
        elif kind == "dialled_phone":
            text, lead = (some(f"+1 ({num(3)}) {num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(4)} {num(3)}", f"+1-{num(3)}-{num(3)}-{num(4)}"), some("call ", "phone: ", plain)) if good else (some(f"+{num(2)} {num(2)} {num(2)} {num(2)}", f"+{num(1)} {num(2)}.{num(2)} {num(2)}"), some(f"{plain}{num(3)}", f"{plain}x", thing))
        elif kind == "national_id":
            text, lead = (f"{num(3)}-{num(2)}-{num(4)}", some("SSN ", "social security: ", "SSN: ", plain)) if good else (some(f"20{num(2)}-{num(2)}-{num(2)}", f"{num(3)}-{num(10)}", num(9), num(16), f"{num(4)}-{num(4)}", f"{num(2)}.{num(2)}.{num(4)}", f"{num(3)}-{num(3)}-{num(4)}"), thing)
        elif kind == "local_phone":
            text, lead = (some(f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}"), some("call ", "phone: ", "tel ", "mobile ", plain)) if good else (some(f"20{num(2)}-{num(2)}-{num(2)}", num(10), num(12), num(16), f"{num(4)} {num(4)} {num(4)}", f"{num(3)}-{num(2)}-{num(4)}", f"{num(1)}.{num(3)}.{num(3)}"), thing)
        elif kind == "account":
            text, lead = (iban(True), some("IBAN ", "account: ", "transfer to ", plain)) if good else (some(iban(False), "AB" + num(14), f"XK{num(2)}AZ{num(12)}"), thing)
        else:
            at, dot = some(" (at) ", "(at)", " [at] ", "[at]", " {at} "), some(" (dot) ", "(dot)", " [dot] ", "[dot]", ".")
            name = some(word(), f"{word()}.{word()}", f"{word()}_{word()}", f"{word()[0]}.{word()}", f"{word()}{num(2)}")
            site = some(word(), word(), f"{word()}-{word()}", f"{word()}{dot}{word()}")
            good_text = f"{name}{at}{site}{dot}{some('com', 'org', 'net', 'de', 'edu', 'io', 'co', 'info')}"
            text, lead = (good_text, some("mail ", "write to ", "contact: ", "ask ", "to ", plain, plain)) if good else (f"{word()}{at}{word()}.{some(num(2), ' ' + word().capitalize(), word().capitalize() + word(), word() + word() + word())}", plain)
        whole = f"{plain}{lead}{text} {word()}"
        found = [s for s in candidates(whole) if s[0] == kind]
        if found:
            out.append((whole, found[0], int(good)))
    return out


class Detector:
    """Boosted trees and a threshold for each kind."""

    def __init__(self, seed: int = SEED, n: int = 6000):
        rows = _training(random.Random(seed), n)
        x = np.array([describe(t, s) for t, s, _ in rows])
        y = np.array([g for *_, g in rows], float)
        half = len(rows) // 2
        self.trees = Boosted().fit(x[:half], y[:half])
        kind = np.array([s[0] for _, s, _ in rows])[half:]
        score, held = self.trees.margin(x[half:]), y[half:]
        self.threshold = {}
        for k in MORE:
            wrong = np.sort(score[(kind == k) & (held == 0)])
            most = int(len(wrong) * MOST_FALSE)
            self.threshold[k] = max(float(wrong[len(wrong) - 1 - most]) if len(wrong) else 0.0, 1.0)

    def select(self, rows: list[tuple[int, str, list[Span], list[Span]]]) -> dict[int, list[Span]]:
        """Of (row, text, base spans, candidates), the further spans of each row."""
        flat = [(r, s) for r, _, _, proposed in rows for s in proposed]
        out: dict[int, list[Span]] = {r: [] for r, *_ in rows}
        if not flat:
            return out
        texts = {r: t for r, t, *_ in rows}
        score = self.trees.margin(np.array([describe(texts[r], s) for r, s in flat]))
        taken = {r: list(base) for r, _, base, _ in rows}
        for k in sorted(range(len(flat)), key=lambda k: (-score[k], flat[k][0], flat[k][1][1], KINDS[flat[k][1][0]])):
            r, s = flat[k]
            if score[k] > self.threshold[s[0]] and all(s[2] <= a or z <= s[1] for _, a, z in taken[r]):
                taken[r].append(s)
                out[r].append(s)
        return out


def find(texts: pa.Array, detector: Detector) -> tuple[list[list[Span]], list[list[Span]]]:
    """Base spans and all spans of each text."""
    b = TextBatch(texts)
    digit = b.per_text((b.data >= 48) & (b.data <= 57))
    at = b.per_text(b.data == 64)
    open_ = b.per_text((b.data == 40) | (b.data == 91) | (b.data == 123))
    base: list[list[Span]] = [[] for _ in range(b.n)]
    rows = []
    for k in np.flatnonzero((digit >= 4) | (at > 0) | (open_ > 0)).tolist():
        text = texts[k].as_py() or ""
        base[k] = base_spans(text)
        if proposed := candidates(text):
            rows.append((k, text, base[k], proposed))
    more = detector.select(rows)
    return base, [ordered(base[k] + more.get(k, []), KINDS) for k in range(b.n)]


DIGESTS = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_spans bigint"


def _run(df: DataFrame, text_col: str, name: str, ddl: str, make: Callable, keep: list[str] | None) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(Detector())

    def compute(texts: pa.Array) -> list:
        return in_slices(texts, lambda t: make(t, *find(t, shared.value)))

    return annotate(df, text_col, name, ddl, compute, keep)


def _digests(_: pa.Array, base: list[list[Span]], spans: list[list[Span]]) -> list:
    counts = [pa.array([sum(s[0] == k for s in r) for r in base], pa.int64()) for k in BASE]
    return [*counts, pa.array([digest(r) for r in base], pa.string()), pa.array([joined(r) for r in spans], pa.string()), pa.array([len(r) for r in spans], pa.int64())]


def redact_text(text: str, spans: list[Span]) -> str:
    parts, at = [], 0
    for kind, a, z in spans:
        if a >= at:
            parts += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, z)
    return "".join([*parts, text[at:]])


def _redacted(texts: pa.Array, _: list[list[Span]], spans: list[list[Span]]) -> list:
    return [pa.array([t if not r or t is None else redact_text(t, r) for t, r in zip(texts.to_pylist(), spans, strict=True)], pa.string()), as_array(spans)]


def personal_data(df: DataFrame, text_col: str = "text", name: str = "pii", *, digests: bool = False, keep: list[str] | None = None) -> DataFrame:
    """``df`` with a struct column: the redacted text and all spans, or (``digests``) counts and digests."""
    if digests:
        return _run(df, text_col, name, DIGESTS, _digests, keep)
    return _run(df, text_col, name, f"redacted string, spans {SPANS_DDL}", _redacted, keep)


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with personal data in its text column replaced; null texts stay null, columns stay the same."""
    name = "__pii"
    while name in df.columns:
        name += "_"
    r = personal_data(df, text_col, name)
    return r.select(*[F.when(col(c).isNotNull(), F.col(f"{name}.redacted")).alias(c) if c == text_col else col(c) for c in df.columns])


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    r = personal_data(docs, digests=True, keep=["doc_id"])
    return r.select("doc_id", *[f"pii.{c}" for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans")])

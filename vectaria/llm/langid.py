"""Language identification of mixed-language texts: script ranges, then Viterbi over words.

Every word gets a score for each learned language, the sum of the log-probabilities of its
hashed three-byte windows (with the separators at its ends). The scripts of a word's letters
narrow its candidates to the languages that use the script in the training texts. Viterbi
with a penalty for each switch labels the words of a text; equal-label neighbours are spans.
The prediction of a text is the language with most letters, its score their share.

Training counts come from at most about ``SAMPLE`` labelled texts of each language, chosen by a
hash of the text id; a language with fewer keeps all its texts. What reaches the driver is
bounded by languages times buckets. Ties between languages go to the one that sorts first. Null texts and texts without any letter are ``und``
with score 0. Whole texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectaria.functions.kernels import on_workers
from vectaria.llm.pretokens import LETTER, classes, code_points
from vectaria.llm.textbatch import LOWER, TextBatch, WHITE, annotate, col, in_slices, slices

#: Bound on the labelled texts of a language that a model is fitted on (expected number; they are hashed).
SAMPLE = 20_000
BUCKETS = 1 << 15
SWITCH = 12.0
#: Share of a language's letters below which it is held not to use a script.
RARE_SCRIPT = 0.001
#: Script ranges by first code point; each reaches to the next.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"),
    (0x3100, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0x20000, "han"),
)
SCRIPT_NAMES = sorted({s for _, s in SCRIPTS})
_range_start = np.array([a for a, _ in SCRIPTS])
_range_script = np.array([SCRIPT_NAMES.index(s) for _, s in SCRIPTS])
_LATIN = SCRIPT_NAMES.index("latin")

# digits count as one sign, white space as one separator
_FOLD = LOWER.copy()
_FOLD[ord("0") : ord("9") + 1] = ord("0")
_FOLD[WHITE] = 0x20


def windows(b: TextBatch) -> np.ndarray:
    """Bucket of the three-byte window that starts at each byte."""
    d = _FOLD[b.data].astype(np.uint32)
    key = np.zeros(len(d), np.uint32)
    key[:-2] = d[:-2] << 16 | d[1:-1] << 8 | d[2:]
    return (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15)


def letters(b: TextBatch) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes start a letter, and the script of each byte's character."""
    lead = (b.data & 0xC0) != 0x80
    script = np.full(len(b.data), _LATIN, np.int8)
    at, point, _ = code_points(b.data)
    if len(at):
        script[at] = _range_script[np.searchsorted(_range_start, point, "right") - 1]
    return lead & (classes(b.data) == LETTER), script


def _counts(source: DataFrame, n_langs: int) -> DataFrame:
    """(kind, lang, item, n) of a training table (lang index, text): windows (kind 0), letters by script (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = np.zeros((n_langs, BUCKETS), np.int64)
        script = np.zeros((n_langs, len(SCRIPT_NAMES)), np.int64)
        for batch in batches:
            lang = np.asarray(batch.column(0))
            for a, z in slices(batch.column(1)):
                b = TextBatch(batch.column(1).slice(a, z - a))
                key = windows(b)
                letter, used = letters(b)
                start, stop = b.words
                # windows of words: from the separator before the word to its last byte but one
                inside = np.zeros(len(b.data) + 1, np.int8)
                inside[start - 1] += 1
                inside[stop - 1] -= 1
                inside = np.cumsum(inside[:-1]) > 0
                own = np.repeat(lang[a:z], b.end - b.beg + 1)
                own = np.append(own, 0)
                at = np.flatnonzero(inside)
                grams += np.bincount(own[at] * BUCKETS + key[at], minlength=grams.size).reshape(grams.shape)
                at = np.flatnonzero(letter)
                doc = np.searchsorted(b.beg, at, "right") - 1
                script += np.bincount(lang[a:z][doc] * len(SCRIPT_NAMES) + used[at], minlength=script.size).reshape(script.shape)
        for kind, table in ((0, grams), (1, script)):
            lang, item = np.nonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lang), kind, np.int32)), pa.array(lang.astype(np.int32)), pa.array(item.astype(np.int32)), pa.array(table[lang, item])], names=["kind", "lang", "item", "n"])

    return source.mapInArrow(run, "kind int, lang int, item int, n bigint").groupBy("kind", "lang", "item").agg(F.sum("n").alias("n"))


class Model:
    """langs in sorted order; gram[bucket, lang] log-probabilities; uses[script, lang]."""

    def __init__(self, langs: list[str], gram: np.ndarray, uses: np.ndarray):
        self.langs, self.gram, self.uses = langs, gram, uses


def fit(df: DataFrame, text_col: str, lang_col: str, id_col: str, sample: int = SAMPLE) -> Model:
    """Fits on about ``sample`` rows of each non-null language, or all if it has fewer."""
    on_workers(df.sparkSession)
    labelled = df.where(col(lang_col).isNotNull() & col(text_col).isNotNull())
    found = labelled.groupBy(col(lang_col).alias("lang")).count().collect()
    langs = sorted(r["lang"] for r in found)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPT_NAMES), 0), bool))
    keep = labelled
    share = {r["lang"]: int(sample / r["count"] * (1 << 20)) for r in found if r["count"] > sample}
    if share:
        most = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])[col(lang_col)]
        keep = labelled.where(F.pmod(F.xxhash64(col(id_col)), F.lit(1 << 20)) < F.coalesce(most, F.lit(1 << 20)))
    index = F.create_map(*[F.lit(x) for i, lang in enumerate(langs) for x in (lang, i)])
    rows = _counts(keep.select(index[col(lang_col)].alias("lang"), col(text_col).alias("text")), len(langs)).collect()
    grams, script = np.full((BUCKETS, len(langs)), 0.5), np.zeros((len(SCRIPT_NAMES), len(langs)))
    for kind, lang, item, n in rows:
        (script if kind else grams)[item, lang] += n
    gram = np.log(grams / grams.sum(0)).astype(np.float32)
    return Model(langs, gram, script > RARE_SCRIPT * np.maximum(script.sum(0), 1))


def word_scores(b: TextBatch, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Score of each word in each language, and its number of letters."""
    start, stop = b.words
    key = windows(b)
    scores = np.empty((len(start), len(model.langs)), np.float32)
    for k in range(len(model.langs)):
        total = np.concatenate([[0.0], np.cumsum(model.gram[:, k][key], dtype=np.float64)])
        scores[:, k] = total[stop - 1] - total[start - 1]
    letter, script = letters(b)
    total = np.concatenate([[0], np.cumsum(letter, dtype=np.int64)])
    n_letters = total[stop] - total[start]
    # candidates: languages that use every script found in the word, if there are any
    found = np.unique(script[letter])
    if not (len(found) == 1 and model.uses[found[0]].all()):
        allowed = np.ones(scores.shape, bool)
        for s in found.tolist():
            total = np.concatenate([[0], np.cumsum(letter & (script == s), dtype=np.int64)])
            has = total[stop] > total[start]
            allowed[has] &= model.uses[s]
        some = allowed.any(1)
        scores[some] = np.where(allowed[some], scores[some], -1e4)
    return scores, n_letters


def viterbi(scores: np.ndarray, bounds: np.ndarray, switch: float) -> np.ndarray:
    """Label of each word; all texts of the slice advance together, word by word."""
    n_words, n_langs = scores.shape
    label = np.zeros(n_words, np.int32)
    if not n_words:
        return label
    size = np.diff(bounds)
    by = np.argsort(-size, kind="stable")
    by = by[size[by] > 0]
    begin, size = bounds[:-1][by], size[by]
    best = scores[begin].astype(np.float64)
    stay = np.ones((n_words, n_langs), bool)
    jump = np.zeros(n_words, np.int32)
    active = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")
    for t in range(1, int(size[0])):
        m = active[t]
        here = best[:m]
        top = here.argmax(1)
        moved = here[np.arange(m), top][:, None] - switch
        at = begin[:m] + t
        keep = here >= moved
        stay[at] = keep
        jump[at] = top
        best[:m] = np.where(keep, here, moved) + scores[at]
    now = best.argmax(1)
    for t in range(int(size[0]) - 1, -1, -1):
        m = active[t]
        at = begin[:m] + t
        label[at] = now[:m]
        if t:
            now[:m] = np.where(stay[at, now[:m]], now[:m], jump[at])
    return label


SPANS = "lang string, score double, spans array<struct<lang: string, first_word: bigint, last_word: bigint>>"
SUMMARY = "lang string, score double"


def _slice(texts: pa.Array, model: Model, switch: float, spans: bool) -> list:
    b = TextBatch(texts)
    n_langs = len(model.langs)
    share = np.zeros((b.n, max(n_langs, 1)))
    label = np.zeros(0, np.int32)
    if n_langs:
        scores, n_letters = word_scores(b, model)
        label = viterbi(scores, b.word_bounds, switch)
        share += np.bincount(b.word_doc * n_langs + label, weights=n_letters, minlength=share.size).reshape(share.shape)
    total = share.sum(1)
    best = share.argmax(1)
    score = share[np.arange(b.n), best] / np.maximum(total, 1)
    lang = [model.langs[k] if n > 0 else "und" for k, n in zip(best.tolist(), total.tolist(), strict=True)]
    out = [pa.array(lang, pa.string()), pa.array(np.where(total > 0, score, 0.0))]
    if spans:
        doc, bounds = b.word_doc, b.word_bounds
        cut = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])])) if len(label) else np.zeros(0, np.int64)
        last = np.append(cut[1:], len(label)) - 1 if len(cut) else cut
        first = bounds[doc[cut]]
        rows: list[list[dict]] = [[] for _ in range(b.n)]
        for d, k, i, j in zip(doc[cut].tolist(), label[cut].tolist(), (cut - first).tolist(), (last - first).tolist(), strict=True):
            rows[d].append({"lang": model.langs[k], "first_word": i, "last_word": j})
        out.append(pa.array(rows, pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64())]))))
    return out


def identify(df: DataFrame, model: Model, text_col: str = "text", name: str = "language", *, switch: float = SWITCH, spans: bool = True, keep: list[str] | None = None) -> DataFrame:
    """``df`` with a struct column: language and score of each text, and its spans of words."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def compute(texts: pa.Array) -> list:
        return in_slices(texts, lambda part: _slice(part, shared.value, switch, spans), 4 << 20)

    return annotate(df, text_col, name, SPANS if spans else SUMMARY, compute, keep)


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = fit(docs.where(~held_out), "text", "lang", "doc_id")
    r = identify(docs.drop("lang"), model, spans=False, keep=["doc_id"])
    return r.select("doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score")

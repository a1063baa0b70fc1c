"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

Statistics of each whole text are transformed to be nearly normal (logarithms of counts and
smoothed rates). Class means and covariances come from sums over all labelled rows, added up
in Spark, so the driver gets a fixed number of values. Covariances shrink towards the pooled
covariance and towards its diagonal (``SHRINK``, ``RIDGE``); their Cholesky factors are kept.
The score is the logistic of the difference of the Mahalanobis log-densities and log priors.

Null and empty texts have statistics of zero words and get a score like any other text. Label
rows with a null label or without a document are left out of the fit; if a class has no
row, every score is the smoothed share of label 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectaria.functions.state import durable
from vectaria.llm.textbatch import TextBatch, annotate, col, in_slices, repeats_earlier

#: Weights of the pooled covariance and of its diagonal in a class covariance.
SHRINK = 0.5
RIDGE = 0.2
THRESHOLD = 0.3
#: Largest absolute score before the logistic, so that scores stay inside 0 to 1.
LIMIT = 30.0
STATISTICS = (
    "words", "word_size", "symbols", "upper", "digits", "exclaims", "stops", "above_ascii",
    "dup_lines", "repeats", "distinct", "line_size", "entropy", "long_words",
)
SIZE = len(STATISTICS)

_KIND = np.zeros((5, 256), bool)
_KIND[0, list(b"#*$%&|<>")] = True
_KIND[1, ord("A") : ord("Z") + 1] = True
_KIND[2, ord("0") : ord("9") + 1] = True
_KIND[3, list(b"!?")] = True
_KIND[4, list(b".,;:")] = True


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of transformed statistics per text, in the order of STATISTICS."""
    b = TextBatch(texts)
    start, stop = b.words
    doc, hashed = b.word_doc, b.hasher(lower=True)
    n = np.diff(b.word_bounds).astype(float)
    byte_doc = np.repeat(np.arange(b.n), b.end - b.beg)
    hist = np.bincount(byte_doc * 256 + b.raw, minlength=b.n * 256).reshape(b.n, 256)[: b.n]
    total = hist.sum(1)
    rate = lambda x, of: np.log((x + 0.5) / (of + 20.0))
    kinds = [hist[:, k].sum(1) for k in _KIND]
    word = hashed(start, stop)
    earlier, _ = repeats_earlier(doc, word)
    breaks = np.flatnonzero(b.data == 10)
    begun, ended = breaks[:-1] + 1, breaks[1:]
    filled = np.searchsorted(start, ended) > np.searchsorted(start, begun)
    begun, ended = begun[filled], ended[filled]
    line_doc = np.searchsorted(b.beg, begun, "right") - 1
    again, _ = repeats_earlier(line_doc, hashed(begun, ended))
    lines = np.bincount(line_doc, minlength=b.n).astype(float)
    pairs = np.flatnonzero(doc[1:] == doc[:-1])
    twice, _ = repeats_earlier(doc[pairs], word[pairs] * np.uint64(3) + word[pairs + 1] * np.uint64(5)) if len(pairs) else (np.zeros(0, bool), None)
    share = hist / np.maximum(total, 1)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = -np.where(share > 0, share * np.log(share), 0).sum(1)
    chars = b.per_text(~b.white)
    return np.stack(
        [
            np.log1p(n),
            np.log1p(chars / np.maximum(n, 1)),
            rate(kinds[0], total),
            rate(kinds[1], total),
            rate(kinds[2], total),
            rate(kinds[3], total),
            rate(kinds[4], total),
            rate(hist[:, 128:].sum(1), total),
            np.log((np.bincount(line_doc[again], minlength=b.n) + 0.5) / (lines + 1)),
            np.log((np.bincount(doc[pairs][twice], minlength=b.n) + 0.5) / (n + 1)),
            np.log((n - b.per_text_words(earlier) + 1) / (n + 1)),
            np.log1p(total / np.maximum(lines, 1)),
            entropy,
            rate(b.per_text_words(stop - start > 15), n),
        ],
        1,
    )


def features(df: DataFrame, text_col: str = "text", name: str = "statistics", keep: list[str] | None = None) -> DataFrame:
    """``df`` with an array column of the statistics of each text."""

    def compute(texts: pa.Array) -> list:
        def part(t: pa.Array) -> list:
            x = statistics(t)
            return [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, SIZE, dtype=np.int32)), pa.array(x.ravel()))]

        return in_slices(texts, part)

    r = annotate(df, text_col, name, "x array<double>", compute, keep)
    return r.withColumn(name, F.col(f"`{name}`.x"))


class Discriminant:
    """Class means, inverse Cholesky factors, log-determinants and log priors."""

    def __init__(self, prior: np.ndarray, mean: np.ndarray, factor: np.ndarray, log_det: np.ndarray):
        self.prior, self.mean, self.factor, self.log_det = prior, mean, factor, log_det

    def margin(self, x: np.ndarray) -> np.ndarray:
        if not len(self.mean):
            return np.full(len(x), self.prior[1] - self.prior[0])
        log = []
        for c in (0, 1):
            z = (x - self.mean[c]) @ self.factor[c].T
            log.append(self.prior[c] - 0.5 * (self.log_det[c] + (z * z).sum(1)))
        return log[1] - log[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -LIMIT, LIMIT)))


def fit(rows: DataFrame, x: str = "statistics", label: str = "label", shrink: float = SHRINK, ridge: float = RIDGE) -> Discriminant:
    """Fits on all rows whose label is 0 or 1."""
    rows = rows.where(F.col(label).isin(0, 1)).select(F.col(label).cast("int"), F.col(x))
    width = 1 + SIZE + SIZE * SIZE

    def sums(batches):
        total = np.zeros((2, width))
        for batch in batches:
            own = np.asarray(batch.column(0))
            values = np.asarray(batch.column(1).flatten()).reshape(-1, SIZE)
            for c in (0, 1):
                v = values[own == c]
                total[c] += np.concatenate([[len(v)], v.sum(0), (v.T @ v).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], width)), pa.array(np.tile(np.arange(width), 2)), pa.array(total.ravel())], names=["label", "at", "total"])

    added = rows.mapInArrow(sums, "label bigint, at bigint, total double").groupBy("label", "at").agg(F.sum("total").alias("total"))
    got = np.zeros((2, width))
    for c, at, total in added.collect():
        got[c, at] = total
    n = got[:, 0]
    prior = np.log((n + 1) / (n.sum() + 2))
    if not n.all():
        return Discriminant(prior, np.zeros((0, SIZE)), np.zeros((0, SIZE, SIZE)), np.zeros(2))
    mean = got[:, 1 : 1 + SIZE] / n[:, None]
    cov = got[:, 1 + SIZE :].reshape(2, SIZE, SIZE) / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    pooled = (n[:, None, None] * cov).sum(0) / n.sum()
    floor = np.diag(np.maximum(np.diag(pooled), 1e-4))
    factor, log_det = np.zeros_like(cov), np.zeros(2)
    for c in (0, 1):
        own = (1 - shrink) * cov[c] + shrink * pooled
        low = np.linalg.cholesky((1 - ridge) * own + ridge * floor)
        factor[c], log_det[c] = np.linalg.inv(low), 2 * np.log(np.diag(low)).sum()
    return Discriminant(prior, mean, factor, log_det)


def classify(df: DataFrame, model: Discriminant, x: str = "statistics", name: str = "score") -> DataFrame:
    """``df`` with the score of each row's statistics."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    from pyspark.sql import types as T

    keep = [c for c in df.columns if c != name]
    source = df.select(*map(col, keep))
    at = keep.index(x)

    def run(batches):
        for batch in batches:
            values = np.asarray(batch.column(at).flatten()).reshape(-1, SIZE)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.score(values))], names=[*batch.schema.names, name])

    return source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField(name, T.DoubleType())]))


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    x = durable(features(docs, keep=["doc_id"]))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = fit(x.where(~held_out).join(labels, "doc_id"))
    scored = classify(x, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

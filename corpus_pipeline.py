"""A training-corpus pipeline over ``documents``, one operator a stage.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns
the columns of ``documents``; the last adds ``n_tokens``, ``ids`` and ``round_trip`` (columns of
these names are replaced). Rows with a null id are never dropped by the near-duplicate stage;
rows that repeat an id are one document there, so all its rows stay or go. A text that is null
or empty goes in the first stage. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectaria.functions.state import Scratch
from vectaria.llm import bpe, decontaminate, pii, repetition, setsketch
from vectaria.llm.textbatch import col

#: Words of a shingle in the near-duplicate stage; documents of similarity 0.8 or more are one group.
SHINGLE = 5
RANKS = "byte_bpe_multi_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules pass."""
    return repetition.keep_clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates."""
    gone = setsketch.near_duplicates(docs, shingle=SHINGLE).where(~F.col("kept")).select(F.col("id").alias("doc_id"))
    gone = Scratch(spark, "pipeline-copies").write("gone", gone)
    # few ids go to all tasks, so that texts aren't shuffled
    few = gone.count() <= setsketch.BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*map(col, docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.keep_uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced and n_chars set to the new length."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*map(col, docs.columns)) if "n_chars" in docs.columns else out


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids, number of tokens and decoded text's agreement."""
    keep = [c for c in docs.columns if c not in ("n_tokens", "ids", "round_trip")]
    name = "__bpe"
    while name in keep:
        name += "_"
    out, ids = bpe.bpe(docs, name=name, ranks=public_tokenizers.path(RANKS), keep=keep), F.col(f"{name}.ids")
    return out.select(*map(col, keep), F.size(ids).cast("long").alias("n_tokens"), ids.alias("ids"), (F.col(f"{name}.decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("PII", redaction),
    ("byte-level BPE encoding and decoding", encoding),
]

#: Suffix arrays aside, SQL can express neither sketches, alignments, boosted trees nor merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; each but the last is written to the shared folder and read again."""
    docs, tables, former = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = tables.write(f"stage-{k}", docs)
            if former:
                tables.drop(former)
            former = f"stage-{k}"
    return docs

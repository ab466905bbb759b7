"""A training corpus from raw documents: five stages over everything that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the shared folder and reads
again for the next; the table before it is deleted then. All but the last return the columns of documents.

A null text counts as empty in every stage. Rows with null ids are documents like others, but give no labels. Columns beside
doc_id and text are handed on as they are, whatever their names and nulls. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklattice.llm._util import Scratch, read
from ticklattice.llm.bpe_codec import bpe_codec
from ticklattice.llm.decontam import matches
from ticklattice.llm.quality import fit_quality, score_quality
from ticklattice.llm.simhash import keep_distinct
from ticklattice.llm.toxicity import fit_toxicity, score_toxicity


def _apart(docs: DataFrame, stage: Callable[[DataFrame], DataFrame], *made: str) -> DataFrame:
    """The columns of docs in the rows that stage(docs) keeps; those named like one that it makes are put aside meanwhile."""
    names = {c: f"__own_{i}" if c.lower() in made else c for i, c in enumerate(docs.columns)}
    return stage(docs.withColumnsRenamed(names)).select(*[F.col(f"`{b}`").alias(a) for a, b in names.items()])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more. Empty texts are scored like others; repeated rows share their score; without
    labels every score is 0.5, so all stay."""
    model = fit_quality(docs, read(spark, sf_dir, "labels"))
    return _apart(docs, lambda d: score_quality(d, model, keep=d.columns).where("predicted = 1"), "score", "predicted")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5. Empty texts hold no evidence and stay; repeated rows share their score;
    without labels of both kinds no text has evidence, and all stay."""
    model = fit_toxicity(docs, read(spark, sf_dir, "labels"))
    return _apart(docs, lambda d: score_toxicity(d, model, keep=d.columns).where("predicted = 0"), "score", "predicted")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies (five-word shingles, similarity 0.8 or more). Texts
    without words are one group; of repeated rows one stays; null ids come after all others."""
    return keep_distinct(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item. Empty texts hold none; repeated rows share their fate; without a
    benchmark all stay."""
    benchmark = read(spark, sf_dir, "benchmark")
    return _apart(docs, lambda d: matches(d, benchmark, keep=d.columns).where(F.size("leaks") == 0), "leaks")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's id, token ids, their number and digest, and the digest of what they decode to. An empty text has no ids
    and the digests of nothing; repeated rows repeat their result."""
    return bpe_codec(
        docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, output=("n_tokens", "ids", "ids_sha256", "decoded_sha256")
    )


STAGES = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encode", encode),
]

#: SQL can't express the learned stages; tests hold each stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = read(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES:
        before, docs = docs, scratch.table(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
    return docs

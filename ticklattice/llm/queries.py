"""The operators applied to whole tables, one query opN_<name> for each."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklattice.llm._util import held_out, read
from ticklattice.llm.bpe_codec import bpe_codec
from ticklattice.llm.decontam import matches
from ticklattice.llm.html_text import extract_html
from ticklattice.llm.id_records import new_output, read_index, write_id_records
from ticklattice.llm.licenses import scan_licenses
from ticklattice.llm.quality import fit_quality, score_quality
from ticklattice.llm.simhash import near_duplicates
from ticklattice.llm.token_counts import token_counts
from ticklattice.llm.toxicity import fit_toxicity, score_toxicity
from ticklattice.llm.winnow import edited_likeness


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score_quality(docs, fit_quality(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(read(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.where(F.size("leaks") > 0).select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.*")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_html(read(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit_toxicity(docs, read(spark, sf_dir, "labels")), with_passages=True)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted", "passages")


def op10_id_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_output(spark)
    write_id_records(read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_index(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_license_scan, op3_simhash_dedup, op4_bpe_codec, op5_quality, op6_winnowing, op7_decontamination,
        op8_html_text, op9_toxicity, op10_id_records, pipeline,
    )
}

#: DuckDB SQL of the queries that SQL can express over whole tables.
ORACLES: dict[str, str] = {}

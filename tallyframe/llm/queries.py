"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import decontaminate, licenses, line_dedup, page_text, personal_data, piece_codec, quality_model, quality_rules, simhash, source_mix, token_alignment, \
    token_files, whitening
from .common import load, scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_dir(spark, "token-files")
    token_files.write_token_files(load(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), out, end_id=1)
    return token_files.read_digests(spark, out)


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(load(spark, sf_dir, "documents"))


@query
def op3_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(load(spark, sf_dir, "documents"))


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


@query
def op5_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract(load(spark, sf_dir, "pages"))


@query
def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find(load(spark, sf_dir, "documents"))


@query
def op7_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@query
def op8_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digests(load(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


@query
def op9_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(load(spark, sf_dir, "documents")).drop("places")


@query
def op10_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return token_alignment.Alignment(docs, tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")).documents()


@query
def op12_cholesky_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(load(spark, sf_dir, "embeddings"), top=32)


@query
def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.Mix(load(spark, sf_dir, "documents")).taken()


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL

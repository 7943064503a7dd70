"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

Every stage but the last returns the columns of documents. Rejected documents go in stage 1; stage 2 keeps
the first of each near-duplicate group (five words, similarity 0.8); stage 3 replaces secrets in the texts;
stage 4 repeats or leaves out documents to meet the sources' targets; stage 5 encodes and decodes all texts.

Defined results, of every stage: an empty table gives an empty one; further columns stay, whatever their names, but
in the last stage; very long texts are taken whole. What a stage does with nulls, empty texts, ties and repeated
rows stands with it.
"""

from __future__ import annotations

import functools
import threading

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm import bpe, mixing, near_dedup, quality, secret_scan
from chronoweave.llm.shared import fresh_path, recording, remove, ship

RANKS = "byte_bpe_50k.tiktoken"



class _Scratch(threading.local):
    """Tables that this thread's last stage wrote for itself. Its result is on disk when the next begins, so they go then."""

    def __init__(self):
        self.paths: list[str] = []


_scratch = _Scratch()


def _stage(f):
    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove(spark, _scratch.paths)
        with recording(_scratch.paths):
            return f(spark, docs, sf_dir)

    return run_stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents that fail the base rule or whose posterior quality is under one half.

    Null and empty texts fail the base rule; a posterior of one half stays; repeated rows stay or go together.
    """
    return quality.keep_good(docs)


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of every group of near-duplicates the document with the least id.

    Null and empty texts, and rows of a null id, stay; rows of one id stay or go together.
    """
    ship(spark)
    return near_dedup.drop_near_duplicates(docs, words=5, percent=80)


@_stage
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the texts by a mark; n_chars follows the new text.

    Null and empty texts stay; overlapping secrets become one mark; equal texts become equal.
    """
    out = secret_scan.redact(docs)
    return out.withColumn("n_chars", F.when(out["text"].isNotNull() & out["n_chars"].isNotNull(), F.length("text").cast("long"))) if "n_chars" in docs.columns else out


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that every source's words come near its target.

    Null texts have no words and follow their source's rate; the null source ranks last; rows equal in id and text
    are taken equally often.
    """
    return mixing.mix(docs)


@_stage
def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, and whether they decode to it: doc_id, source, ids, n_tokens, round_trip.

    Null and empty texts have no ids; equal texts, repeated rows among them, have equal ids.
    """
    ship(spark)
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    ids = bpe.encode(docs.select("doc_id", "source", "text"), path, pattern, decoded="decoded")
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return ids.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("source_mixing", mix_sources),
    ("bpe_codec", encode_bpe),
]

#: The stages estimate, hash and merge; SQL cannot express them. tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's table goes when the next one's is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last: list[str] = []
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        remove(spark, last)
        last.append(path)
    return STAGES[-1][1](spark, docs, sf_dir)

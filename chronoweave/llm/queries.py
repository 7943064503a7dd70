"""The queries of this subpackage: each applies one operator to the whole of documents."""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, kneser_ney, mixing, mpeg, oracle, pii, quality, secret_scan, sharding, token_files
from .near_dedup import near_duplicates
from .shared import fresh_path, ship


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _key(spark: SparkSession) -> bytes:
    """The session's chronoweave.pii.key; where it is unset, one drawn at random for the session."""
    name = "chronoweave.pii.key"
    if not spark.conf.get(name, ""):
        spark.conf.set(name, secrets.token_hex(32))
    return spark.conf.get(name).encode()


def _count(spans: str, kind: str | int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of five-word shingles at 85 percent. Null, empty and wordless texts have 0 shingles and are kept;
    repeated rows and copies share the least id as component; very long texts count whole; no rows give no rows."""
    return near_duplicates(_documents(spark, sf_dir), percent=85)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all texts, read back. Null and empty texts are the end id alone; rows of one id stand in the order
    of their texts' checksums; a text longer than an image has its own; no rows give no rows."""
    path = fresh_path(spark, "tokens")
    token_files.write_tokens(_documents(spark, sf_dir).select("doc_id", "text"), path, _public("byte_bpe_50k.json"), end_id=2)
    return token_files.read_tokens(spark, path, checksum=True).withColumnRenamed("id", "doc_id")


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram scores of all texts; those of a null id train too. Null and empty texts are one end token; equal texts have
    equal scores; very long texts are scored whole; no rows give no rows."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    docs = docs.withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    model = kneser_ney.train(docs.where("not held_out"))
    scores = [F.round(c, 6).alias(c) for c in ("base_score", "score")]  # sums of logarithms: no engine's last digits
    return kneser_ney.score(docs, model).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", *scores)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and verdict of all texts. Null and empty texts have no words and fail the base rule; a posterior
    at the threshold is kept; repeated rows have equal verdicts; very long texts count whole; no rows give no rows."""
    out = quality.judged(_documents(spark, sf_dir), keep=["doc_id"])
    counts = [F.col("__q")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return out.select("doc_id", *counts, F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"), F.round("__posterior", 6).alias("posterior"))


def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms, and how many values of each kind. Null stays null; empty and clean texts are unchanged;
    equal values have equal pseudonyms in all rows; very long texts are searched whole; no rows give no rows."""
    out = pii.pseudonymise(_documents(spark, sf_dir).select("doc_id", "text"), _key(spark))
    counts = [_count("pii", k).alias(f"n_{k}") for k in pii.KINDS]
    return out.select("doc_id", "text", *counts)


def op6_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stored as MPEG audio and read back. Null is empty, and empty is 64 zero bytes; equal texts have equal streams;
    very long texts are long streams; no rows give no rows."""
    payload = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    n = F.length(payload)
    padded = F.concat(payload, F.substring(F.lit(bytes(64)), F.lit(1), F.when(n == 0, 64).otherwise(F.pmod(-n, F.lit(64))).cast("int")))
    docs = _documents(spark, sf_dir).select("doc_id", n.cast("long").alias("n_bytes"), padded.alias("payload"))
    got = mpeg.read_column(mpeg.store_column(docs, "payload").drop("payload"))
    back = F.col("audio.payload")
    return got.select(
        "doc_id", "n_bytes", F.length(back).cast("long").alias("payload_bytes"), F.sha2(back, 256).alias("payload_sha256"), F.crc32(F.substring(back, -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.col("audio.feature").alias("feature"),
        F.col("audio.duration_s").alias("duration_s"), F.col("audio.offsets").alias("frame_offsets"),
    )


def op7_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shard and slot for every row. Null is empty; null ids come first; ties and repeated rows have places of their own;
    very long texts are one row like others; no rows give no rows."""
    out = sharding.assign(_documents(spark, sf_dir), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all texts, and what they decode to. Null and empty texts have no ids; equal texts have equal ids; very long
    texts are encoded whole; no rows give no rows."""
    ranks, pattern = _public("byte_bpe_50k.tiktoken"), _pattern()
    both = bpe.encode(_documents(spark, sf_dir).select("doc_id", "text"), ranks, pattern, decoded="decoded")
    text = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes each text. Null texts have size 0; the null source is the last one; rows equal in id and text
    share their draw; very long texts are taken whole or not; no rows give no rows."""
    return mixing.plan(_documents(spark, sf_dir)).drop("copies")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in all texts. Null and empty texts have none; equal texts have equal spans; overlapping spans of
    different kinds are all listed; very long texts are scanned whole; no rows give no rows."""
    out = secret_scan.scan(_documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", F.col("secret_spans").alias("s"))
    base = F.filter("s", lambda x: x["kind"] < 3)
    counts = [_count("s", k).alias(f"n_{secret_scan.KINDS[k]}") for k in range(3)]
    return out.select("doc_id", *counts, F.sha2(secret_scan.as_text(base), 256).alias("base_sha256"), secret_scan.as_text(F.col("s")).alias("spans"))


QUERIES = {
    f.__name__: f
    for f in (op1_near_dedup, op2_token_files, op3_kneser_ney, op4_quality_rules, op5_pii_pseudonyms, op6_mpeg_audio, op7_feistel_sharding, op8_bpe_codec, op9_source_mixing, op10_secret_scan)
}

#: op2, op5, op6 and op8 have none: vocabularies, keyed hashes and stream formats are beyond SQL. tests/llm has brute force for each.
ORACLE_SQL: dict[str, str] = {
    "op1_near_dedup": oracle.near_dedup(percent=85), "op3_kneser_ney": oracle.kneser_ney(), "op4_quality_rules": oracle.quality_rules(),
    "op7_feistel_sharding": oracle.feistel_sharding(shards=24), "op9_source_mixing": oracle.source_mixing(), "op10_secret_scan": oracle.secret_spans(),
}

"""Mixing sources to target weights: each document floor(rate) times plus one hash-seeded Bernoulli copy.

Sources in code-point order (null last) get the weights in turn; they share `percent` of all words, a
target stops at `cap` times its source's words, and the excess is shared anew by weight. A source's rate is
target / words. A document's copies are floor(rate), plus one if 52 bits of the MD5 of seed, id and text fall
under rate - floor(rate). Draws are independent, so the words taken from a source scatter about its target as
the sizes of its documents do.

Only the word counts (id, source, size, draw) are written and summed per source, never texts; the sources, a row
each, are ranked in one task.

Defined results: null text has no words; a source without words has target and rate 0; rows equal in id
and text share their draw; reruns agree; very long texts are taken whole or not; an empty table gives no rows;
other columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

WORD = r"[^\x20\x09-\x0D]+"
#: The rate table is broadcast up to this many sources and joined by shuffle beyond.
BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _draw(docs: DataFrame, id_col: str, text_col: str, seed: int) -> Column:
    """Uniform in [0, 1)."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(docs[f"`{id_col}`"].cast("string"), F.lit("")), F.lit(":"), F.coalesce(docs[f"`{text_col}`"], F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[int, ...], percent: int, cap: int) -> DataFrame:
    """(source, source_size) -> with target: the water level at which capped weights share the total."""
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    w = F.get(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights)).cast("int"))
    ranked = ranked.withColumn("w", w).withColumn("most", cap * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("w"), "rank")
    ranked = ranked.withColumn("place", F.row_number().over(order))
    whole = F.sum("source_size").over(Window.partitionBy())
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.withColumn("level", (whole * percent / 100 - before) / rest)
    fits = F.col("level") * F.col("w") <= F.col("most")
    first = F.min(F.when(fits, F.struct("place", "level"))).over(Window.partitionBy())
    ranked = ranked.withColumn("first", first)
    capped = F.col("first").isNull() | (F.col("place") < F.col("first.place"))
    return ranked.select("source", "source_size", F.when(capped, F.col("most").cast("double")).otherwise(F.col("first.level") * F.col("w")).alias("target"))


def rates(sized: DataFrame, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, cap: int = 2) -> DataFrame:
    """Per source: source_size, target, whole (copies each document gets) and part (chance of one more)."""
    by = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, percent, cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    by = by.withColumn("rate", rate).withColumn("whole", F.floor("rate").cast("int")).withColumn("part", F.col("rate") - F.floor("rate"))
    return written(by.select(F.col("source").alias("s"), "source_size", "target", "whole", "part"), "targets")


def joined(rows: DataFrame, by: DataFrame, source_col: str) -> DataFrame:
    """rows with the columns of their source; the table is broadcast if its counted size allows."""
    if by.count() <= BROADCAST_SOURCES:
        by = F.broadcast(by)
    return rows.join(by, rows[f"`{source_col}`"].eqNullSafe(by["s"])).drop("s")


def _copies() -> Column:
    return F.col("whole") + (F.col("draw") < F.col("part")).cast("int")


def measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    cols = [docs[f"`{id_col}`"].alias("id"), docs[f"`{source_col}`"].cast("string").alias("source"), n_words(docs[f"`{text_col}`"]).alias("size")]
    return written(docs.select(*cols, _draw(docs, id_col, text_col, seed).alias("draw")), "sizes")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 1, **how) -> DataFrame:
    """Per document: id, size, source_size, target, copies, taken (words the mix takes from it)."""
    sized = measured(docs, id_col, text_col, source_col, seed)
    out = joined(sized, rates(sized, **how), "source").withColumn("copies", _copies())
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 1, **how) -> DataFrame:
    """docs with every row repeated as often as the mix takes it; columns stay."""
    by = rates(measured(docs, id_col, text_col, source_col, seed), **how)
    own = docs.select(F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns]).alias("row"), docs[f"`{source_col}`"].cast("string").alias("source"), _draw(docs, id_col, text_col, seed).alias("draw"))
    out = joined(own, by, "source").withColumn("copies", _copies()).where("copies > 0")
    out = out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns])

"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows get gapless numbers in the order of id, size and checksum: a range partition sorts them, the
partitions' counts (one number each) give every partition its offset. A keyed permutation of [0, n) sends a
row's number to its place; place mod shards is the shard, place div shards the slot. So shards differ by one
row at most, slots are gapless, the shuffle is reproducible, and shard and slot follow from the number alone.

Only ids, sizes and checksums are sorted, never texts. Rounds are integer arithmetic that fits signed 64 bits, so
SQL can compute a row's shard as well. Defined results: null text is empty; null ids come first; repeated rows get
places of their own; a very long text is one row like others; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Added to the right half before each round; the key is added to them.
ROUNDS = (2654435769, 1013904242, 3668340011, 2027808484, 387276957, 3041712726)
HALF = (1 << 32) - 1
#: Multipliers and shifts of a round: products of 32 bits and these stay under 2**63, so that any engine's integers do.
STEPS = ((16, 0x45D9F3B), (15, 0x119DE1F3))


def scrambled(x: np.ndarray) -> np.ndarray:
    """A permutation of 32-bit numbers without visible structure."""
    for shift, factor in STEPS:
        x = ((x ^ (x >> shift)) * factor) & HALF
    return x ^ (x >> 16)


def permute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """The keyed permutation of [0, n) at each x: a balanced Feistel network, walked until it falls under n."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, out, todo = (1 << half) - 1, x.astype(np.int64), np.arange(len(x))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in ROUNDS:
            left, right = right, left ^ (scrambled((right + k + key) & HALF) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out


def numbered(rows: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """rows with `row_number` from 0 in the given order, and how many there are."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    placed = written(placed, "ordered")
    part = F.shiftright("__m", 33)
    counts = sorted(tuple(r) for r in placed.groupBy(part.alias("p")).count().collect())  # a number for each partition
    total, starts = 0, []
    for p, n in counts:
        starts.append((p, total))
        total += n
    offsets = F.broadcast(rows.sparkSession.createDataFrame(starts, "__p long, __o long"))
    out = placed.join(offsets, part == F.col("__p")).withColumn("row_number", F.col("__o") + F.col("__m").bitwiseAND((1 << 33) - 1))
    return out.drop("__m", "__p", "__o"), total


def assign(docs: DataFrame, shards: int, key: int = 20240229, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, size (UTF-8 bytes of the text plus 8), text_crc32, row_number, shard, slot."""
    text = F.coalesce(docs[f"`{text_col}`"].cast("string"), F.lit(""))
    rows = docs.select(docs[f"`{id_col}`"].alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows, total = numbered(rows, "id", "size", "text_crc32")

    @F.pandas_udf("long")
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(permute(x.to_numpy(), total, key))

    out = rows.withColumn("place", place("row_number"))
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "row_number", (F.col("place") % shards).cast("int").alias("shard"), F.floor(F.col("place") / shards).alias("slot"))

"""Token-id files: a concatenated id array with Elias-Fano document boundaries.

One image holds a run of documents in ascending id order:

    magic "CWEF0002" | n_docs u64 | n_ids u64 | width u8 | pad 7 | n_null u64 | least key i64
    keys of the other documents less the least one, Elias-Fano | boundaries, n_docs + 1, Elias-Fano
    ids, little-endian, width bytes each

An Elias-Fano sequence stands as: low_bits u8 | pad 7 | n_high u64 | low bits, packed | high bits in unary |
select samples u32, the place of every 256th one bit. Select finds a boundary by one short scan from a sample, or
many at once by a sum over bytes, so no 64-bit table is kept, neither of boundaries nor of document keys. Images
are rows of an uncompressed Parquet table in Spark's shared storage (shard, base within the shard, image): the
writer's commit protocol makes retried tasks safe, on any file system Spark can write, and one document is read
from one image.

Defined results: null and empty texts have the end id only; null ids come first, rows of equal id in the order of
their texts' checksums; repeated rows are documents of their own; a text longer than an image has its own; an empty
table gives an empty one; other columns are not looked at. Strings of special tokens in a text get the special
ids, as the library has it, unless special_tokens=False.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .units import WORD, units

MAGIC = b"CWEF0002"
_HEAD = struct.Struct("<8sQQB7xQq")
_SEQUENCE = struct.Struct("<B7xQ")
SAMPLE = 256
#: Ids in an image; a longer document has an image of its own.
IMAGE_IDS = 1 << 19
#: Distinct pieces whose ids a worker keeps; then it starts anew.
KEPT_UNITS = 600_000


_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(bool)
_COUNT = _ONES.sum(axis=1)
#: Place of the k-th one bit of a byte.
_PLACE = np.array([[*np.flatnonzero(bits), *[0] * (8 - bits.sum())] for bits in _ONES])


class EliasFano:
    """An ascending sequence from 0 up: one value by select, or many."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // max(1, n)).bit_length() - 1)
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, low_bits, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"), np.packbits(high, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def dump(self) -> bytes:
        return b"".join([_SEQUENCE.pack(self.low_bits, len(self.high)), self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()])

    @classmethod
    def load(cls, image: bytes, at: int, n: int) -> tuple[EliasFano, int]:
        """The sequence of n values at a place of an image, and the place behind it."""
        low_bits, n_high = _SEQUENCE.unpack_from(image, at)
        at, parts = at + _SEQUENCE.size, []
        for kind, count in (("u1", (n * low_bits + 7) // 8), ("u1", n_high), ("<u4", -(-n // SAMPLE))):
            parts.append(np.frombuffer(image, kind, count, at))
            at += parts[-1].nbytes
        return cls(n, low_bits, *parts), at

    def __getitem__(self, i: int) -> int:
        """One value: from the sample before it, count one bits to the i-th."""
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte = at >> 3
        word = int(self.high[byte]) & (0xFF << (at & 7))
        while left >= (c := word.bit_count()):
            left -= c
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        one = byte * 8 + (word & -word).bit_length() - 1
        low = 0
        for k in range(self.low_bits):
            p = i * self.low_bits + k
            low |= (int(self.low[p >> 3]) >> (p & 7) & 1) << k
        return (one - i) << self.low_bits | low

    def select(self, i: np.ndarray) -> np.ndarray:
        """Many values: one bits are summed byte by byte, and found by search."""
        before = np.concatenate(([0], np.cumsum(_COUNT[self.high])))
        byte = np.searchsorted(before, i, side="right") - 1
        one = byte * 8 + _PLACE[self.high[byte], i - before[byte]]
        values = (one - i).astype(np.uint64) << np.uint64(self.low_bits)
        for k in range(self.low_bits):
            p = i * self.low_bits + k
            values |= (self.low[p >> 3].astype(np.uint64) >> (p & 7).astype(np.uint64) & np.uint64(1)) << np.uint64(k)
        return values


def pack(keys: list[int | None], ids: list[bytes], width: int) -> bytes:
    """An image of documents, whose ids are given as bytes; null keys come first, the others ascend."""
    n_null = sum(k is None for k in keys)
    least = keys[n_null] if n_null < len(keys) else 0
    flat = b"".join(ids)
    bounds = np.concatenate(([0], np.cumsum([len(x) // width for x in ids], dtype=np.int64)))
    head = _HEAD.pack(MAGIC, len(keys), len(flat) // width, width, n_null, least)
    # Keys may span more than 63 bits: their differences are taken modulo 2**64.
    return b"".join([head, EliasFano.of(np.array(keys[n_null:], np.int64).astype(np.uint64) - np.uint64(least % (1 << 64))).dump(), EliasFano.of(bounds).dump(), flat])


class Image:
    """A packed image, of which only what is asked for is decoded."""

    def __init__(self, image: bytes):
        magic, self.n, n_ids, width, self.n_null, self.least = _HEAD.unpack_from(image)
        if magic != MAGIC:
            raise ValueError("not a token-id image")
        self.keys_, at = EliasFano.load(image, _HEAD.size, self.n - self.n_null)
        self.bounds, at = EliasFano.load(image, at, self.n + 1)
        self.ids = np.frombuffer(image, f"<u{width}", n_ids, at)

    def keys(self) -> pa.Array:
        values = self.keys_.select(np.arange(self.n - self.n_null)) + np.uint64(self.least % (1 << 64))
        return pa.concat_arrays([pa.nulls(self.n_null, pa.int64()), pa.array(values.view(np.int64))])

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document."""
        return self.ids[self.bounds[i] : self.bounds[i + 1]]


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves."""
    out, n = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out[b] = chr(b)
        else:
            out[b] = chr(n)
            n += 1
    return out


_LETTERS = _byte_letters()


class Encoder(dict):
    """Pieces of text to their ids' bytes, by the tokenizers library; a piece goes through it once while it is kept.

    A word of letters is one pre-token, which the library's model takes without its splitting; marks that
    follow it are pre-tokens of their own. All else goes through the library's whole pipeline.
    """

    def __init__(self, path: str, special_tokens: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not special_tokens
        kinds = json.loads(self.library.to_str())
        #: Strings that the library finds before it cuts anything; a text that has one goes through it whole.
        self.whole = [t["content"] for t in kinds["added_tokens"] if special_tokens or not t["special"]]
        step = kinds["pre_tokenizer"] or {}
        self.plain = kinds["normalizer"] is None and step.get("type") == "ByteLevel" and not step.get("add_prefix_space") and step.get("use_regex", True)
        self.model = self.library.model
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"

    def __missing__(self, piece: str) -> bytes:
        m = WORD.fullmatch(piece) if self.plain else None
        if m is None:
            ids = array(self.code, self.library.encode(piece, add_special_tokens=False).ids)
        elif m[2]:
            ids = self[m[1]] + self[m[2]]
        else:
            ids = array(self.code, [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(_LETTERS))])
        if len(self) >= KEPT_UNITS:
            self.clear()
        self[piece] = ids = ids if isinstance(ids, bytes) else ids.tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, little-endian, width bytes each."""
        if any(w in text for w in self.whole):
            return array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, units(text)))


@lru_cache(maxsize=2)
def encoder(path: str, special_tokens: bool = True) -> Encoder:
    return Encoder(path, special_tokens)


def _images(batches: Iterator[pa.RecordBatch], path: str, end_id: int, special_tokens: bool):
    pieces, shard = encoder(path, special_tokens), TaskContext.get().partitionId()
    base, keys, held, n = 0, [], [], 0
    end = end_id.to_bytes(pieces.width, "little")
    names = ["shard", "base", "n_docs", "n_ids", "image"]

    def image():
        row = [[shard], [base], [len(keys)], [n], [pack(keys, held, pieces.width)]]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names)

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = pieces.encode(text.as_py() or "") + end
            if held and n + len(ids) // pieces.width > IMAGE_IDS:
                yield image()
                base, keys, held, n = base + n, [], [], 0
            keys.append(key)
            held.append(ids)
            n += len(ids) // pieces.width
    if held:
        yield image()


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", special_tokens: bool = True) -> None:
    """Writes the ids of all texts, each with end_id, in ascending id order (nulls first, ties by checksum).

    Null texts are empty. The ids of docs must be integers. One shuffle, the range partition by id.
    """
    text = docs[f"`{text_col}`"].cast("string")
    rows = docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), text.alias("text")).repartitionByRange("id")
    rows = rows.sortWithinPartitions("id", F.crc32(F.coalesce("text", F.lit(""))))
    images = rows.mapInArrow(partial(_images, path=tokenizer, end_id=end_id, special_tokens=special_tokens), "shard int, base long, n_docs long, n_ids long, image binary")
    images.write.option("compression", "uncompressed").option("parquet.block.size", str(4 << 20)).parquet(path)


def _documents(batches: Iterator[pa.RecordBatch], checksum: bool):
    names = ["id", "start", "n_tokens", "ids_crc32" if checksum else "ids"]
    for batch in batches:
        for base, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            image = Image(raw.as_py())
            at = image.bounds.select(np.arange(image.n + 1)).astype(np.int64)
            if checksum:
                wide = memoryview(image.ids.astype("<u4")).cast("B")
                last = pa.array([zlib.crc32(wide[4 * b : 4 * e]) for b, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.int64())
            else:
                last = pa.ListArray.from_arrays(at.astype(np.int32), pa.array(image.ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([image.keys(), pa.array(at[:-1] + base), pa.array(np.diff(at)), last], names)


_IMAGES = "shard int, base long, n_docs long, n_ids long, image binary"


def read_tokens(spark: SparkSession, path: str, checksum: bool = False) -> DataFrame:
    """Per document, from the files: id, start (ids of all documents before it), n_tokens and ids.

    With checksum, instead of the ids, ids_crc32: the unsigned crc32 of them as little-endian unsigned 32-bit integers.
    """
    images = spark.read.schema(_IMAGES).parquet(path)
    total, starts = 0, []
    for shard, n in sorted(tuple(r) for r in images.groupBy("shard").agg(F.sum("n_ids")).collect()):  # a number for each file
        starts.append((shard, total))
        total += n
    offsets = F.broadcast(spark.createDataFrame(starts, "shard int, first long"))
    rows = images.join(offsets, "shard").select((F.col("first") + F.col("base")).alias("base"), "image")
    last = "ids_crc32 long" if checksum else "ids array<int>"
    return rows.mapInArrow(partial(_documents, checksum=checksum), f"id long, start long, n_tokens long, {last}")


def read_document(spark: SparkSession, path: str, i: int) -> list[int]:
    """The ids of the i-th document in the order of ids, by select, from the one image that has it."""
    images = spark.read.schema(_IMAGES).parquet(path)
    left = i
    for shard, n in sorted(tuple(r) for r in images.groupBy("shard").agg(F.sum("n_docs")).collect()):  # a number for each file
        if left < n:
            break
        left -= n
    else:
        raise IndexError(f"no document {i}")
    here = images.where(F.col("shard") == shard)
    before = F.sum("n_docs").over(Window.orderBy("base").rowsBetween(Window.unboundedPreceding, -1))
    of = here.select("base", "n_docs", F.coalesce(before, F.lit(0)).alias("first")).where((F.col("first") <= left) & (left < F.col("first") + F.col("n_docs"))).first()
    image = Image(bytes(here.where(F.col("base") == of["base"]).select("image").first()["image"]))
    return image.document(left - of["first"]).tolist()

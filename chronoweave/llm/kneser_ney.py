"""Interpolated modified Kneser-Ney n-grams (trigrams, or bigrams): counted in Spark, kept as sorted hash arrays,
memory-mapped by workers.

A token is a word (A-Z lowered) or the end of a text. Words first get numbers: their 64-bit hashes lie sorted in
the words files, and a number is a place there, so that n-grams pack well. Then every task counts the n-grams
(u, v, w) of some 2 million tokens at a time and deals them to parts by the middle word v: all that belongs to the
context (u, v) and to the pair (v, w) meets in one part. A middle word with more tokens than an eighth of a part
has a grid of cells, by u and by w, over the parts; what its cells know of a pair is summed in a second
aggregation, and what all know of a word in a third. Bigrams are n-grams with the empty middle, the same for all.

    p(w|uv) = (c(uvw) - D3) / c(uv) + l(uv) p(w|v)
    p(w|v)  = (n(vw) - D2) / n(v)   + l(v) p(w)        n(vw): distinct words before vw
    p(w)    = (n(w) - D1) / pairs   + l / (V + 1)      n(w): distinct words before w

Before a text stand as many begin marks as a context has words. Of an n-gram's hash a file keeps 32 bits in
buckets of some 4 (about 50 bits for a file of a million, so a false hit in 10^9); contexts seen once need no
entry: a context is known if it is a known pair. The files lie in the shared folder, which workers must see as a
file system (file://, a network mount): they are mapped, and the page cache holds what is used. Every part
writes its files even if they are empty: a missing one is an error, never a count of 0.

Defined results: null and empty texts are one end token; without training rows every token is unknown and p is
1; equal texts have equal scores; repeated rows count as often as they stand; a very long text is counted and
hashed in slices. Other columns stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mapped import by_part, local_folder, mapped, part_of, store
from .shared import fresh_path, written
from .words import blocks, mix, word_hashes

#: Characters of text that a task counts at a time, scores at a time, and hashes at a time.
COUNT_CHARS, SCORE_CHARS, HASH_CHARS = 12 << 20, 6 << 20, 4 << 20
#: Tokens whose n-grams are sorted at a time: their words, numbered within the slice, take 21 bits.
SLICE = (1 << 21) - 8
#: Characters of text for each part of the n-grams, and of the words. Larger parts need larger executors.
PART_CHARS, WORDS_CHARS = 16 << 20, 128 << 20
_U = np.uint64
END, BEGIN, EMPTY = _U(0x51ED270B0A1F39C3), _U(0x2545F4914F6CDD1D), _U(0)
_A, _B = _U(0x9FB21C651E98DF25), _U(0xD6E8FEB86659FD93)
#: Places in a words file, and the number that stands for all unknown words.
_PLACE = _U(26)
UNKNOWN = _U((1 << 62) - 1)


@dataclass(frozen=True)
class Model:
    """Where the files are, how they are dealt, and the numbers that hold for all of them."""

    path: str
    order: int
    parts: int
    word_parts: int
    most: int  # a middle word with more tokens is dealt as a grid
    tokens: int = 0
    words: int = 0
    pairs: int = 0
    pair_sums: tuple[int, int, int, int] = (0, 0, 0, 0)  # of the empty middle: n, and how many pairs have n = 1, 2, 3 or more
    discounts: tuple[tuple[float, float, float], ...] = ((0.0, 0.0, 0.0),) * 3  # of n-grams, pairs and words
    rest: float = 1.0


# Arrays in files and in rows


def _narrow(a: np.ndarray) -> np.ndarray:
    """The array in the least unsigned type that holds it."""
    top = int(a.max()) if len(a) else 0
    return a.astype(next(k for k in ("<u1", "<u2", "<u4", "<u8") if top < 1 << 8 * int(k[2])))


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, narrowed, each as planes of bytes, compressed, after a line of widths and sizes."""
    head, body = [len(arrays[0])], []
    for a in map(_narrow, arrays):
        planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()
        body.append(pa.compress(planes, codec="zstd", asbytes=True))
        head += [a.itemsize, len(body[-1])]
    return b"".join([" ".join(map(str, head)).encode(), b"\n", *body])


def _unpacked(data: bytes) -> list[np.ndarray]:
    """What `_packed` packed, as 64-bit numbers."""
    at = data.index(b"\n")
    n, *sizes = map(int, data[:at].split())
    at, out = at + 1, []
    for width, size in zip(sizes[::2], sizes[1::2], strict=True):
        planes = pa.decompress(data[at : at + size], decompressed_size=n * width, codec="zstd", asbytes=True)
        out.append(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, n).T).view(f"<u{width}").ravel().astype(_U))
        at += size
    return out


def _together(column: pa.ChunkedArray, k: int) -> list[np.ndarray]:
    """The k arrays of all rows of a column, one after another."""
    rows = [_unpacked(x.as_py()) for x in column if x.is_valid]
    return [np.concatenate([r[i] for r in rows]) if rows else np.zeros(0, _U) for i in range(k)]


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _ordered(*keys: np.ndarray) -> np.ndarray:
    """The order by the first key, then the second, and so on; two that fit into 64 bits are sorted as one."""
    if len(keys) > 1 and all(len(k) and int(k.max()) < 1 << 32 for k in keys[:2]):
        keys = (keys[0] << _U(32) | keys[1], *keys[2:])
    return np.lexsort(keys[::-1])


def _add(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, at) if len(at) else values[:0]


# Hash arrays: the top bits of a key are its bucket, the 32 bits after them are kept, in order.


def _heads(key: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The order of the keys, and the arrays that find them."""
    order = np.argsort(key)
    key = key[order]
    bits = max(1, (len(key) // 4).bit_length())
    heads = np.searchsorted(key >> _U(64 - bits), np.arange((1 << bits) + 1, dtype=_U))
    return order, {"heads": _narrow(heads), "rest": ((key << _U(bits)) >> _U(32)).astype("<u4")}


def _found(arrays: dict[str, np.ndarray], name: str, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys, and which are there."""
    heads, kept = arrays[f"{name}heads"], arrays[f"{name}rest"]
    bits = (len(heads) - 1).bit_length() - 1
    bucket, rest = (key >> _U(64 - bits)).astype(np.int64), ((key << _U(bits)) >> _U(32)).astype(np.uint32)
    lo, end = heads[bucket].astype(np.int64), heads[bucket + 1].astype(np.int64)
    hi = end.copy()
    if not len(kept):
        return lo, np.zeros(len(key), bool)
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        less = kept[np.minimum(mid, len(kept) - 1)] < rest
        lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
    return lo, (lo < end) & (kept[np.minimum(lo, len(kept) - 1)] == rest)


def _counts(key: np.ndarray, count: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of counts by key; of those that are 1 the keys alone."""
    more = count > 1
    order, found = _heads(key[more])
    one, single = _heads(key[~more])
    return {**{f"m{k}": a for k, a in found.items()}, "count": _narrow(count[more][order]), **{f"s{k}": a for k, a in single.items()}}


def _count_of(arrays: dict[str, np.ndarray], key: np.ndarray) -> np.ndarray:
    at, there = _found(arrays, "m", key)
    out = _found(arrays, "s", key)[1].astype(np.int64)
    out[there] = arrays["count"][at[there]]
    return out


# How words and n-grams are dealt


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a * _A + _A) + b * _B)


def _triple(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(_pair(u, v) + w * _A)


def _side(count: np.ndarray, most: int) -> np.ndarray:
    """The side of the grid of a middle word with so many tokens."""
    return np.ceil(np.sqrt(np.maximum(1.0, count / most))).astype(_U)


def _cell(u: np.ndarray, v: np.ndarray, w: np.ndarray, side: np.ndarray, parts: int) -> np.ndarray:
    return part_of(_triple(u % side, v, w % side), parts)


def _home(v: np.ndarray, parts: int) -> np.ndarray:
    """The one cell of a middle word without a grid."""
    return part_of(_triple(np.zeros_like(v), v, np.zeros_like(v)), parts)


def _words(hashes: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and counts of ascending hashes; an unknown word has the count 0."""
    number, count = np.full(len(hashes), UNKNOWN), np.zeros(len(hashes), np.int64)
    for p, here in by_part(part_of(hashes, m.word_parts)):
        arrays = mapped(f"{m.path}/words-{p}")
        if len(arrays["key"]):
            at = np.minimum(np.searchsorted(arrays["key"], hashes[here]), len(arrays["key"]) - 1)
            there = arrays["key"][at] == hashes[here]
            number[here[there]] = (_U(p) << _PLACE | at[there].astype(_U)) + _U(1)
            count[here[there]] = arrays["count"][at[there]]
    empty = hashes == EMPTY
    number[empty], count[empty] = 0, m.tokens
    return number, count


def _of_numbers(numbers: np.ndarray, m: Model, name: str, fields: tuple[str, ...]) -> list[np.ndarray]:
    """Fields of known words by their numbers; 0 for others."""
    out = [np.zeros(len(numbers), np.int64) for _ in fields]
    known = np.flatnonzero((numbers != UNKNOWN) & (numbers > 0))
    place = numbers[known] - _U(1)
    for p, here in by_part((place >> _PLACE).astype(np.int64)):
        arrays = mapped(f"{m.path}/{name}-{p}")
        at = (place[here] & _U((1 << int(_PLACE)) - 1)).astype(np.int64)
        for values, field in zip(out, fields, strict=True):
            values[known[here]] = arrays[field][at]
    return out


def _sides_of(v: np.ndarray, m: Model) -> np.ndarray:
    (count,) = _of_numbers(v, m, "words", ("count",))
    return _side(np.where(v == 0, m.tokens, count), m.most)


# Tokens


def _tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All tokens (words and ends), and len(texts) + 1 offsets."""
    parts, counts = [], []
    for b, e in blocks([len(t or "") for t in texts], HASH_CHARS):
        h, at = word_hashes(texts[b:e])
        parts.append(np.insert(h, at[1:], END))
        counts.append(np.diff(at) + 1)
    tokens = np.concatenate(parts) if parts else np.zeros(0, _U)
    return tokens, np.concatenate(([0], np.cumsum(np.concatenate(counts) if counts else np.zeros(0, np.int64))))


def _slices(tokens: np.ndarray, offsets: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For some tokens at a time: the ascending distinct hashes, and the places there of u, v and w."""
    first = np.zeros(len(tokens), bool)
    first[offsets[:-1]] = True
    second = np.zeros(len(tokens), bool)
    second[1:] = first[:-1]
    for b in range(0, len(tokens), SLICE):
        e = min(b + SLICE, len(tokens))
        before = np.concatenate((np.full(2, BEGIN), tokens[max(0, b - 2) : b]))[-2:]
        distinct, at = np.unique(np.concatenate((before, tokens[b:e], [BEGIN, EMPTY])), return_inverse=True)
        w, v, u = at[2:-2], at[1:-3].copy(), at[:-4].copy()
        v[first[b:e]] = at[-2]
        if order == 2:
            u, v = v, np.full(len(w), at[-1])
        else:
            u[first[b:e] | second[b:e]] = at[-2]
        yield distinct, u, v, w


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens of some texts at a time."""
    texts, size = [], 0
    for batch in batches:
        for t in batch.column(0).to_pylist():
            texts.append(t)
            size += len(t or "")
            if size >= COUNT_CHARS:
                yield _tokens(texts)
                texts, size = [], 0
    if texts:
        yield _tokens(texts)


def _row(part: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([data], pa.binary())], ["part", "data"])


# The four steps of training


def _worded(batches: Iterator[pa.RecordBatch], m: Model):
    """Words and begins of each block with their counts, by part of the words."""
    for tokens, offsets in _held(batches):
        key, count = np.unique(np.concatenate((tokens, np.full(len(offsets) - 1, BEGIN))), return_counts=True)
        for p, here in by_part(part_of(key, m.word_parts)):
            yield _row(p, _packed(key[here], count[here]))


def _merge_words(table: pa.Table, m: Model) -> pa.Table:
    """One part of the words: writes hashes and counts; how many tokens and words there are, begins aside."""
    part = table.column("part")[0].as_py()
    key, count = _together(table.column("data"), 2)
    order = np.argsort(key)
    key, count = key[order], count[order].astype(np.int64)
    at = _runs(key)
    key, count = key[at], _add(count, at)
    if len(key) >= 1 << int(_PLACE):
        raise ValueError("too many words in a part: lower WORDS_CHARS")
    store(m.path, f"words-{part}", key=key, count=_narrow(count))
    real = key != BEGIN
    return _stats([int(count[real].sum()), int(real.sum())])


def _stats(numbers: list[int], rows: list[tuple[int, int, bytes | None, bytes | None]] = ()) -> pa.Table:
    """A row with numbers (kind 0) and rows (kind, part, a, b) for the next steps."""
    rows = [(0, 0, None, None, numbers), *((*r, None) for r in rows)]
    kinds = {"kind": pa.int32(), "part": pa.int32(), "a": pa.binary(), "b": pa.binary(), "stats": pa.list_(pa.int64())}
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], names=list(kinds))


_STATS = "kind int, part int, a binary, b binary, stats array<long>"


def _counted(batches: Iterator[pa.RecordBatch], m: Model):
    """Distinct n-grams of each slice with counts, by part."""
    twenty_one = _U(21)
    for tokens, offsets in _held(batches):
        for distinct, u, v, w in _slices(tokens, offsets, m.order):
            key = np.sort(v.astype(_U) << _U(42) | u.astype(_U) << twenty_one | w.astype(_U))
            at = _runs(key)
            count, key = np.diff(np.concatenate((at, [len(key)]))), key[at]
            number, often = _words(distinct, m)
            v, u, w = (key >> _U(42)).astype(np.int64), (key >> twenty_one & _U(0x1FFFFF)).astype(np.int64), (key & _U(0x1FFFFF)).astype(np.int64)
            side = _side(often, m.most)[v]
            v, u, w = number[v], number[u], number[w]
            with np.errstate(over="ignore"):
                part = _cell(u, v, w, side, m.parts)
            for p, here in by_part(part):
                yield _row(p, _packed(v[here], u[here], w[here], count[here]))


def _of_counts(count: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4."""
    return [int((count == k).sum()) for k in (1, 2, 3, 4)]


def _three(count: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """For every run the sum of the counts, and how many are 1, 2, and 3 or more."""
    return [_add(count, at), *[_add(hit.astype(np.int64), at) for hit in (count == 1, count == 2, count >= 3)]]


def _store_contexts(name: str, u: np.ndarray, v: np.ndarray, sums: list[np.ndarray], m: Model, begin: np.ndarray) -> None:
    """Contexts seen more than once, and all that begin a text."""
    keep = (sums[0] > 1) | np.isin(u, begin)
    order, found = _heads(_pair(u[keep], v[keep]))
    store(m.path, name, **{f"m{k}": a for k, a in found.items()}, **{f"n{i}": _narrow(s[keep][order]) for i, s in enumerate(sums)})


def _of_words(v: np.ndarray, w: np.ndarray, n: np.ndarray, m: Model) -> list[tuple[int, int, bytes | None, bytes | None]]:
    """What whole pairs in the order (v, w) tell of their words: sums over w for every v, and pairs for every w."""
    if m.order == 2:
        return []
    at = _runs(v)
    first, sums = v[at], _three(n, at)
    second, pairs = np.unique(w, return_counts=True)
    a = {p: _packed(first[i], *[s[i] for s in sums]) for p, i in by_part(((first - _U(1)) >> _PLACE).astype(np.int64))}
    b = {p: _packed(second[i], pairs[i]) for p, i in by_part(((second - _U(1)) >> _PLACE).astype(np.int64))}
    return [(2, p, a.get(p), b.get(p)) for p in sorted(a.keys() | b.keys())]


def _pair_stats(n: np.ndarray) -> list[int]:
    return [*_of_counts(n), int((n >= 3).sum()), int(n.sum()), len(n)]


def _merge_part(table: pa.Table, m: Model) -> pa.Table:
    """One part of the n-grams: writes them and what is whole; passes on the rest, by pair (kind 1) and by word (kind 2)."""
    part = table.column("part")[0].as_py()
    v, u, w, count = _together(table.column("data"), 4)
    order = _ordered(v, u, w)
    v, u, w, count = v[order], u[order], w[order], count[order].astype(np.int64)
    at = _runs(v, u, w)
    v, u, w, count = v[at], u[at], w[at], _add(count, at)
    rows = []
    with np.errstate(over="ignore"):
        store(m.path, f"grams-{part}", **_counts(_triple(u, v, w), count))
        at = _runs(v, u)
        cv, cu, sums = v[at], u[at], _three(count, at)
        order = _ordered(v, w)
        pv, pw = v[order], w[order]
        at = _runs(pv, pw)
        pv, pw, n = pv[at], pw[at], np.diff(np.concatenate((at, [len(pv)])))
        whole, whole_context = _sides_of(pv, m) == 1, _sides_of(cv, m) == 1
        begin = _words(np.array([BEGIN]), m)[0]
        _store_contexts(f"contexts-{part}", cu[whole_context], cv[whole_context], [s[whole_context] for s in sums], m, begin)
        store(m.path, f"pairs-{part}", **_counts(_pair(pv[whole], pw[whole]), n[whole]))
        rows += _of_words(pv[whole], pw[whole], n[whole], m)
        cu, cv, sums = cu[~whole_context], cv[~whole_context], [s[~whole_context] for s in sums]
        a = {p: _packed(cu[i], cv[i], *[s[i] for s in sums]) for p, i in by_part(part_of(_pair(cu, cv), m.parts))}
        hv, hw, hn = pv[~whole], pw[~whole], n[~whole]
        b = {p: _packed(hv[i], hw[i], hn[i]) for p, i in by_part(part_of(_pair(hv, hw), m.parts))}
    rows += [(1, p, a.get(p), b.get(p)) for p in sorted(a.keys() | b.keys())]
    return _stats([*_of_counts(count), *_pair_stats(n[whole])], rows)


def _merge_pairs(table: pa.Table, m: Model) -> pa.Table:
    """One part of the pairs whose middle words have grids: sums, and writes them; passes on what they tell of words."""
    part = table.column("part")[0].as_py()
    u, v, *sums = _together(table.column("a"), 6)
    order = _ordered(u, v)
    u, v, sums = u[order], v[order], [s[order].astype(np.int64) for s in sums]
    at = _runs(u, v)
    begin = _words(np.array([BEGIN]), m)[0]
    with np.errstate(over="ignore"):
        _store_contexts(f"grid-contexts-{part}", u[at], v[at], [_add(s, at) for s in sums], m, begin)
        v, w, n = _together(table.column("b"), 3)
        order = _ordered(v, w)
        v, w, n = v[order], w[order], n[order].astype(np.int64)
        at = _runs(v, w)
        v, w, n = v[at], w[at], _add(n, at)
        store(m.path, f"grid-pairs-{part}", **_counts(_pair(v, w), n))
    return _stats([0, 0, 0, 0, *_pair_stats(n)], _of_words(v, w, n, m))


def _merge_levels(table: pa.Table, m: Model) -> pa.Table:
    """One part of the words: writes, in their order, the words before each and the sums over pairs that begin with it."""
    part = table.column("part")[0].as_py()
    size = len(mapped(f"{m.path}/words-{part}")["key"])
    place = lambda number: ((number - _U(1)) & _U((1 << int(_PLACE)) - 1)).astype(np.int64)
    v, *sums = _together(table.column("a"), 5)
    w, pairs = _together(table.column("b"), 2)
    n = np.bincount(place(w), pairs, size).astype(np.int64) if len(w) else np.zeros(size, np.int64)
    each = [np.bincount(place(v), s, size).astype(np.int64) if len(v) else np.zeros(size, np.int64) for s in sums]
    store(m.path, f"levels-{part}", before=_narrow(n), **{f"n{i}": _narrow(s) for i, s in enumerate(each)})
    return _stats([*_of_counts(n), int((n >= 3).sum())])


def discounts_of(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """D1, D2 and D3+ of modified Kneser-Ney; where counts of counts are lacking, three quarters of the nearest rule."""
    if not (n1 and n2):
        return 0.5, 0.75, 0.75
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0]
    return tuple(min(k - 0.05, max(0.05, x)) for k, x in zip((1, 2, 3), d, strict=True))


def _by_group(rows: DataFrame, parts: int, step, name: str) -> DataFrame:
    """The step over each part's rows, as a written table; a part without rows is stepped through too."""
    spark = rows.sparkSession
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns if c != "part"]
    whole = rows.unionByName(spark.range(parts).select(F.col("id").cast("int").alias("part"), *none))
    return written(whole.repartition(parts, "part").groupBy("part").applyInArrow(lambda t: step(t), _STATS), name)


def _sum(rows: DataFrame, n: int) -> list[int]:
    """The sums of the numbers of all parts, added up in the cluster."""
    got = rows.where("kind = 0").agg(*[F.sum(F.get("stats", F.lit(i))) for i in range(n)]).first()
    return [x or 0 for x in got]


def train(docs: DataFrame, text_col: str = "text", order: int = 3) -> Model:
    """Counts all texts of docs and writes the model's files to the shared folder. The order is 3 or 2."""
    if order not in (2, 3):
        raise ValueError(f"the order is 2 or 3, not {order}")
    path = fresh_path(docs.sparkSession, "ngrams")
    texts = docs.select(docs[f"`{text_col}`"].cast("string").alias("text"))
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    parts, word_parts = (max(1, math.ceil(chars / most)) for most in (PART_CHARS, WORDS_CHARS))
    m = Model(local_folder(path), order, parts, word_parts, 1)
    words = texts.mapInArrow(partial(_worded, m=m), "part int, data binary")
    tokens, n_words = _sum(_by_group(words, word_parts, partial(_merge_words, m=m), "words"), 2)
    m = Model(local_folder(path), order, parts, word_parts, max(1, tokens // (8 * parts)), tokens, n_words)
    grams = texts.mapInArrow(partial(_counted, m=m), "part int, data binary")
    sums = _by_group(grams, parts, partial(_merge_part, m=m), "sums")
    pairs = _by_group(sums.where("kind = 1").select("part", "a", "b"), parts, partial(_merge_pairs, m=m), "pair-sums")
    rows = sums.where("kind = 2").select("part", "a", "b").unionByName(pairs.where("kind = 2").select("part", "a", "b"))
    levels = _by_group(rows, word_parts, partial(_merge_levels, m=m), "levels")
    one, two, three = _sum(sums, 11), _sum(pairs, 11), _sum(levels, 5)
    of_pairs = [a + b for a, b in zip(one[4:], two[4:], strict=True)]
    d = discounts_of(*one[:4]), discounts_of(*of_pairs[:4]), discounts_of(*three[:4])
    n1, n2, _, _, more = three
    n_pairs = of_pairs[6]
    rest = (d[2][0] * n1 + d[2][1] * n2 + d[2][2] * more) / n_pairs if n_pairs and order > 2 else 1.0
    return Model(m.path, order, parts, word_parts, m.most, tokens, n_words, n_pairs, (of_pairs[5], of_pairs[0], of_pairs[1], of_pairs[4]), d, rest)


# Scoring


def _look_up(m: Model, names: tuple[str, str], places: np.ndarray, grid: np.ndarray, home: np.ndarray, cell: np.ndarray, find) -> None:
    """Calls find(arrays, places) for every file that some of the places belong to: a middle word's own part, or a grid's."""
    for on, name, part in ((~grid, names[0], home), (grid, names[1], cell)):
        some = places[on[places]]
        for p, here in by_part(part[some]):
            find(mapped(f"{m.path}/{name}-{p}"), some[here])


def _discount(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(c - np.array([0.0, *d])[np.minimum(c, 3)], 0.0)


def _weight(total: np.ndarray, n: list[np.ndarray], d: tuple[float, float, float]) -> np.ndarray:
    """What a context leaves to the lower order; 1 for one that is not known."""
    return np.where(total > 0, (d[0] * n[0] + d[1] * n[1] + d[2] * n[2]) / np.maximum(total, 1), 1.0)


def _slice_scores(distinct: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token: whether it is known, the add-one unigram log10, the Kneser-Ney log10."""
    number, often = _words(distinct, m)
    side = _side(often, m.most)
    known = often > 0
    base = np.log10((often + 1) / (m.tokens + m.words + 1))
    before, total, *n = _of_numbers(number, m, "levels", ("before", "n0", "n1", "n2", "n3"))
    if m.order == 2:
        unigram = np.full(len(distinct), 1 / (m.words + 1))
        total, n = np.full(len(distinct), m.pair_sums[0]), [np.full(len(distinct), x) for x in m.pair_sums[1:]]
    else:
        unigram = _discount(before, m.discounts[2]) / max(1, m.pairs) + m.rest / (m.words + 1)

    bits = _U(21)
    pairs, of_pair = np.unique(np.concatenate((v, u)).astype(_U) << bits | np.concatenate((w, v)).astype(_U), return_inverse=True)
    x, y = (pairs >> bits).astype(np.int64), (pairs & _U((1 << 21) - 1)).astype(np.int64)
    key, parts = _pair(number[x], number[y]), m.parts
    n_pair = np.zeros(len(pairs), np.int64)
    cell = part_of(key, parts)

    def count_pairs(arrays, here):
        n_pair[here] = _count_of(arrays, key[here])

    _look_up(m, ("pairs", "grid-pairs"), np.arange(len(pairs)), side[x] > 1, _home(number[x], parts), cell, count_pairs)
    sums = [np.zeros(len(pairs), np.int64) for _ in range(4)]

    def sum_contexts(arrays, here):
        at, there = _found(arrays, "m", key[here])
        for i, s in enumerate(sums):
            s[here[there]] = arrays[f"n{i}"][at[there]]

    _look_up(m, ("contexts", "grid-contexts"), np.unique(of_pair[len(w) :]), side[y] > 1, _home(number[y], parts), cell, sum_contexts)
    seen = (n_pair > 0) if m.order > 2 else known[x]
    once = (sums[0] == 0) & seen
    sums[0][once], sums[1][once] = 1, 1

    grams, of_gram = np.unique(of_pair[len(w) :].astype(_U) << _U(32) | w.astype(_U), return_inverse=True)
    c, gw = (grams >> _U(32)).astype(np.int64), (grams & _U(0xFFFFFFFF)).astype(np.int64)
    gu, gv, gw = number[x[c]], number[y[c]], number[gw]
    key_g, cell_g = _triple(gu, gv, gw), _cell(gu, gv, gw, side[y[c]], parts)
    count = np.zeros(len(grams), np.int64)
    for p, here in by_part(cell_g):
        count[here] = _count_of(mapped(f"{m.path}/grams-{p}"), key_g[here])

    lower = _discount(n_pair[of_pair[: len(w)]], m.discounts[1]) / np.maximum(total[v], 1) + _weight(total, n, m.discounts[1])[v] * unigram[w]
    of_context = of_pair[len(w) :]
    p = _discount(count, m.discounts[0])[of_gram] / np.maximum(sums[0], 1)[of_context] + _weight(sums[0], sums[1:], m.discounts[0])[of_context] * lower
    return known[w], base[w], np.log10(p)


def score_block(texts: list[str | None], m: Model) -> tuple[np.ndarray, ...]:
    """Per text: tokens, known tokens, add-one unigram log10, Kneser-Ney log10."""
    tokens, at = _tokens(texts)
    if not len(texts):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),) * 2
    with np.errstate(over="ignore"):
        each = [_slice_scores(*s, m) for s in _slices(tokens, at, m.order)]
    known, base, model = (np.concatenate(x) for x in zip(*each, strict=True))
    add = lambda x: np.add.reduceat(x, at[:-1])
    return np.diff(at), add(known.astype(np.int64)), add(base), add(model)


def _scored(batches: Iterator[pa.RecordBatch], model: Model):
    names = ["row", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for b, e in blocks([len(t or "") for t in texts], SCORE_CHARS):
            n, known, base, score = score_block(texts[b:e], model)
            rows = [batch.column(0).slice(b, e - b), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array([model.tokens] * (e - b), pa.int64()), pa.array(base), pa.array(score)]
            yield pa.RecordBatch.from_arrays(rows, names)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the text, with n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score; perplexity is 10 ** (-score / n_tokens)."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    others = [n for i, n in enumerate(names) if i != at]
    plain = docs.toDF(*names).selectExpr(f"struct({', '.join(others) or '0 AS none'}) AS row", f"cast(c{at} AS string) AS text")
    kind = plain.schema["row"].dataType.simpleString()
    got = plain.mapInArrow(partial(_scored, model=model), f"row {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    picks = [f"row.c{i} AS `{c}`" for i, c in enumerate(docs.columns) if i != at]
    return got.selectExpr(*picks, "n_tokens", "n_known", "train_tokens", "base_score", "score")

"""Byte-level BPE by corpus-level merge replay.

The distinct pre-tokens of the whole corpus are gathered first (each task sends one that it has not sent yet) and
dealt to parts by hash. A part's words become one array of symbols linked to their neighbours; an inverted index
leads from a pair's rank to the positions where it stands. Ranks are applied in ascending order, every merge at all
its positions at once; only the touched neighbours get new pairs, which join the index. So a word is merged once for
the corpus. A word in which a merge brings up a pair of a lower rank is done again alone, in the sequential order, so
results are always those of greedy merging. The words' ids are stored by 128-bit hash, in sorted arrays that workers
memory-map; texts are put together from them without a shuffle of texts.

Defined results: null and empty texts have no ids; equal texts, repeated rows among them, have equal ids; very long
texts are a block of their own and encoded whole; an empty table gives an empty one; columns stay, but for those
of the names of the results.
"""

from __future__ import annotations

import base64
import heapq
import math
from collections.abc import Iterator
from functools import lru_cache, partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mapped import by_part, local_folder, mapped, part_of, store
from .shared import fresh_path, without, written
from .units import WORD, units
from .words import blocks

#: Characters of text in a block, and pieces whose ids a task keeps, twice, from block to block.
BLOCK_CHARS = 3 << 20
KEPT_PIECES = 200_000
#: Words that a task remembers to have sent, and characters of text for a part of the words.
SENT_WORDS, PART_CHARS = 400_000, 32 << 20
_NONE = np.int32(2**31 - 1)


class Vocabulary:
    """Ranks of a rank file, and for every pair of tokens whose concatenation is a token, its rank."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.split = regex.compile(pattern).findall
        self.size = max(self.rank.values()) + 1
        self.bytes = [b""] * self.size
        keys, merged = [], []
        for token, r in self.rank.items():
            self.bytes[r] = token
            for i in range(1, len(token)):
                a, b = self.rank.get(token[:i]), self.rank.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    merged.append(r)
        order = np.argsort(keys)
        self.keys, self.merged = np.array(keys, np.int64)[order], np.array(merged, np.int32)[order]
        self.byte_ids = np.array([self.rank[bytes([i])] for i in range(256)], np.int32)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], _NONE)

    def greedy(self, word: bytes) -> list[int]:
        """The ids of one word, merge after merge: the least rank first, the leftmost of equals."""
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            r, i = min((self.rank.get(parts[i] + parts[i + 1], int(_NONE)), i) for i in range(len(parts) - 1))
            if r == _NONE:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.rank[p] for p in parts]


@lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def _leftmost(at: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Of ascending positions, those that a scan from the left merges: a merged pair uses up its second symbol."""
    chained = following[:-1] == at[1:]
    if not chained.any():
        return at
    runs = np.flatnonzero(np.concatenate(([True], ~chained)))
    nth = np.arange(len(at)) - np.repeat(runs, np.diff(np.concatenate((runs, [len(at)]))))
    return at[nth % 2 == 0]


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def replay(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one after another, and len(words) + 1 offsets."""
    sizes = np.array([len(w) for w in words], np.int64)
    begin = np.concatenate(([0], np.cumsum(sizes)))
    sym = v.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    n = len(sym)
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    filled = sizes > 0
    after[begin[1:][filled] - 1] = -1
    before[begin[:-1][filled]] = -1
    current = np.full(n, _NONE, np.int32)  # the rank of the pair that begins here
    linked = np.flatnonzero(after >= 0)
    current[linked] = v.pair_ranks(sym[linked], sym[after[linked]])
    index: dict[int, list[np.ndarray]] = {}
    again: list[np.ndarray] = []
    heap: list[int] = []

    def add(at: np.ndarray) -> None:
        ranks = current[at]
        at, ranks = at[ranks != _NONE], ranks[ranks != _NONE]
        if not len(at):
            return
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for r, part in zip(ranks[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts), strict=True):
            if r in index:
                index[r].append(part)
            else:
                index[r] = [part]
                heapq.heappush(heap, r)

    add(linked)
    while heap:
        r = heapq.heappop(heap)
        found = index.pop(r)
        at = _distinct(np.concatenate(found))
        at = at[current[at] == r]
        if not len(at):
            continue
        at = _leftmost(at, after[at])
        gone = after[at]
        to = after[gone]
        sym[at] = r
        after[at] = to
        before[to[to >= 0]] = at[to >= 0]
        current[gone] = _NONE
        sym[gone] = -1
        left = before[at]
        touched = _distinct(np.concatenate((at, left[left >= 0])))
        there = after[touched] >= 0
        current[touched[~there]] = _NONE
        touched = touched[there]
        current[touched] = v.pair_ranks(sym[touched], sym[after[touched]])
        lower = touched[current[touched] < r]
        if len(lower):
            again.append(lower)
            current[lower] = _NONE
        add(touched)

    alive = sym >= 0
    counts = np.add.reduceat(np.concatenate((alive, [False])), begin[:-1]) if len(words) else np.zeros(0, np.int64)
    counts = np.where(filled, counts, 0)
    ids, offsets = sym[alive], np.concatenate(([0], np.cumsum(counts)))
    if again:
        redo = np.unique(np.searchsorted(begin, np.concatenate(again), side="right") - 1).tolist()
        parts, last = [], 0
        for w in redo:
            own = np.array(v.greedy(words[w]), np.int32)
            parts += [ids[last : offsets[w]], own]
            last, counts[w] = offsets[w + 1], len(own)
        ids = np.concatenate([*parts, ids[last:]])
        offsets = np.concatenate(([0], np.cumsum(counts)))
    return ids, offsets


def words_of(piece: str, v: Vocabulary) -> list[str]:
    """The pre-tokens of a piece."""
    m = WORD.fullmatch(piece)
    return v.split(piece) if m is None else list(m.groups()) if m[2] else [piece]


def _digests(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of the words' hashes."""
    raw = b"".join([blake2b(w.encode("utf-8", "replace"), digest_size=16).digest() for w in words])
    both = np.frombuffer(raw, "<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _sent(batches: Iterator[pa.RecordBatch], path: str, pattern: str, parts: int):
    """Words of a task's texts that it has not sent yet, by part."""
    v, sent = vocabulary(path, pattern), set()
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for b, e in blocks([len(t or "") for t in texts], BLOCK_CHARS):
            pieces = set().union(*[units(t) for t in texts[b:e] if t])
            new = list({w for p in pieces for w in words_of(p, v)} - sent)
            if len(sent) + len(new) > SENT_WORDS:
                sent.clear()
            sent.update(new)
            at = [(p, pa.array([new[i] for i in here.tolist()], pa.string())) for p, here in by_part(part_of(_digests(new)[0], parts))]
            if at:
                cuts = np.cumsum([0, *(len(w) for _, w in at)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in at], pa.int32()), pa.ListArray.from_arrays(cuts, pa.concat_arrays([w for _, w in at]))], ["part", "words"])


def _replayed(table: pa.Table, folder: str, path: str, pattern: str) -> pa.Table:
    """One part of the corpus's words: merged, and stored by hash."""
    part = table.column("part")[0].as_py()
    words = list(set(table.column("words").combine_chunks().flatten().to_pylist()))
    ids, at = replay([w.encode("utf-8", "replace") for w in words], vocabulary(path, pattern))
    high, low = _digests(words)
    order = np.argsort(high)
    size = np.diff(at)[order]
    moved = np.concatenate(([0], np.cumsum(size)))
    source = np.repeat(at[:-1][order] - moved[:-1], size) + np.arange(len(ids))
    store(folder, f"words-{part}", high=high[order], low=low[order], at=moved.astype("<u4"), ids=ids[source].astype("<i4"))
    return pa.Table.from_arrays([pa.array([part], pa.int32()), pa.array([len(words)], pa.int64())], ["part", "n"])


class Lexicon:
    """The ids of the corpus's words, in the files of their parts."""

    def __init__(self, folder: str, parts: int):
        self.folder, self.parts = folder, parts

    def find(self, words: list[str]) -> list[bytes]:
        """The ids of each word, int32."""
        out: list[bytes] = [b""] * len(words)
        high, low = _digests(words)
        for p, here in by_part(part_of(high, self.parts)):
            arrays = mapped(f"{self.folder}/words-{p}")
            at = np.searchsorted(arrays["high"], high[here])
            while (other := arrays["low"][at] != low[here]).any():  # equal first halves: the next one
                at[other] += 1
            begin, end = arrays["at"][at].astype(np.int64), arrays["at"][at + 1].astype(np.int64)
            size = end - begin
            ends = np.cumsum(size)
            raw = arrays["ids"][np.repeat(begin - ends + size, size) + np.arange(int(ends[-1]))].tobytes()
            for i, b, e in zip(here.tolist(), (4 * (ends - size)).tolist(), (4 * ends).tolist(), strict=True):
                out[i] = raw[b:e]
        return out


def lexicon(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> Lexicon:
    """Gathers the distinct words of all texts of docs, and merges each of them once."""
    folder = local_folder(fresh_path(docs.sparkSession, "words"))
    texts = docs.select(docs[f"`{text_col}`"].cast("string").alias("text"))
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, math.ceil(chars / PART_CHARS))
    words = texts.mapInArrow(partial(_sent, path=path, pattern=pattern, parts=parts), "part int, words array<string>")
    whole = words.unionByName(docs.sparkSession.range(parts).select(F.col("id").cast("int").alias("part"), F.array().cast("array<string>").alias("words")))
    step = partial(_replayed, folder=folder, path=path, pattern=pattern)
    written(whole.repartition(parts, "part").groupBy("part").applyInArrow(lambda t: step(t), "part int, n long"), "lexicon")
    return Lexicon(folder, parts)


class Pieces(dict):
    """Pieces of text to their ids (int32, as bytes). New ones are put together a block at a time, from the words'."""

    def __init__(self, v: Vocabulary, words: Lexicon):
        self.v, self.words = v, words
        self.older: dict[str, bytes] = {}

    def learn(self, pieces: list[list[str]]) -> None:
        new = set().union(*pieces).difference(self)
        if len(self) + len(new) > KEPT_PIECES:  # what is in use comes back from the older ones
            self.older = dict(self)
            self.clear()
            new = set().union(*pieces)
        back = new.intersection(self.older)
        self.update((u, self.older[u]) for u in back)
        new = list(new - back)
        word_no: dict[str, int] = {}
        of_piece, cuts = [], [0]
        for u in new:
            of_piece.extend([word_no.setdefault(w, len(word_no)) for w in words_of(u, self.v)])
            cuts.append(len(of_piece))
        ids = self.words.find(list(word_no))
        for u, b, e in zip(new, cuts[:-1], cuts[1:], strict=True):
            self[u] = ids[of_piece[b]] if e - b == 1 else b"".join([ids[w] for w in of_piece[b:e]])


def encode_block(texts: list[str | None], known: Pieces) -> list[bytes]:
    """The ids of each text, int32."""
    pieces = [units(t) if t else [] for t in texts]
    known.learn(pieces)
    return [b"".join(map(known.__getitem__, p)) for p in pieces]


def _text_of(ids: bytes, token) -> bytes:
    return b"".join(map(token, np.frombuffer(ids, np.int32).tolist()))


def _encoded(batches: Iterator[pa.RecordBatch], text_at: int, path: str, pattern: str, words: Lexicon, back: bool):
    known = Pieces(vocabulary(path, pattern), words)  # a task's own, so that an idle worker holds none
    token = known.v.bytes.__getitem__
    for batch in batches:
        texts = batch.column(text_at).to_pylist()
        for b, e in blocks([len(t or "") for t in texts], BLOCK_CHARS):
            ids = encode_block(texts[b:e], known)
            at = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
            more = [pa.ListArray.from_arrays(at, np.frombuffer(b"".join(ids), np.int32))]
            if back:
                more.append(pa.array([_text_of(x, token) for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays([*(c.slice(b, e - b) for c in batch.columns), *more], [*batch.schema.names, "ids", "decoded"][: len(batch.columns) + len(more)])


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with one more column, the array of ids of the whole text; a column of its name is replaced.

    With decoded, also the bytes that the ids decode to, made in the same pass.
    """
    docs = without(docs, out, *[decoded] * bool(decoded))
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema, strict=True))
    run = partial(_encoded, text_at=docs.columns.index(text_col), path=path, pattern=pattern, words=lexicon(docs, path, pattern, text_col), back=bool(decoded))
    return plain.mapInArrow(run, f"{kinds}, ids array<int>" + ", decoded binary" * bool(decoded)).toDF(*docs.columns, out, *[decoded] * bool(decoded))


def _decoded(batches: Iterator[pa.RecordBatch], ids_at: int, path: str, pattern: str):
    token = vocabulary(path, pattern).bytes.__getitem__
    for batch in batches:
        lists = batch.column(ids_at)
        flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
        texts = [_text_of(flat[at[i] : at[i + 1]].tobytes(), token) for i in range(len(lists))]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [*batch.schema.names, "decoded"])


def decode(rows: DataFrame, path: str, pattern: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with one more column, the bytes that the ids stand for; null ids are none; a column of its name is replaced."""
    rows = without(rows, out)
    names = [f"c{i}" for i in range(len(rows.columns))]
    at = rows.columns.index(ids_col)
    plain = rows.toDF(*names).withColumn(f"c{at}", F.coalesce(F.col(f"c{at}"), F.array().cast("array<int>")))
    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, rows.schema, strict=True))
    run = partial(_decoded, ids_at=at, path=path, pattern=pattern)
    return plain.mapInArrow(run, f"{kinds}, decoded binary").toDF(*rows.columns, out)

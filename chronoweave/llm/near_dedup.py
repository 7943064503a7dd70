"""Near-duplicates by Fast Similarity Sketching, banding and exact verification.

A document's set holds its distinct shingles of `words` words (fewer words: the whole sequence as one
shingle; no words or null text: the empty set, linked with nothing). Two documents are linked if
100 * |A & B| >= percent * |A | B|; groups are the connected components of the links.

Sketch: t bins, rounds 0..2t-1. Round i hashes every element to a bin (from round t on, to bin i-t) and
a bin keeps the least (i, hash). All bins are full after round 2t-1 at the latest, most sets need a few
rounds. `rows` consecutive bins make a band; sets that agree on a band meet in a bucket.

No bucket is expanded into all its pairs. Equal sets are one node first. Then each round tests, in every
bucket, the members outside the bucket's largest component against one member of it; components merge
after each round. What is still apart in buckets of three or more goes through a prefix-filter join
(rarest shingles first), which finds every remaining link between different components exactly.

Defined results: null and empty texts have no shingles and are kept; rows with a null id are never linked
(component null, kept). Rows that share an id but not the text have each the component of their own text;
`drop_near_duplicates` goes by id and drops all rows of an id that one of them loses. Equal rows have equal
results. Very long texts are hashed in pieces, whole. An empty table gives no rows. Further columns of the input,
whatever their names, are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import broadcast_if_small, written
from .words import blocks, mix, seeds, word_hashes

BLOCK_CHARS = 3 << 19
BANDS, ROWS = 32, 5
STAR_ROUNDS = 6
#: Ids of documents are broadcast up to this many (some 20 MB) and joined by shuffle beyond, with the same result.
BROADCAST_IDS = 500_000
#: Sets that share an element of the prefix join and are compared in one task; more are dealt to several.
HOT_SETS = 4096
_U = np.uint64
_NONE = np.iinfo(np.uint64).max


def shingle_sets(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and len(texts) + 1 offsets."""
    h, at = word_hashes(texts)
    n = np.diff(at)
    factor, short = seeds(words, 11), seeds(words, 13)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(h) - words + 1), dtype=_U)
        for k in range(words):
            rolled += h[k : k + len(rolled)] * factor[k]
        rolled = mix(rolled)
        sets = []
        for i in range(len(texts)):
            if n[i] >= words:
                s = np.sort(rolled[at[i] : at[i + 1] - words + 1])
                sets.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
            elif n[i]:
                sets.append(mix(np.array([(h[at[i] : at[i + 1]] * short[: n[i]]).sum() + _U(n[i])], dtype=_U)))
            else:
                sets.append(np.zeros(0, dtype=_U))
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, _U)), offsets


def sketches(elements: np.ndarray, offsets: np.ndarray, bins: int) -> np.ndarray:
    """One row of `bins` minima per set; an empty set's row stays unfilled."""
    n = len(offsets) - 1
    out = np.full(n * bins, _NONE, dtype=_U)
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    factor = seeds(2 * bins, 17)
    with np.errstate(over="ignore"):
        for i in range(2 * bins):
            if not len(elements):
                break
            h = mix(elements ^ factor[i])
            to = (h >> _U(48)).astype(np.int64) * bins >> 16 if i < bins else i - bins
            np.minimum.at(out, owner * bins + to, (_U(i) << _U(48)) | (h & _U((1 << 48) - 1)))
            lacking = (out.reshape(n, bins) == _NONE).any(axis=1)[owner]
            elements, owner = elements[lacking], owner[lacking]
    return out.reshape(n, bins)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit bucket key for each set and band; bands never share buckets."""
    with np.errstate(over="ignore"):
        key = (sketch.reshape(len(sketch), bands, rows) * seeds(rows, 19)).sum(axis=2, dtype=_U)
        return mix(key ^ seeds(bands, 23))


def _node(elements: np.ndarray) -> bytes | None:
    return blake2b(elements.tobytes(), digest_size=16).digest() if len(elements) else None


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list]]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for b, e in blocks([len(t or "") for t in texts], BLOCK_CHARS):
            yield batch.column(0).slice(b, e - b), texts[b:e]


def _sketched(batches, words: int, bands: int, rows: int):
    for ids, texts in _in_blocks(batches):
        elements, at = shingle_sets(texts, words)
        keys = band_keys(sketches(elements, at, bands * rows), bands, rows).view(np.int64)
        nodes = [_node(elements[at[i] : at[i + 1]]) for i in range(len(texts))]
        lists = pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * bands, keys.reshape(-1))
        yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(at)), pa.array(nodes, pa.binary()), lists], ["id", "n_shingles", "node", "bands"])


def _with_sets(batches, words: int):
    for nodes, texts in _in_blocks(batches):
        elements, at = shingle_sets(texts, words)
        own = [_node(elements[at[i] : at[i + 1]]) for i in range(len(texts))]
        keep = np.flatnonzero([a == b for a, b in zip(own, nodes.to_pylist(), strict=True)])
        grams = pa.LargeListArray.from_arrays(at, elements.view(np.int64)).take(pa.array(keep)).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([nodes.take(pa.array(keep)), grams], ["node", "grams"])


def components(edges: DataFrame) -> DataFrame:
    """(x, p): for every node of the edges (a, b) the least node p of its component, by hooking and jumping."""
    edges = written(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while True:
        both = edges.select("a", "b").union(edges.select("b", "a"))
        hook = both.groupBy(F.col("a").alias("x")).agg(F.min("b").alias("m")).select("x", F.least("x", "m").alias("p"))
        hook = written(hook, "hooks")
        up = hook.select(F.col("x").alias("p"), F.col("p").alias("pp"))
        hook = written(hook.join(up, "p").select("x", F.col("pp").alias("p")).join(up, "p").select("x", F.col("pp").alias("p")), "jumps")
        up = hook.select(F.col("x").alias("p"), F.col("p").alias("pp"))
        labels = hook if labels is None else written(labels.join(up, "p", "left").select("x", F.coalesce("pp", "p").alias("p")), "labels")
        a, b = hook.select(F.col("x").alias("a"), F.col("p").alias("pa")), hook.select(F.col("x").alias("b"), F.col("p").alias("pb"))
        edges = edges.join(a, "a").join(b, "b").where("pa != pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        edges = written(edges, "edges")
        if edges.isEmpty():
            return labels


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets pass the threshold."""
    one = sets.select(F.col("node").alias("a"), F.col("grams").alias("ga"))
    two = sets.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
    na, nb, both = F.size("ga"), F.size("gb"), F.size(F.array_intersect("ga", "gb"))
    close = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
    enough = 100 * both >= percent * (na + nb - both)
    return pairs.join(one, "a").join(two, "b").where(F.when(close, enough).otherwise(False)).select("a", "b")


def _ordered(a, b) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _prefixes(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, comp, n, rest, g): the rarest shingles of every set, and how many elements from each on.

    Sets with Jaccard >= percent share one of the first n - ceil(percent * n / 100) + 1 elements of each in any
    common order.
    """
    own = written(nodes.join(sets, "node").select("node", "comp", F.size("grams").alias("n"), F.explode("grams").alias("g")), "grams")
    often = own.groupBy("g").agg(F.count("*").alias("c"))
    first = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100).cast("int") + 1
    kept = own.join(often, "g").groupBy("node", "comp", "n").agg(F.sort_array(F.collect_list(F.struct("c", "g"))).alias("s"))
    kept = kept.select("node", "comp", "n", F.posexplode(F.slice("s", F.lit(1), first)).alias("i", "e")).where("e.c > 1")
    return written(kept.select("node", "comp", "n", (F.col("n") - F.col("i")).alias("rest"), F.col("e.g").alias("g")), "prefixes")


def _meeting(kept: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The smaller and the larger sets of possible pairs, with keys (g, side, salt) on which they meet.

    At the first element that a pair shares, what follows in each must suffice for both sizes; so the smaller set
    has it early enough for a partner of its own size, which is a shorter prefix. Sets of the component that most sets
    of an element are in meet only others. An element of many sets is dealt to several tasks: the larger sets by a
    hash, the smaller ones to all.
    """
    parts = kept.groupBy("g", "comp").agg(F.count("*").alias("c"))
    main = parts.groupBy("g").agg(F.count("*").alias("comps"), F.sum("c").alias("c"), F.max_by("comp", F.struct("c", "comp")).alias("main")).where("comps > 1")
    rows = kept.join(main.select("g", F.ceil(F.col("c") / HOT_SETS).cast("int").alias("salts"), "main"), "g").withColumn("in_main", F.col("comp") == F.col("main"))
    small = rows.where((100 + percent) * F.col("rest") >= 2 * percent * F.col("n"))
    small = small.withColumn("side", F.explode(F.when(F.col("in_main"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    small = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    large = rows.withColumn("side", F.col("in_main")).withColumn("salt", F.pmod(F.hash("node"), "salts"))
    return tuple(df.select("g", "side", "salt", "node", "comp", "n", "rest") for df in (small, large))


def _prefix_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes (node, comp) of different components that share one of their rarest shingles: none that may
    pass the threshold is lost, and sets that share only what is frequent do not meet."""
    small, large = _meeting(_prefixes(nodes, sets, percent), percent)
    x, y = small.alias("x"), large.alias("y")
    same = (F.col("x.g") == F.col("y.g")) & (F.col("x.side") == F.col("y.side")) & (F.col("x.salt") == F.col("y.salt"))
    sizes = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.node") < F.col("y.node")))
    enough = (100 + percent) * F.least("x.rest", "y.rest") >= percent * (F.col("x.n") + F.col("y.n"))
    found = x.join(y, same & sizes & enough & (F.col("x.comp") != F.col("y.comp")))
    return found.select(*_ordered(F.col("x.node"), F.col("y.node"))).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row per row of docs: (id, n_shingles, component_id, kept).

    component_id is the least id of the group; kept marks the rows with that id. The group, not its
    pairs, is the result: links within a group are not listed.
    """
    docs = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    all_rows = written(docs.mapInArrow(partial(_sketched, words=words, bands=bands, rows=rows), f"id {kind}, n_shingles long, node binary, bands array<long>"), "sketches")
    usable = all_rows.where("id is not null and node is not null")
    reps = usable.groupBy("node").agg(F.min("id").alias("first_id"))
    spread = usable.groupBy("node").agg(F.first("bands").alias("bands")).select("node", F.explode("bands").alias("bucket"))
    full = spread.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("bucket")
    members = written(spread.join(full, "bucket"), "members")
    near = written(members.select("node").distinct().join(reps, "node").select("node", F.col("first_id").alias("id")), "near")
    text_of = docs.join(broadcast_if_small(near, BROADCAST_IDS), "id").select("node", "text")
    sets = written(text_of.mapInArrow(partial(_with_sets, words=words), "node binary, grams array<long>").dropDuplicates(["node"]), "sets")

    labels = tested = None
    k = 0
    while k <= STAR_ROUNDS:
        at = members if labels is None else members.join(labels.select(F.col("x").alias("node"), "p"), "node", "left")
        at = at.withColumn("comp", F.col("node") if labels is None else F.coalesce("p", "node")).select("bucket", "node", "comp")
        groups = at.groupBy("bucket", "comp").agg(F.count("*").alias("c"), F.min_by("node", F.xxhash64("node", F.lit(k))).alias("pick"))
        main = groups.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("c").alias("size"), F.max_by(F.struct("comp", "pick"), F.struct("c", F.xxhash64("comp", F.lit(k)))).alias("m"))
        main = main.where("parts > 1" if k == 0 else "parts > 1 and size > 2")
        apart = at.join(main, "bucket").where(F.col("comp") != F.col("m.comp"))
        if k == STAR_ROUNDS:
            left = at.join(main.select("bucket"), "bucket", "left_semi").select("node", "comp").distinct()
            pairs = _prefix_pairs(left, sets, percent)
        else:
            pairs = apart.select(*_ordered(F.col("m.pick"), F.col("node"))).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        links = written(_linked(pairs, sets, percent), "links")
        tested = pairs if tested is None else tested.union(pairs)
        if links.isEmpty():
            k = max(k + 1, STAR_ROUNDS)  # stars find no more; the prefix join settles what is left
            continue
        k += 1
        if labels is not None:
            p, q = labels.select(F.col("x").alias("a"), F.col("p").alias("pa")), labels.select(F.col("x").alias("b"), F.col("p").alias("pb"))
            links = links.join(p, "a", "left").join(q, "b", "left").select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"))
        merged = components(links)
        if labels is None:
            labels = merged
        else:
            old = labels.join(merged.select(F.col("x").alias("p"), F.col("p").alias("pp")), "p", "left").select("x", F.coalesce("pp", "p").alias("p"))
            labels = written(old.union(merged.join(labels.select("x"), "x", "left_anti")), "labels")

    if labels is not None:
        of = reps.join(labels.withColumnRenamed("x", "node"), "node", "left").withColumn("p", F.coalesce("p", "node"))
        least = of.join(labels.select(F.col("x").alias("node")), "node", "left_semi").groupBy("p").agg(F.min("first_id").alias("least_id"))
        reps = of.join(least, "p", "left").select("node", F.coalesce("least_id", "first_id").alias("first_id"))
    out = all_rows.select("id", "n_shingles", "node").join(reps, "node", "left")
    out = out.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("first_id", "id")).alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", (F.col("id").isNull() | (F.col("id") == F.col("component_id"))).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the documents that are not their group's first; all columns and null ids stay."""
    found = near_duplicates(docs, id_col, text_col, **how)
    gone = written(found.where("not kept").select(F.col(id_col).alias("__gone")).distinct(), "gone")
    return docs.join(broadcast_if_small(gone, BROADCAST_IDS), docs[id_col] == gone["__gone"], "left_anti")

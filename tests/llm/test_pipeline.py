"""The pipeline's result against brute force for each stage, one after another."""

import base64
from collections import Counter

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from chronoweave.llm import mixing, quality, secret_scan

from .test_ops import groups, plain_spans

SF = "/root/testdata/sf0.001"


def redacted(t):
    out, at = [], 0
    for s, _, e in plain_spans(t):
        if s >= at:
            out += [t[at:s], secret_scan.MARK]
        at = max(at, e)
    return "".join(out) + t[at:]


def test_run_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in quality.judged(docs, keep=["doc_id"]).where("__kept").collect()}
    rows = sorted((r for r in docs.collect() if r.doc_id in good), key=lambda r: r.doc_id)
    assert 0 < len(rows) < docs.count()
    first = groups([r.text for r in rows], 80)
    rows = [r for i, r in enumerate(rows) if first[i][1] == i]
    rows = [(r.doc_id, redacted(r.text), r.lang, r.source, len(redacted(r.text))) for r in rows]
    left = spark.createDataFrame(rows, docs.schema)
    copies = {r.doc_id: r.copies for r in mixing.plan(left).collect()}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(corpus_pipeline.RANKS), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = Counter({(r[0], r[3], tuple(library.encode_ordinary(r[1]))): copies[r[0]] for r in rows if copies[r[0]]})
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.source, tuple(r.ids)) for r in got) == expected
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got)


def test_stages_keep_columns_and_take_odd_rows(spark, table, odd):
    docs = table([*odd, *odd], [None] * len(odd) + ["s"] * len(odd))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() >= 0
        if name != "bpe_codec":
            assert out.columns == docs.columns, name
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "secret_scan", "source_mixing", "bpe_codec"]

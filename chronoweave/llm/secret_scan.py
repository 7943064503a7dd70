"""Secret scan in DataFrame functions only: three base patterns and sliding-window entropy.

Base spans, leftmost and non-overlapping per kind: assign (a keyword, a separator, a value of 6 or more
characters), access (AKIA..., 20 or more) and hex (24 or more). The method adds `entropy` spans: candidate
strings, runs of 20 or more characters [A-Za-z0-9+/_=-], get the Shannon entropy of every window of
20 characters from counts that change by one character in and one out; a window over its class's bound
(hex, lower case or upper case with digits, letters of both cases, mixed, base64) makes the candidate a span,
unless the allow-list knows its form or a base span has it. Letters of one case only are taken for words.

Positions are code points, end exclusive. Defined results: null text is empty: no spans; equal texts, equal
spans; of overlapping spans of different kinds all are listed; very long texts are scanned whole; an empty
table gives an empty result; other columns stay. No shuffle: every text is scanned where it is read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import let

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
MIN_VALUE = 6
#: A greedy run is kept or dropped as a whole, so the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}+"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Bits per character that the best window must reach, by character class: what 99 in 100 windows of uniformly random
#: characters reach (hex 16, lower and upper with digits 32 as in base32, letters 52, mixed 62, base64 64 characters).
BOUNDS = {"hex": 2.9, "lower": 3.34, "upper": 3.34, "letters": 3.58, "mixed": 3.64, "base64": 3.64}
#: The first class whose form fits is a candidate's; what fits none is base64.
CLASSES = {"hex": "^[0-9a-fA-F]+$", "lower": "^[0-9a-z]+=*$", "upper": "^[0-9A-Z]+=*$", "letters": "^[A-Za-z]+=*$", "mixed": "^[0-9A-Za-z]+=*$"}
#: Forms that are no secrets: plain numbers, UUIDs, slugs and paths of words and numbers, words and identifiers of
#: capitalised words, alone or joined by marks, such identifiers with a number, and what says that it is an example.
ALLOWED = (
    r"^[0-9_=+/-]+$|^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$|^/{0,2}(?:[A-Z]?[a-z]+|[0-9]+)(?:[-_/=]+(?:[A-Z]?[a-z]+|[0-9]+))+/?$"
    r"|^[-_/=+]*(?:[A-Z]+|[A-Z]?[a-z]+(?:[A-Z][a-z]{2,})*)(?:[-_/=+]+(?:[A-Z]+|[A-Z]?[a-z]+(?:[A-Z][a-z]{2,})*))*[-_/=+]*$"
    r"|^[a-z]*(?:[A-Z][a-z]{2,})+[0-9]{1,4}$|(?i:example|placeholder|changeme|xxxx)"
)
MARK = "[SECRET]"


def _no_spans() -> Column:
    return F.array().cast("array<struct<start:int,kind:int,end:int>>")


def _spans(text: Column, pattern: str, kind: int, value_group: int = 0) -> Column:
    """Spans of the pattern's matches: the pieces between matches give the places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else found
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    lengths = F.transform(F.arrays_zip(found.alias("m"), values.alias("v")), lambda z: F.struct(F.length(z["m"]).alias("n"), F.length(z["v"]).alias("v")))

    def walk(x: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"), _no_spans().alias("out"))

        def step(a: Column, m: Column) -> Column:
            start = a["at"] + F.get(x["gaps"], a["k"])
            span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + m["n"]).alias("end"))
            ok = m["v"] >= MIN_VALUE if value_group else F.lit(True)
            return F.struct((start + m["n"]).alias("at"), (a["k"] + 1).alias("k"), F.when(ok, F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

        return F.aggregate(x["found"], zero, step, lambda a: a["out"])

    return F.when(text.rlike(pattern), let(F.struct(gaps.alias("gaps"), lengths.alias("found")), walk)).otherwise(_no_spans())


def _n_log_n(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))


def _with_count(counts: Column, code: Column, n: Column) -> Column:
    return F.concat(F.slice(counts, F.lit(1), code), F.array(n), F.slice(counts, code + 2, F.lit(128)))


def window_entropy(text: Column, window: int = WINDOW) -> Column:
    """The greatest Shannon entropy (bits per character) of a window of an ASCII string; 0 if it is shorter."""

    def over(codes: Column) -> Column:
        zero = F.struct(F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

        def step(a: Column, i: Column) -> Column:
            gone = F.when(i >= window, F.get(codes, F.greatest(i - window, F.lit(0))))

            def removed(b: Column) -> Column:
                n = F.get(b["counts"], gone)
                less = F.struct(_with_count(b["counts"], gone, n - 1).alias("counts"), (b["sum"] - _n_log_n(n) + _n_log_n(n - 1)).alias("sum"), b["best"].alias("best"))
                return F.when(gone.isNotNull(), less).otherwise(b)

            def added(b: Column) -> Column:
                code = F.get(codes, i)
                n = F.get(b["counts"], code)
                total = b["sum"] - _n_log_n(n) + _n_log_n(n + 1)
                best = F.when(i >= window - 1, F.greatest(b["best"], F.lit(math.log2(window)) - total / window)).otherwise(b["best"])
                return F.struct(_with_count(b["counts"], code, n + 1).alias("counts"), total.alias("sum"), best.alias("best"))

            return let(removed(a), added)

        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), zero, step, lambda a: a["best"])

    codes = F.transform(F.split(text, "", -1), F.ascii)
    return F.when(F.length(text) >= window, let(codes, over)).otherwise(F.lit(0.0))


def _is_secret(s: Column) -> Column:
    bound = F.coalesce(*[F.when(s.rlike(form), F.lit(BOUNDS[c])) for c, form in CLASSES.items()], F.lit(BOUNDS["base64"]))
    return ~s.rlike(ALLOWED) & (F.round(window_entropy(s), 9) >= bound)


def _entropy_spans(text: Column, base: Column) -> Column:
    """Spans of candidates that no base span touches, scored after that, so that few are."""

    def judged(spans: Column) -> Column:
        free = F.filter(spans, lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
        return F.filter(free, lambda x: _is_secret(F.substr(text, x["start"] + 1, x["end"] - x["start"])))

    return let(_spans(text, CANDIDATE, 3), judged)


def secret_spans(text: Column) -> Column:
    """All spans (start, kind as an index of KINDS, end) by start, then kind."""
    text = F.coalesce(text, F.lit(""))

    def with_text(t: Column) -> Column:
        access = F.when(t.contains("AKIA"), _spans(t, ACCESS, 1)).otherwise(_no_spans())
        base = F.concat(_spans(t, ASSIGN, 0, 2), access, _spans(t, HEX, 2))
        return let(base, lambda b: F.sort_array(F.concat(b, _entropy_spans(t, b))))

    return let(text, with_text)


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def scan(docs: DataFrame, text_col: str = "text", out: str = "secret_spans") -> DataFrame:
    """docs with one more column, the array of spans; a column of its name is replaced."""
    return docs.withColumn(out, secret_spans(docs[f"`{text_col}`"].cast("string")))


def redacted(text: Column, spans: Column) -> Column:
    """text with each group of overlapping spans replaced by one mark."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        gap = F.substr(text, a["at"] + 1, F.greatest(x["start"] - a["at"], F.lit(0)))
        more = F.when((x["start"] >= a["at"]), F.concat(a["out"], F.array(gap, F.lit(MARK)))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), more.alias("out"))

    done = F.aggregate(spans, zero, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substr(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every secret in text_col replaced; rows, columns and null texts stay."""
    text = docs[f"`{text_col}`"]
    clean = F.when(text.isNotNull(), let(F.struct(text.alias("t"), secret_spans(text).alias("s")), lambda x: redacted(x["t"], x["s"])))
    return docs.select(*[clean.alias(c) if c == text_col else docs[f"`{c}`"] for c in docs.columns])

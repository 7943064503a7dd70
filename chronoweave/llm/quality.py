"""Quality rules as weak supervision, in DataFrame functions only.

Every rule votes good (1), bad (-1) or abstains (0), independently given the true quality, with unknown
chances in good and in bad documents. Expectation-maximisation over the counts of vote patterns (at most
3**rules rows, whatever the corpus) estimates these accuracies and the share of good documents. The
posterior probability of being good decides, next to a hard base rule.

Features are computed once, in one pass without a shuffle, and written; the estimation reads only votes.
Defined results: null and empty texts have no words and fail the base rule; ties of posterior and
threshold are kept; an empty table gives an empty result; repeated rows get equal verdicts.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
PREFIX = "q_"
COUNTED = {"n_symbols": SYMBOLS, "n_capitals": r"\p{Lu}", "n_exclamations": "!", "n_marked": SYMBOLS + r"(?=[\x20\x09-\x0D]|$)"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


def _covered(positions: Column) -> Column:
    """How many words the 3-word windows at these ascending positions cover."""
    to_next = lambda p, j: F.least(F.lit(3), F.coalesce(F.get(positions, j + 1) - p, F.lit(3)))
    return F.aggregate(F.transform(positions, to_next), F.lit(0), lambda a, x: a + x)


def _repeats(windows: Column) -> Column:
    """Words in windows whose hash occurs twice or more: sort (hash, position), take equal neighbours."""

    def of_sorted(s: Column) -> Column:
        same = lambda x, j: (F.get(s, j + 1)["h"] == x["h"]) | ((j > 0) & (F.get(s, F.greatest(j - 1, F.lit(0)))["h"] == x["h"]))
        where = F.sort_array(F.transform(F.filter(s, lambda x, j: F.coalesce(same(x, j), F.lit(False))), lambda x: x["i"]))
        return let(where, _covered)

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(pairs, of_sorted))


def _repeat_words(words: Column) -> Column:
    starts = F.sequence(F.lit(0), F.size(words) - 3)
    windows = F.transform(starts, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(windows, _repeats))


def _of_words(words: Column) -> Column:
    return F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
        _repeat_words(words).cast("long").alias("n_repeat_words"),
    )


def _of_lines(lines: Column) -> Column:
    return F.struct(
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
    )


def features(text: Column) -> Column:
    """A struct of the counts that the rules read."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(
        F.struct(let(words_of(text), _of_words).alias("w"), let(lines, _of_lines).alias("l"), *[F.regexp_count(text, F.lit(p)).cast("long").alias(c) for c, p in COUNTED.items()]),
        lambda f: F.struct(*[f["w"][c].alias(c) for c in ("n_words", "word_chars", "n_distinct", "n_repeat_words")], *[f["l"][c].alias(c) for c in ("n_lines", "n_dup_lines")], *[f[c].alias(c) for c in COUNTED]),
    )


def _vote(bad: str, good: str) -> Column:
    return F.when(F.expr(bad), F.lit(-1)).when(F.expr(good), F.lit(1)).otherwise(F.lit(0)).cast("tinyint")


#: name -> (bad, good), SQL over the features; integers only, so that every engine agrees. Each defect has two rules,
#: over different counts: the estimation learns a rule's accuracy from its agreement with others.
RULES: dict[str, tuple[str, str]] = {
    "length": ("n_words < 30", "n_words >= 80"),
    "word_length": ("word_chars > 15 * n_words OR word_chars < 2 * n_words", "word_chars <= 10 * n_words AND word_chars >= 3 * n_words"),
    "symbols": ("10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    "duplicate_lines": ("10 * n_dup_lines > 3 * n_lines", "n_lines >= 2 AND 20 * n_dup_lines <= n_lines"),
    "repeated_windows": ("10 * n_repeat_words > 3 * n_words", "10 * n_repeat_words <= n_words"),
    "distinct_words": ("n_words >= 50 AND n_words > 20 * n_distinct", "4 * n_distinct >= n_words"),
    "capitals": ("10 * n_capitals > 3 * word_chars", "5 * n_capitals <= word_chars"),
    "exclamations": ("5 * n_exclamations > n_words", "50 * n_exclamations <= n_words"),
    "marked_words": ("10 * n_marked > n_words", "50 * n_marked <= n_words"),
}
#: Rounds of EM.
ROUNDS = 12

VOTES = (-1, 0, 1)
#: rule -> vote -> log of its chance in good over its chance in bad documents.
Weights = dict[str, dict[int, float]]


def _posterior(weights: Weights, prior: float) -> Column:
    """The weights stand in one array, which generated code refers to: each round of EM compiles to the same code."""
    table = F.array(*[F.lit(w[v]) for w in weights.values() for v in VOTES], F.lit(math.log(prior / (1 - prior))))
    total = F.get(table, F.lit(3 * len(weights)))
    for j, name in enumerate(weights):
        total = total + F.get(table, F.col(PREFIX + name).cast("int") + (3 * j + 1))
    return 1 / (1 + F.exp(-total))


def estimate(patterns: DataFrame, rounds: int = ROUNDS) -> tuple[Weights, float]:
    """The weight of every vote and the share of good documents, by EM over (votes, n) rows.

    It starts from documents with a bad vote being bad and all others good. A bad vote never counts for good
    and a good vote never for bad: rules are taken to be better than chance.
    """
    names = list(RULES)
    votes = F.array(*[F.col(PREFIX + name) for name in names])
    q = F.when(F.array_contains(votes, F.lit(-1).cast("tinyint")), F.lit(0.01)).otherwise(F.lit(0.99))
    weights, prior = {k: dict.fromkeys(VOTES, 0.0) for k in names}, 0.5
    for _ in range(rounds):
        each = patterns.select("n", (F.col("n") * q).alias("g"), F.posexplode(votes).alias("j", "v")).groupBy("j", "v").agg(F.sum("n"), F.sum("g"))
        got = {(j, v): (n, g) for j, v, n, g in each.collect()}  # three rows for each rule at most
        if not got:
            break
        whole = [sum(got.get((0, v), (0, 0))[i] for v in VOTES) for i in (0, 1)]
        weights = {}
        for j, name in enumerate(names):
            w = {}
            for v in VOTES:
                n, g = got.get((j, v), (0, 0.0))
                w[v] = math.log((g + 0.5) / (whole[1] + 1.5)) - math.log((n - g + 0.5) / (whole[0] - whole[1] + 1.5))
            weights[name] = {-1: min(0.0, w[-1]), 0: w[0], 1: max(0.0, w[1])}
        prior = min(0.99, max(0.01, whole[1] / whole[0]))
        q = _posterior(weights, prior)
    return weights, prior


def judged(docs: DataFrame, text_col: str = "text", threshold: float = 0.5, min_words: int = 50, max_repeat_percent: int = 50, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with struct columns: q (features), and base_failed, q_posterior, kept."""
    names = docs.columns if keep is None else keep
    own = [docs[f"`{c}`"].alias(f"d{i}") for i, c in enumerate(names)]
    rows = docs.select(*own, features(docs[f"`{text_col}`"]).alias("q"))
    rows = rows.select("*", "q.*")
    rows = rows.select(*[f"d{i}" for i in range(len(names))], "q", *[_vote(*rule).alias(PREFIX + name) for name, rule in RULES.items()])
    rows = written(rows, "votes")
    votes = [PREFIX + name for name in RULES]
    patterns = written(rows.groupBy(*votes).agg(F.count("*").alias("n")).coalesce(1), "patterns")
    weights, prior = estimate(patterns)
    f = F.col("q")
    failed = (f["n_words"] < min_words) | (100 * f["n_repeat_words"] > max_repeat_percent * f["n_words"])
    out = rows.withColumn("q_posterior", F.round(_posterior(weights, prior), 9)).withColumn("q_failed", failed)
    return out.select(*[F.col(f"d{i}").alias(c) for i, c in enumerate(names)], f.alias("__q"), F.col("q_posterior").alias("__posterior"), F.col("q_failed").alias("__base_failed"), (~F.col("q_failed") & (F.col("q_posterior") >= threshold)).alias("__kept"))


def keep_good(docs: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The documents that pass, with the columns of docs."""
    out = judged(docs, text_col, **how)
    n = len(docs.columns)
    plain = out.toDF(*[f"d{i}" for i in range(n)], "q", "posterior", "failed", "kept").where("kept")
    return plain.select(*[F.col(f"d{i}").alias(c) for i, c in enumerate(docs.columns)])

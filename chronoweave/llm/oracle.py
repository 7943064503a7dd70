"""DuckDB SQL for the queries of this subpackage that SQL can express, put together from the operators' parameters."""

from __future__ import annotations

from . import mixing, quality, secret_scan, sharding

NOT_SPACE = r"[^\x20\x09-\x0D]+"
WORDS = f"regexp_extract_all(coalesce(text, ''), '{NOT_SPACE}')"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _nibble_table() -> list[int]:
    out = []
    for i in range(16):
        for _ in range(4):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        out.append(i)
    return out


def crc32(text: str) -> str:
    """The unsigned crc32 of a text's UTF-8 bytes: each byte's hex digits, the low one first."""
    table = f"{_nibble_table()}::BIGINT[]"
    digit = lambda c, d: f"xor(list_extract({table}, 1 + (xor({c}, {d}) & 15)), {c} >> 4)"
    digits = f"list_transform(string_split(hex(encode({text})), ''), lambda h: ord(h) - CASE WHEN h < 'A' THEN 48 ELSE 55 END)"
    pairs = f"list_transform([{digits}], lambda d: list_transform(range(1, len(d) // 2 + 1), lambda i: d[2 * i - 1] * 16 + d[2 * i]))[1]"
    step = digit(f"({digit('c', 'x')})", "(x >> 4)")
    all_ = f"list_reduce({pairs}, lambda c, x: {step}, 4294967295::BIGINT)"
    return f"CAST(CASE WHEN {text} = '' THEN 0 ELSE xor({all_}, 4294967295) END AS BIGINT)"


def _windows(words: int) -> str:
    """win (doc_id, i, g): the runs of so many words of d's lists w, joined by blanks; null at a list's end."""
    run = " || ' ' || ".join(["x", *(f"lead(x, {k}) OVER o" for k in range(1, words))])
    return f"each_ AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d), win AS (SELECT doc_id, i, {run} AS g FROM each_ WINDOW o AS (PARTITION BY doc_id ORDER BY i))"


def near_dedup(percent: int = 85, words: int = 5) -> str:
    return f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '{NOT_SPACE}') AS w FROM documents),
{_windows(words)},
sh AS (SELECT DISTINCT doc_id, g FROM win WHERE g IS NOT NULL UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND {words - 1}),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= {percent} * (p.n + q.n - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT w.b, r.c FROM reach r JOIN ways w ON w.a = r.a WHERE r.c < w.b),
least_ AS (SELECT a, min(c) AS c FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least_.c AS component_id, least_.c = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN least_ ON least_.a = doc_id"""


def kneser_ney() -> str:
    """Trigrams, level by level; a begin is written as a word that holds a space."""

    def discounts(name: str, level: str) -> str:
        """One row d (a list: D1, D2, D3) from the counts of counts of a level."""
        capped = lambda k, x: f"least({k} - 0.05, greatest(0.05, {x}))"
        y = "(n1 / (n1 + 2 * n2))"
        found = ", ".join((capped("1::DOUBLE", f"1 - 2 * {y} * n2 / n1"), capped("2::DOUBLE", f"2 - 3 * {y} * n3 / n2"), capped("3::DOUBLE", f"CASE WHEN n3 > 0 THEN 3 - 4 * {y} * n4 / n3 ELSE 1 END")))
        counts = ", ".join(f"count(*) FILTER (c = {k})::DOUBLE AS n{k}" for k in (1, 2, 3, 4))
        return f"{name} AS (SELECT CASE WHEN n1 > 0 AND n2 > 0 THEN [{found}] ELSE [0.5, 0.75, 0.75]::DOUBLE[] END AS d FROM (SELECT {counts} FROM {level}))"

    def contexts(name: str, level: str, keys: str, d: str) -> str:
        weights = " + ".join(f"any_value(d)[{k}] * count(*) FILTER (c {'=' if k < 3 else '>='} {k})" for k in (1, 2, 3))
        return f"{name} AS (SELECT {keys}, sum(c) AS total, ({weights}) / sum(c) AS rest FROM {level}, {d} GROUP BY {keys})"

    cut = lambda c, d: f"(coalesce({c}, 0) - CASE WHEN {c} IS NULL THEN 0 ELSE {d}.d[least({c}, 3)] END)"
    return f"""WITH t AS (SELECT doc_id, {crc32('CAST(doc_id AS VARCHAR)')} % 7 = 2 AS held_out,
  list_concat(['< ', '< '], list_append(regexp_extract_all({LOWERED}, '{NOT_SPACE}'), ' >')) AS w FROM documents),
x AS (SELECT doc_id, held_out, i, w[i - 2] AS u, w[i - 1] AS v, w[i] AS w FROM (SELECT *, unnest(range(3, len(w) + 1)) AS i FROM t)),
words AS (SELECT w, count(*) AS c FROM x WHERE NOT held_out GROUP BY w),
size_ AS (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS n, count(*) AS v FROM words),
g3 AS (SELECT u, v, w, count(*) AS c FROM x WHERE NOT held_out GROUP BY ALL),
g2 AS (SELECT v, w, count(*) AS c FROM g3 GROUP BY ALL),
g1 AS (SELECT w, count(*) AS c FROM g2 GROUP BY ALL),
{discounts('d3', 'g3')}, {discounts('d2', 'g2')}, {discounts('d1', 'g1')},
{contexts('c3', 'g3', 'u, v', 'd3')}, {contexts('c2', 'g2', 'v', 'd2')},
c1 AS (SELECT sum(c) AS total, ({" + ".join(f"any_value(d)[{k}] * count(*) FILTER (c {'=' if k < 3 else '>='} {k})" for k in (1, 2, 3))}) / sum(c) AS rest FROM g1, d1),
p1 AS (SELECT x.*, words.c AS known, {cut('g1.c', 'd1')} / greatest(coalesce(c1.total, 1), 1) + coalesce(c1.rest, 1.0) / (size_.v + 1) AS p1
  FROM x LEFT JOIN words USING (w) LEFT JOIN g1 USING (w), d1, c1, size_),
p2 AS (SELECT p1.*, CASE WHEN c2.total IS NULL THEN p1 ELSE {cut('g2.c', 'd2')} / c2.total + c2.rest * p1 END AS p2 FROM p1 LEFT JOIN g2 USING (v, w) LEFT JOIN c2 USING (v), d2),
p3 AS (SELECT p2.*, CASE WHEN c3.total IS NULL THEN p2 ELSE {cut('g3.c', 'd3')} / c3.total + c3.rest * p2 END AS p3 FROM p2 LEFT JOIN g3 USING (u, v, w) LEFT JOIN c3 USING (u, v), d3)
SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(known) AS n_known, any_value(size_.n) AS train_tokens,
  round(sum(log10((coalesce(known, 0) + 1) / (size_.n + size_.v + 1))), 6) AS base_score, round(sum(log10(p3)), 6) AS score FROM p3, size_ GROUP BY doc_id"""


def quality_rules() -> str:
    """The counts, the votes, and the rounds of EM over the patterns, one after another."""
    rules = list(quality.RULES)
    vote = ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END" for bad, good in quality.RULES.values())
    size, unbiased = len(rules), "list_sum(list_transform(range({n}), lambda j: m[3 * j + vs[j + 1] + 2]))".replace("{n}", str(len(rules)))

    def step(k: int) -> str:
        return f"""s{k} AS MATERIALIZED (SELECT sum(n) AS n, sum(n * q) AS g FROM q{k}),
e{k} AS MATERIALIZED (SELECT j, vs[j + 1] AS v, sum(n) AS n, sum(n * q) AS g FROM q{k}, range({size}) r(j) GROUP BY ALL),
w{k} AS MATERIALIZED (SELECT a.j, a.v, ln((coalesce(e.g, 0) + 0.5) / (s.g + 1.5)) - ln((coalesce(e.n - e.g, 0) + 0.5) / (s.n - s.g + 1.5)) AS x
  FROM (SELECT j, v FROM range({size}) r(j), (VALUES (-1), (0), (1)) o(v)) a LEFT JOIN e{k} e ON e.j = a.j AND e.v = a.v, s{k} s),
m{k} AS MATERIALIZED (SELECT list(CASE v WHEN -1 THEN least(0.0, x) WHEN 1 THEN greatest(0.0, x) ELSE x END ORDER BY j, v) AS m, any_value(least(0.99, greatest(0.01, s.g / s.n))) AS prior FROM w{k}, s{k} s),
q{k + 1} AS MATERIALIZED (SELECT vs, n, 1 / (1 + exp(-(ln(prior / (1 - prior)) + {unbiased}))) AS q FROM q{k}, m{k})"""

    symbols = quality.SYMBOLS
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{NOT_SPACE}')) AS l FROM documents),
{_windows(3)}, same AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win WHERE g IS NOT NULL),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM same, range(3) o(j) WHERE c > 1 GROUP BY doc_id),
f AS (SELECT doc_id, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, len(list_distinct(w)) AS n_distinct, coalesce(covered.n, 0) AS n_repeat_words,
  len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, len(regexp_extract_all(text, '{symbols}')) AS n_symbols, len(regexp_extract_all(text, '\\p{{Lu}}')) AS n_capitals,
  len(regexp_extract_all(text, '!')) AS n_exclamations, len(list_filter(w, lambda x: regexp_matches(x, '{symbols}$'))) AS n_marked FROM d LEFT JOIN covered USING (doc_id)),
votes AS MATERIALIZED (SELECT *, [{vote}] AS vs FROM f),
q0 AS MATERIALIZED (SELECT vs, count(*)::DOUBLE AS n, CASE WHEN list_contains(vs, -1) THEN 0.01::DOUBLE ELSE 0.99 END AS q FROM votes GROUP BY vs),
{", ".join(step(k) for k in range(quality.ROUNDS))}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND round(q, 9) >= 0.5 AS kept, round(q, 6) AS posterior FROM votes JOIN q{quality.ROUNDS} USING (vs)"""


def feistel_sharding(shards: int = 24, key: int = 20240229) -> str:
    def one_round(rows: str, k: int) -> str:
        at = f"SELECT *, (rgt + {k + key}) & {sharding.HALF} AS y FROM ({rows})"
        for shift, factor in sharding.STEPS:
            at = f"SELECT * REPLACE ((xor(y, y >> {shift}) * {factor}) & {sharding.HALF} AS y) FROM ({at})"
        return f"SELECT i, n, h, rgt AS lft, xor(lft, xor(y, y >> 16) & ((1::BIGINT << h) - 1)) AS rgt FROM ({at})"

    rows = "SELECT i, n, h, x >> h AS lft, x & ((1::BIGINT << h) - 1) AS rgt FROM walk WHERE x >= n OR NOT walked"
    for k in sharding.ROUNDS:
        rows = one_round(rows, k)
    return f"""WITH RECURSIVE d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size, {crc32("coalesce(text, '')")} AS text_crc32 FROM documents),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS i, count(*) OVER () AS n FROM d),
walk AS (SELECT i, n, CAST(greatest(1, (length(bin(greatest(n, 2) - 1)) + 1) // 2) AS INTEGER) AS h, i AS x, false AS walked FROM o
  UNION ALL SELECT i, n, h, (lft << h) | rgt, true FROM ({rows})),
place AS (SELECT i, x FROM walk WHERE walked AND x < n)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(x % {shards} AS INTEGER) AS shard, x // {shards} AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM o JOIN place USING (i)"""


def source_mixing(weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, cap: int = 2, seed: int = 1) -> str:
    draw = f"CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 13) AS BIGINT) / {float(1 << 52)}::DOUBLE"
    return f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{mixing.WORD}')) AS size, {draw} AS draw FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
w AS (SELECT *, {list(weights)}[1 + (rank - 1) % {len(weights)}] AS w, {cap} * source_size AS most FROM r),
p AS (SELECT *, row_number() OVER (ORDER BY most / w, rank) AS place, sum(source_size) OVER ()::BIGINT AS whole FROM w),
l AS (SELECT *, (whole * {percent} / 100 - coalesce(sum(most) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
  / (sum(w) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level FROM p),
c AS (SELECT arg_min(level, place) AS level, min(place) AS place FROM l WHERE level * w <= most),
t AS (SELECT l.source, source_size, CASE WHEN c.place IS NULL OR l.place < c.place THEN most::DOUBLE ELSE c.level * w END AS target FROM l, c),
x AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source"""


def secret_spans() -> str:
    either = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    value = "[A-Za-z0-9+/_.=-]+"
    assign = rf"""({either})["'']?\x20*[:=]\x20*["'']?({value})"""

    def found(kind: int, pattern: str, value_group: int = 0) -> str:
        ends = "list_sum(list_transform(gap[1:k + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k], lambda x: length(x))), 0)"
        return f"""SELECT doc_id, CAST({ends} AS BIGINT) AS s, {kind} AS kind, CAST({ends} + length(m[k + 1]) AS BIGINT) AS e, m[k + 1] AS str, length(v[k + 1]) AS nv FROM (SELECT *, unnest(range(len(m))) AS k FROM
  (SELECT doc_id, string_split_regex(text, '{pattern}') AS gap, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {value_group}) AS v FROM d))"""

    kinds = f"[{', '.join(repr(k) for k in secret_scan.KINDS)}]"
    classes = " ".join(f"WHEN regexp_matches(str, '{form}') THEN {secret_scan.BOUNDS[c]}" for c, form in secret_scan.CLASSES.items())
    text_of = lambda rel, cond: f"coalesce(string_agg({kinds}[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER ({cond}), '')"
    n = secret_scan.WINDOW
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS (SELECT * FROM ({found(0, assign, 2)}) WHERE nv >= {secret_scan.MIN_VALUE} UNION ALL {found(1, secret_scan.ACCESS)} UNION ALL {found(2, secret_scan.HEX)}),
cand AS ({found(3, "[A-Za-z0-9+/_=-]{20,}")}),
free AS (SELECT * FROM cand c WHERE NOT regexp_matches(str, '{secret_scan.ALLOWED}') AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.s < c.e AND c.s < b.e)),
win AS (SELECT doc_id, s, i, unnest(string_split(substr(str, i, {n}), '')) AS ch FROM (SELECT *, unnest(range(1, length(str) - {n - 2})) AS i FROM free)),
counts AS (SELECT doc_id, s, i, count(*) AS c FROM win GROUP BY doc_id, s, i, ch),
best AS (SELECT doc_id, s, max(h) AS h FROM (SELECT doc_id, s, i, round(log2({n}) - sum(c * log2(c)) / {n}, 9) AS h FROM counts GROUP BY ALL) GROUP BY ALL),
entropy AS (SELECT f.doc_id, f.s, f.kind, f.e FROM free f JOIN best USING (doc_id, s) WHERE h >= CASE {classes} ELSE {secret_scan.BOUNDS['base64']} END),
spans AS (SELECT doc_id, s, kind, e FROM base UNION ALL SELECT * FROM entropy),
of_doc AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = {k}) AS c{k}" for k in range(3))}, {text_of('spans', 'kind < 3')} AS base, {text_of('spans', 'true')} AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(c{k}, 0) AS n_{secret_scan.KINDS[k]}" for k in range(3))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(of_doc.spans, '') AS spans FROM d LEFT JOIN of_doc USING (doc_id)"""

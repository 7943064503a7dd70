"""DuckDB SQL for the queries in queries.py, put together from common table expressions."""

from __future__ import annotations

VK, EK = "vid", "eid, src, dst"
WHERE = {"": "", "a": "", "b": "WHERE event_type = 'purchase'"}


def co(rel: str, keys: str, touching: str = "<=") -> str:
    """Coalesces a relation by keys."""
    w = f"PARTITION BY {keys} ORDER BY t_start, t_end"
    inner = f"SELECT *, CASE WHEN t_start {touching} max(t_end) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS b_ FROM (SELECT DISTINCT {keys}, t_start, t_end FROM {rel}) WHERE t_start < t_end"
    return f"SELECT {keys}, min(t_start) AS t_start, max(t_end) AS t_end FROM (SELECT *, sum(b_) OVER ({w} ROWS UNBOUNDED PRECEDING) AS i_ FROM ({inner})) GROUP BY {keys}, i_"


def social(p: str = "") -> str:
    """v and e (with a prefix) of the social graph or of one of its parts."""
    return f"""{p}ev AS (SELECT event_id, ts, user_id, event_type, CAST(ts AS DATE) AS d FROM events {WHERE[p]}),
{p}v0 AS (SELECT user_id AS vid, d AS t_start, d + 1 AS t_end, event_type AS attr FROM {p}ev
  QUALIFY row_number() OVER (PARTITION BY user_id, d ORDER BY ts DESC, event_id DESC) = 1),
{p}e0 AS (SELECT src * 1000000 + dst AS eid, src, dst, d AS t_start, d + 1 AS t_end, CAST(count(*) AS INTEGER) AS attr
  FROM (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id) AS dst, d FROM {p}ev)
  WHERE src <> dst GROUP BY src, dst, d),
{p}v AS ({co(f"{p}v0", f"{VK}, attr")}), {p}e AS ({co(f"{p}e0", f"{EK}, attr")})"""


def life(name: str, v: str) -> str:
    return f"{name} AS ({co(v, VK)})"


def constrained(e: str, lives: str) -> str:
    """Edges within the lifetimes of their ends."""
    return f"""SELECT x.eid, x.src, x.dst, greatest(x.t_start, a.t_start, b.t_start) AS t_start, least(x.t_end, a.t_end, b.t_end) AS t_end, x.attr
  FROM {e} x JOIN {lives} a ON a.vid = x.src JOIN {lives} b ON b.vid = x.dst
  WHERE greatest(x.t_start, a.t_start, b.t_start) < least(x.t_end, a.t_end, b.t_end)"""


TRADE = f"""o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS d, o_orderpriority FROM orders),
tv0 AS (SELECT vid, t_start, coalesce(lead(t_start) OVER (PARTITION BY vid ORDER BY t_start), DATE '2001-09-01') AS t_end, attr
  FROM (SELECT o_custkey AS vid, d AS t_start, max(o_orderpriority) AS attr FROM o GROUP BY o_custkey, d)),
tv1 AS (SELECT * FROM tv0 WHERE t_start < t_end UNION ALL SELECT s_suppkey + 1000000000, DATE '1995-01-01', DATE '2001-09-01', 'S' FROM supplier),
te0 AS (SELECT o_custkey * 1000000 + l_suppkey AS eid, o_custkey AS src, l_suppkey + 1000000000 AS dst, CAST(date_trunc('month', d) AS DATE) AS t_start,
  CAST(date_trunc('month', d) + INTERVAL 1 MONTH AS DATE) AS t_end, CAST(sum(l_quantity) AS BIGINT) AS attr
  FROM lineitem JOIN o ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey, date_trunc('month', d)),
v AS ({co("tv1", f"{VK}, attr")}), {life("tl", "tv1")}, te1 AS ({constrained("te0", "tl")}), e AS ({co("te1", f"{EK}, attr")})"""


def seq(*rels: str) -> str:
    points = " UNION ".join(f"SELECT {c} AS d FROM {r}" for r in rels for c in ("t_start", "t_end"))
    return f"SELECT row_number() OVER (ORDER BY d) - 1 AS idx, d AS t_start, lead(d) OVER (ORDER BY d) AS t_end FROM ({points}) QUALIFY lead(d) OVER (ORDER BY d) IS NOT NULL"


def cut(keys: str, out: str, *rels: str) -> str:
    """Elementary intervals per key of some relations, under a name."""
    points = " UNION ".join(f"SELECT {keys}, {c} AS d FROM {r}" for r in rels for c in ("t_start", "t_end"))
    w = f"PARTITION BY {keys} ORDER BY d"
    return f"{out} AS (SELECT {keys}, d AS t_start, lead(d) OVER ({w}) AS t_end FROM ({points}) QUALIFY lead(d) OVER ({w}) IS NOT NULL)"


def on_cut(rel: str, cuts: str, keys: str, cols: str = "attr") -> str:
    """A relation on the elementary intervals of its keys."""
    same = " AND ".join(f"r.{k.strip()} = c.{k.strip()}" for k in keys.split(","))
    own = ", ".join(f"r.{k.strip()}" for k in keys.split(","))
    return f"SELECT {own}, c.t_start, c.t_end, {', '.join('r.' + c.strip() for c in cols.split(','))} FROM {rel} r JOIN {cuts} c ON {same} AND c.t_start >= r.t_start AND c.t_end <= r.t_end"


SOCIAL = social()
SNAP = f"""{SOCIAL}, seq AS ({seq("v", "e")}),
sv AS (SELECT vid, idx AS t, attr FROM v JOIN seq s ON s.t_start >= v.t_start AND s.t_end <= v.t_end),
se AS (SELECT eid, src, dst, idx AS t, attr FROM e JOIN seq s ON s.t_start >= e.t_start AND s.t_end <= e.t_end),
both_ways AS (SELECT t, src, dst FROM se UNION ALL SELECT t, dst, src FROM se)"""


def attached(value: str, values: str, name: str) -> str:
    """Vertices with a value per snapshot, coalesced."""
    rel = f"(SELECT sv.vid, s.t_start, s.t_end, sv.attr, {value} AS {name} FROM sv LEFT JOIN {values} x ON x.vid = sv.vid AND x.t = sv.t JOIN seq s ON s.idx = sv.t)"
    return co(rel, f"vid, attr, {name}")


def zoomed(rel: str, keys: str, reduce: str, keeps: str, index: str, start: str) -> str:
    """Zoom by calendar windows: index gives a date's window number, start a window's start; s_ and e_ are a window's ends."""
    each = f"SELECT r.*, unnest(range({index.format('r.t_start')}, {index.format('(r.t_end - 1)')} + 1)) AS w_ FROM {rel} r, anchor"
    ends = f"SELECT q.*, {start.format('w_')} AS s_, {start.format('(w_ + 1)')} AS e_ FROM ({each}) q, anchor"
    return f"SELECT {keys}, s_ AS t_start, e_ AS t_end, {reduce} AS attr FROM ({ends}) GROUP BY {keys}, s_, e_ HAVING {keeps.format(c='sum(least(t_end, e_) - greatest(t_start, s_))', w='(e_ - s_)')}"


WEEK = ("CAST(floor(({} - a_) / 7.0) AS BIGINT)", "a_ + CAST(7 * {} AS INTEGER)")


def months(n: int) -> tuple[str, str]:
    return f"CAST(floor(((year({{}}) - year(a_)) * 12 + month({{}}) - month(a_)) / {n}.0) AS BIGINT)".replace("month({})", "month({0})").replace("year({})", "year({0})"), f"CAST(a_ + to_months(CAST({n} * {{}} AS INTEGER)) AS DATE)"


QUANTIFIERS = {"always": "{c} > 0.99 * {w}", "exists": "{c} > 0", "most": "{c} > 0.5 * {w}", "atleast": "{c} >= 0.25 * {w}"}


def time_zoom(base: str, anchor: str, unit: tuple[str, str], vq: str, eq: str, which: str, e_reduce: str = "max(attr)") -> str:
    zv = zoomed("v", VK, "arg_min(attr, t_start)", QUANTIFIERS[vq], *unit)
    ze = zoomed("e", EK, e_reduce, QUANTIFIERS[eq], *unit)
    tail = f"SELECT * FROM ({co('zv', f'{VK}, attr')})" if which == "v" else f"SELECT * FROM ({co('(' + constrained('ze', 'zl') + ')', f'{EK}, attr')})"
    return f"WITH {base}, anchor AS (SELECT {anchor} AS a_ FROM v), zv AS ({zv}), ze AS ({ze}), {life('zl', 'zv')} {tail}"


def change_zoom(n: int, vq: str, eq: str, which: str) -> str:
    def z(rel: str, keys: str, reduce: str, keeps: str) -> str:
        return f"""SELECT {keys}, s_ AS t_start, e_ AS t_end, {reduce} AS attr FROM {rel} r JOIN win ON r.t_start < e_ AND s_ < r.t_end
  GROUP BY {keys}, s_, e_ HAVING {keeps.format(c="sum(least(r.t_end, e_) - greatest(r.t_start, s_))", w="(e_ - s_)")}"""

    tail = co("zv", f"{VK}, attr") if which == "v" else co("(" + constrained("ze", "zl") + ")", f"{EK}, attr")
    return f"""WITH {SOCIAL}, seq AS ({seq("v", "e")}), win AS (SELECT idx // {n} AS w_, min(t_start) AS s_, max(t_end) AS e_ FROM seq GROUP BY idx // {n}),
zv AS ({z("v", VK, "arg_min(attr, r.t_start)", QUANTIFIERS[vq])}), ze AS ({z("e", EK, "max(attr)", QUANTIFIERS[eq])}), {life("zl", "zv")} {tail}"""


AB = f"{social('a')}, {social('b')}"
AB_CUT = f"{AB}, {cut(VK, 'vc', 'av', 'bv')}, {cut(EK, 'ec', 'ae', 'be')}, avp AS ({on_cut('av', 'vc', VK)}), bvp AS ({on_cut('bv', 'vc', VK)}), aep AS ({on_cut('ae', 'ec', EK)}), bep AS ({on_cut('be', 'ec', EK)})"


def union(a: str, b: str, keys: str, f: str) -> str:
    both = f"SELECT {keys}, t_start, t_end, CASE WHEN l.attr IS NOT NULL AND r.attr IS NOT NULL THEN {f} ELSE coalesce(l.attr, r.attr) END AS attr FROM {a} l FULL JOIN {b} r USING ({keys}, t_start, t_end)"
    return co(f"({both})", f"{keys}, attr")


def minus(a: str, b: str, keys: str) -> str:
    return f"SELECT * FROM {a} l WHERE NOT EXISTS (SELECT 1 FROM {b} r WHERE {' AND '.join(f'l.{k.strip()} = r.{k.strip()}' for k in (keys + ', t_start, t_end').split(','))})"


def common(a: str, b: str, keys: str, f: str) -> str:
    own = ", ".join(f"l.{k.strip()}" for k in keys.split(","))
    same = " AND ".join(f"l.{k.strip()} = r.{k.strip()}" for k in keys.split(","))
    both = f"SELECT {own}, greatest(l.t_start, r.t_start) AS t_start, least(l.t_end, r.t_end) AS t_end, {f} AS attr FROM {a} l JOIN {b} r ON {same} AND l.t_start < r.t_end AND r.t_start < l.t_end"
    return co(f"({both})", f"{keys}, attr")


ENDS = "ends AS (SELECT src AS vid, t_start, t_end FROM e UNION ALL SELECT dst, t_start, t_end FROM e)"
DEGREE = f"{SOCIAL}, {ENDS}, {cut(VK, 'dc', 'ends')}, deg0 AS (SELECT c.vid, c.t_start, c.t_end, CAST(count(*) AS INTEGER) AS degree FROM ends r JOIN dc c ON r.vid = c.vid AND c.t_start >= r.t_start AND c.t_end <= r.t_end GROUP BY ALL), deg AS ({co('deg0', 'vid, degree')})"

TRIPLETS = """SELECT e.eid, e.src, e.dst, greatest(e.t_start, a.t_start, b.t_start) AS t_start, least(e.t_end, a.t_end, b.t_end) AS t_end, e.attr, a.attr AS src_attr, b.attr AS dst_attr
FROM e JOIN v a ON a.vid = e.src JOIN v b ON b.vid = e.dst WHERE greatest(e.t_start, a.t_start, b.t_start) < least(e.t_end, a.t_end, b.t_end)"""


def messages(sent: str) -> str:
    """Counts of messages (vid, t_start, t_end) on vertices, 0 where there are none."""
    return f"""WITH {SOCIAL}, m AS ({sent}), {cut(VK, "mc", "m")}, got AS (SELECT c.vid, c.t_start, c.t_end, count(*) AS agg FROM m r JOIN mc c ON r.vid = c.vid AND c.t_start >= r.t_start AND c.t_end <= r.t_end GROUP BY ALL),
{cut(VK, "ac", "v", "got")}, vp AS ({on_cut("v", "ac", VK)}), gp AS ({on_cut("got", "ac", VK, "agg")}),
{"x0 AS (SELECT vp.*, coalesce(gp.agg, 0) AS agg FROM vp LEFT JOIN gp USING (vid, t_start, t_end))"} {co("x0", "vid, attr, agg")}"""


def pagerank(rounds: int, edges: str, tol: float = 0.0) -> str:
    steps = [f"w_ AS MATERIALIZED (SELECT t, src, dst, 0.85 / count(*) OVER (PARTITION BY t, src) AS w FROM {edges})", "d0 AS (SELECT vid, t, CAST(0.15 AS DOUBLE) AS d FROM sv)"]
    steps += [f"d{i} AS MATERIALIZED (SELECT dst AS vid, w_.t, sum(d * w) AS d FROM d{i - 1} JOIN w_ ON src = vid AND w_.t = d{i - 1}.t WHERE d > {tol} GROUP BY dst, w_.t)" for i in range(1, rounds + 1)]
    total = " UNION ALL ".join(f"SELECT * FROM d{i}" for i in range(rounds + 1))
    return f"WITH {SNAP}, {', '.join(steps)}, r_ AS (SELECT vid, t, round(sum(d) + 1e-9, 6) AS rank FROM ({total}) GROUP BY vid, t) SELECT sv.vid, s.t_start, s.t_end, rank FROM sv JOIN r_ USING (vid, t) JOIN seq s ON s.idx = sv.t"


def distances(edges: str, landmarks: str) -> str:
    """Breadth first: a row is new if its vertex, snapshot and landmark have none yet."""
    return f"""WITH RECURSIVE {SNAP}, back AS (SELECT DISTINCT t, dst AS vid, src AS nx FROM {edges} WHERE src <> dst),
bfs(vid, t, landmark, d) USING KEY (vid, t, landmark) AS (SELECT vid, t, vid, 0 FROM sv WHERE vid IN ({landmarks}) UNION
  SELECT DISTINCT b.nx, b.t, x.landmark, x.d + 1 FROM bfs x JOIN back b ON b.vid = x.vid AND b.t = x.t
  LEFT JOIN recurring.bfs r ON r.vid = b.nx AND r.t = b.t AND r.landmark = x.landmark WHERE r.vid IS NULL)
SELECT x.vid, s.t_start, s.t_end, x.landmark, CAST(x.d AS INTEGER) AS d FROM bfs x JOIN seq s ON s.idx = x.t"""


def pregel(rounds: int, active: str) -> str:
    """The greatest id that reaches a vertex along edges, in supersteps: an edge sends if its ends were active."""
    steps = ["l0 AS (SELECT vid, t, vid AS x, true AS on_ FROM sv)"]
    for i in range(rounds):
        sent = f"SELECT e.dst AS vid, e.t, max(p.x) AS x FROM se e JOIN l{i} p ON p.vid = e.src AND p.t = e.t JOIN l{i} q ON q.vid = e.dst AND q.t = e.t WHERE p.x > q.x AND ({active}) GROUP BY e.dst, e.t"
        steps.append(f"l{i + 1} AS MATERIALIZED (SELECT l.vid, l.t, greatest(l.x, coalesce(m.x, l.x)) AS x, m.x IS NOT NULL AS on_ FROM l{i} l LEFT JOIN ({sent}) m ON m.vid = l.vid AND m.t = l.t)")
    return f"WITH {SNAP}, {', '.join(steps)} {attached('x.x', f'l{rounds}', 'value')}"


def partition(strategy: str, n: int, runs: int) -> str:
    """Rows by part and snapshot; i is a run of snapshots, k how many there are."""
    h = lambda c: f"((({c}) % 2147483647 * 48271 + 11) % 2147483647)"
    random = f"(({h('least(src, dst)')} * 31 + {h('greatest(src, dst)')}) % 2147483647)"
    two_d = lambda size: f"(({h('dst')} % ceil(sqrt({size}))::BIGINT * ceil(sqrt({size}))::BIGINT + {h('src')} % ceil(sqrt({size}))::BIGINT) % {size})"
    size = f"({n} // k + CASE WHEN i < {n} % k THEN 1 ELSE 0 END)"
    spread = f"i * ({n} // k) + least(i, {n} % k) + {two_d(size) if '2d' in strategy else f'{random} % {size}'}"
    runs_of = f"CASE WHEN i < (k % {n}) * (k // {n} + 1) THEN i // (k // {n} + 1) ELSE k % {n} + (i - (k % {n}) * (k // {n} + 1)) // greatest(k // {n}, 1) END"
    part = {
        "canonical_random_vertex_cut": f"{random} % {n}", "edge_partition_2d": two_d(str(n)),
        "naive_temporal": f"CASE WHEN k >= {n} THEN i % {n} ELSE {spread} END",
    }.get(strategy, f"CASE WHEN k >= {n} THEN {runs_of} ELSE {spread} END")
    width = runs if strategy.startswith("hybrid") else 1
    return f"WITH {SNAP}, r AS (SELECT se.*, t // {width} AS i, (SELECT CAST(ceil(count(*) / {width}) AS BIGINT) FROM seq) AS k FROM se) SELECT CAST({part} AS INTEGER) AS part, t, count(*) AS n FROM r GROUP BY ALL"


TRIANGLES = f"""{SNAP}, p_ AS (SELECT DISTINCT t, least(src, dst) AS a, greatest(src, dst) AS b FROM se WHERE src <> dst),
tri AS (SELECT x.t, x.a, x.b, y.b AS c FROM p_ x JOIN p_ y ON x.t = y.t AND x.b = y.a JOIN p_ z ON z.t = x.t AND z.a = x.a AND z.b = y.b),
n_ AS (SELECT vid, t, CAST(count(*) AS INTEGER) AS n FROM (SELECT a AS vid, t FROM tri UNION ALL SELECT b, t FROM tri UNION ALL SELECT c, t FROM tri) GROUP BY vid, t)"""

POINTS = f"""{DEGREE}, first_ AS (SELECT vid, min(t_start) AS a_ FROM deg GROUP BY vid),
each_ AS (SELECT vid, unnest(range(t_start - a_, t_end - a_ + 1)) AS i, t_start, t_end, degree AS value FROM deg JOIN first_ USING (vid)),
points AS (SELECT vid, CAST(i AS INTEGER) AS i, arg_max(value, t_start) AS value FROM each_ GROUP BY vid, i)"""

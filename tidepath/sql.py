"""DuckDB SQL that the routing queries are held against: common tables, and the search as a chain of levels."""

from __future__ import annotations

NOW = 1705276800
DAY0 = 1704067200

NODES = """nodes AS (SELECT n_nationkey::INT AS node_idx, n_name AS node_id, (n_nationkey * 37 % 120 - 60)::DOUBLE AS x, (n_nationkey * 53 % 300 - 150)::DOUBLE AS y FROM nation)"""
EDGES = """pairs AS (SELECT s_nationkey::INT AS u, c_nationkey::INT AS v, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> c_nationkey GROUP BY ALL),
edges AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY u, v) - 1)::INT AS edge_idx, 'E' || u || '-' || v AS edge_id, u AS origin, v AS dest, (20 * (1 + n % 97))::FLOAT AS base_weight, (1 + u % 5)::INT AS profile_id FROM pairs)"""
PROFILES = """kinds(profile_id, event_type, day_mask) AS (VALUES (1, 'view', 127), (2, 'click', 31), (3, 'purchase', 96), (4, 'signup', 62), (5, 'error', 127)),
hours AS (SELECT profile_id, hour(ts) AS h, count(*) AS n FROM events JOIN kinds USING (event_type) GROUP BY ALL),
profiles AS MATERIALIZED (SELECT k.profile_id, day_mask, [(1.0 + (coalesce(m.n, 0) % 16) / 16.0)::FLOAT FOR m IN list_sort(list)] AS buckets
  FROM (SELECT k.profile_id, k.day_mask, list({'h': g.h, 'n': h.n}) AS list FROM kinds k CROSS JOIN (SELECT unnest(range(24)) AS h) g LEFT JOIN hours h ON h.profile_id = k.profile_id AND h.h = g.h WHERE k.profile_id IN (SELECT profile_id FROM hours) GROUP BY ALL) k)"""
TURNS = """turns AS MATERIALIZED (SELECT a.edge_idx AS from_edge, b.edge_idx AS to_edge, CASE WHEN (a.origin + b.dest) % 13 = 0 THEN 'inf'::FLOAT ELSE 5::FLOAT END AS penalty FROM edges a JOIN edges b ON a.dest = b.origin WHERE (a.origin + b.dest) % 13 = 0 OR (a.origin + b.dest) % 11 = 0)"""
UPDATES = """updates AS (SELECT (event_id % (SELECT count(*) FROM edges))::INT AS edge_idx, CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 0.25 WHEN 'purchase' THEN 0.5 ELSE 1 END::FLOAT AS speed_factor, epoch_us(ts) // 1000000 AS valid_from, epoch_us(ts) // 1000000 + 3600 AS valid_until, event_id AS ordinal FROM events)"""
OVERLAY = f"""overlay AS MATERIALIZED (SELECT edge_idx, arg_max(speed_factor, ordinal) AS speed_factor, arg_max(valid_from, ordinal) AS valid_from, arg_max(valid_until, ordinal) AS valid_until FROM updates WHERE valid_until > {NOW} GROUP BY edge_idx)"""
PRICED = """priced AS MATERIALIZED (SELECT e.*, p.buckets, p.day_mask, o.speed_factor, o.valid_from, o.valid_until FROM edges e LEFT JOIN profiles p USING (profile_id) LEFT JOIN overlay o USING (edge_idx))"""
GRAPH = f"{EDGES},\n{PROFILES},\n{TURNS}"
LIVE = f"{GRAPH},\n{UPDATES},\n{OVERLAY},\n{PRICED}"


def with_(*parts: str, body: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + body


def lerp(tick: str, buckets: str = "buckets") -> str:
    frac = f"(({tick} % 86400) / 3600.0::DOUBLE)"
    low = f"(({tick} % 86400) // 3600)::INT"
    a, b = f"{buckets}[{low} + 1]", f"{buckets}[({low} + 1) % 24 + 1]"
    return f"CASE WHEN {buckets} IS NULL THEN 1::FLOAT ELSE ({a}::DOUBLE + ({b} - {a})::FLOAT::DOUBLE * ({frac} - {low}))::FLOAT END"


def day_of_week(sec: str) -> str:
    return f"(({sec} // 86400 + 3) % 7)"


def lerp_day(tick: str) -> str:
    """Interpolated, with day masks, in UTC."""
    day, low = day_of_week(tick), f"(({tick} % 86400) // 3600)::INT"
    frac = f"(({tick} % 86400) / 3600.0::DOUBLE)"
    on = lambda d: f"((day_mask >> ({d})::INT) & 1 = 1)"
    a = f"(CASE WHEN {on(day)} THEN buckets[{low} + 1] ELSE 1::FLOAT END)"
    b = f"(CASE WHEN {on(f'CASE WHEN {low} = 23 THEN ({day} + 1) % 7 ELSE {day} END')} THEN buckets[({low} + 1) % 24 + 1] ELSE 1::FLOAT END)"
    return f"CASE WHEN buckets IS NULL THEN 1::FLOAT WHEN {frac} = {low} THEN {a} ELSE ({a}::DOUBLE + ({b} - {a})::FLOAT::DOUBLE * ({frac} - {low}))::FLOAT END"


def penalty(tick: str, s: str = "") -> str:
    return f"CASE WHEN {s}valid_until IS NULL OR {tick} < {s}valid_from OR {tick} >= {s}valid_until THEN 1::FLOAT WHEN {s}speed_factor = 0 THEN 'inf'::FLOAT ELSE (1::DOUBLE / {s}speed_factor::DOUBLE)::FLOAT END"


def search(requests: str, levels: int, bounded: bool, through: bool, scenario: bool = False) -> str:
    """CTEs req, and r (q, target, cost, arrival, path) of labels that reach a target: requests selects q, sc, source, target, departure."""
    pe = "priced e ON e.origin = f.node" + (" AND e.sc = f.sc" if scenario else "")
    sc = "f.sc"
    parts = [f"req AS MATERIALIZED ({requests})", "front0 AS MATERIALIZED (SELECT DISTINCT q, sc, source AS node, NULL::INT AS edge_idx, 0::FLOAT AS g, departure AS t, []::INT[] AS path FROM req WHERE source <> target)"]
    for k in range(1, levels + 1):
        parts.append(f"""raw{k} AS (SELECT f.q, {sc} AS sc, e.edge_idx, e.dest, f.g, f.t, f.path, e.base_weight, {lerp('f.t', 'e.buckets')} AS m, {penalty('f.t', 'e.')} AS pen, CASE WHEN f.edge_idx IS NULL THEN 0::FLOAT ELSE coalesce(x.penalty, 0::FLOAT) END AS turn
  FROM front{k - 1} f JOIN {pe} LEFT JOIN turns x ON x.from_edge = f.edge_idx AND x.to_edge = e.edge_idx)""")
        parts.append(f"cost{k} AS (SELECT *, ((base_weight::DOUBLE * m::DOUBLE * pen::DOUBLE)::FLOAT::DOUBLE + turn::DOUBLE)::FLOAT AS c FROM raw{k} WHERE pen < 'inf'::FLOAT AND turn < 'inf'::FLOAT)")
        limit = f" LEFT JOIN (SELECT q, sc, min(cost) AS bound FROM reached{k - 1} GROUP BY ALL) b USING (q, sc) WHERE bound IS NULL OR cost <= bound" if bounded and k > 1 else ""
        fresh = f"SELECT q, sc, edge_idx, dest, cost, arrival, rnd, path FROM (SELECT q, sc, edge_idx, dest, (g::DOUBLE + c::DOUBLE)::FLOAT AS cost, CASE WHEN c <= 0 THEN t ELSE t + ceil(c::DOUBLE)::BIGINT END AS arrival, {k} AS rnd, list_append(path, edge_idx) AS path FROM cost{k}){limit}"
        both = fresh if k == 1 else f"SELECT * FROM seen{k - 1} UNION ALL {fresh}"
        parts.append(f"seen{k} AS MATERIALIZED (SELECT q, sc, edge_idx, dest, cost, arrival, rnd, path FROM (SELECT *, min(arrival) OVER (PARTITION BY q, sc, edge_idx ORDER BY cost, arrival, rnd, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM ({both})) WHERE best IS NULL OR arrival < best)")
        hits = f"SELECT s.q, s.sc, s.dest AS target, s.cost, s.arrival, s.path FROM seen{k} s JOIN (SELECT DISTINCT q, sc, target FROM req WHERE source <> target) g ON g.q = s.q AND g.sc = s.sc AND g.target = s.dest WHERE s.rnd = {k}"
        parts.append(f"reached{k} AS MATERIALIZED ({hits if k == 1 else f'SELECT * FROM reached{k - 1} UNION ALL {hits}'})")
        stop = "" if through else " AND NOT EXISTS (SELECT 1 FROM req g WHERE g.q = s.q AND g.sc = s.sc AND g.target = s.dest)"
        parts.append(f"front{k} AS MATERIALIZED (SELECT q, sc, dest AS node, edge_idx, cost AS g, arrival AS t, path FROM seen{k} s WHERE rnd = {k}{stop})")
    parts.append(f"r AS MATERIALIZED (SELECT * FROM reached{levels})")
    return ",\n".join(parts)

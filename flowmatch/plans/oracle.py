"""SQL text builders for the DuckDB oracles of the scoring queries.

The oracle computes the same integers (n1, n2, I per category) by a plain
full-outer count join, then the same score formulas written in SQL.
"""

from __future__ import annotations

from flowmatch.functions import metrics as M
from flowmatch.operators.score import CATEGORIES, SCORE_NAMES, SECTIONS


def stats_select(keys: list[str], src: str) -> str:
    """Per-pair n1_*, n2_*, i_* from ``src(keys..., category, label, c1, c2)``."""
    k = ", ".join(keys)
    cols = []
    for c in CATEGORIES:
        cols.append(f"sum(CASE WHEN category = '{c}' THEN c1 ELSE 0 END) AS n1_{c}")
        cols.append(f"sum(CASE WHEN category = '{c}' THEN c2 ELSE 0 END) AS n2_{c}")
        cols.append(f"sum(CASE WHEN category = '{c}' THEN least(c1, c2) ELSE 0 END) AS i_{c}")
    return f"SELECT {k}, {', '.join(cols)} FROM {src} GROUP BY {k}"


def _comp(method: str, c: str, p: str = "") -> tuple[str, str]:
    n1, n2, i = f"{p}n1_{c}", f"{p}n2_{c}", f"{p}i_{c}"
    return M.sql_metric(method, n1, n2, i), M.sql_weight(n1, n2)


def score_select(method: str = "dice", digits: int = 6, p: str = "",
                 scorable: str | None = None) -> str:
    """The sixteen score columns plus is_exact, as a SELECT list fragment."""
    comp = {c: _comp(method, c, p) for c in CATEGORIES}
    r = (lambda e: f"round({e}, {digits})")
    ok = scorable or "TRUE"
    out = [f"CASE WHEN {ok} THEN {r(M.sql_weighted_mean([comp[c] for c in CATEGORIES]))} ELSE 0.0 END AS overall"]
    for sec, a, b in SECTIONS:
        out.append(f"CASE WHEN {ok} THEN {r(M.sql_weighted_mean([comp[a], comp[b]]))} END AS {sec}_overall")
        out.append(f"CASE WHEN {ok} THEN {r(comp[a][0])} END AS {SCORE_NAMES[a]}")
        out.append(f"CASE WHEN {ok} THEN {r(comp[b][0])} END AS {SCORE_NAMES[b]}")
    any_w = " OR ".join(f"({p}n1_{c} > 0 AND {p}n2_{c} > 0)" for c in CATEGORIES)
    whole = {"precision": "{p}i_{c} = {p}n2_{c}", "recall": "{p}i_{c} = {p}n1_{c}"}.get(method, "2 * {p}i_{c} = {p}n1_{c} + {p}n2_{c}")
    all_m = " AND ".join(f"(NOT ({p}n1_{c} > 0 AND {p}n2_{c} > 0) OR {whole.format(p=p, c=c)})" for c in CATEGORIES)
    out.append(f"(({ok}) AND ({any_w}) AND ({all_m})) AS is_exact")
    return ", ".join(out)


def alt_select(method: str = "dice", digits: int = 6, p: str = "") -> str:
    comp = {c: _comp(method, c, p) for c in CATEGORIES}
    unit = {c: (s, f"CASE WHEN ({w}) > 0 THEN 1.0 ELSE 0.0 END") for c, (s, w) in comp.items()}
    sec = {n: M.sql_weighted_mean([unit[a], unit[b]]) for n, a, b in SECTIONS}
    has = {n: f"CASE WHEN (({unit[a][1]}) + ({unit[b][1]})) > 0 THEN 1 ELSE 0 END" for n, a, b in SECTIONS}
    k = f"(({has['events']}) + ({has['tasks']}) + ({has['gateways']}) + ({has['lanes']}))"
    h = f"(0.5 / {k})"
    overall = (f"0.5 * ({sec['flows']}) + {h} * ({sec['tasks']}) + {h} * ({sec['events']}) "
               f"+ {h} * ({sec['gateways']}) + {h} * ({sec['lanes']})")
    out = [f"round(CASE WHEN {k} = 0 THEN 0.0 ELSE {overall} END, {digits}) AS overall"]
    for n, _, _ in SECTIONS:
        out.append(f"round({sec[n]}, {digits}) AS {n}_overall")
    return ", ".join(out)


# The trace model of the event table, in SQL (mirrors plans/traces.py).
TRACE_CTES = """
ev AS (
  SELECT user_id, CAST(date_trunc('week', ts) AS DATE) AS week, ts, event_id, event_type
  FROM events),
seq AS (
  SELECT *, lead(event_type) OVER (PARTITION BY user_id, week ORDER BY ts, event_id) AS nxt,
         row_number() OVER (PARTITION BY user_id, week ORDER BY ts, event_id) AS rn
  FROM ev),
lab AS (
  SELECT user_id, week, 'task_names' AS category, event_type AS label FROM seq
  UNION ALL SELECT user_id, week, 'task_types', 'User' FROM seq
  UNION ALL SELECT user_id, week, 'seq_flows', event_type || '  ' || coalesce(nxt, 'end') FROM seq
  UNION ALL SELECT user_id, week, 'seq_flows', 'start  ' || event_type FROM seq WHERE rn = 1
  UNION ALL SELECT user_id, week, 'event_names', 'start' FROM seq WHERE rn = 1
  UNION ALL SELECT user_id, week, 'event_names', 'end' FROM seq WHERE rn = 1
  UNION ALL SELECT user_id, week, 'event_types', 'StartNoneEvent' FROM seq WHERE rn = 1
  UNION ALL SELECT user_id, week, 'event_types', 'EndNoneEvent' FROM seq WHERE rn = 1),
cnt AS (SELECT user_id, week, category, label, count(*) AS c FROM lab GROUP BY user_id, week, category, label),
tr AS (SELECT DISTINCT user_id, week FROM ev),
pp AS (
  SELECT * FROM (
    SELECT user_id, week, lead(week) OVER (PARTITION BY user_id ORDER BY week) AS next_week FROM tr)
  WHERE next_week IS NOT NULL),
sides AS (
  SELECT p.user_id, p.week, p.next_week, a.category, a.label, a.c AS c1, 0 AS c2
  FROM pp p JOIN cnt a ON a.user_id = p.user_id AND a.week = p.week
  UNION ALL
  SELECT p.user_id, p.week, p.next_week, b.category, b.label, 0 AS c1, b.c AS c2
  FROM pp p JOIN cnt b ON b.user_id = p.user_id AND b.week = p.next_week),
perlabel AS (
  SELECT user_id, week, next_week, category, label, sum(c1) AS c1, sum(c2) AS c2
  FROM sides GROUP BY user_id, week, next_week, category, label)
"""


def trace_pair_stats_sql() -> str:
    """WITH-clause body ending in ``st`` (per trace pair stats)."""
    return TRACE_CTES + ", st AS (" + stats_select(["user_id", "week", "next_week"], "perlabel") + ")"

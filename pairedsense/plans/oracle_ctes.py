"""SQL twins of the bindings, as common table expressions."""

from __future__ import annotations

T = "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6"

CTES: dict[str, str] = {
    "timed": f"SELECT event_id, user_id AS subject_id, event_type, value, {T} AS t FROM events",
    "series": "SELECT subject_id, t, value AS v FROM timed",
    "ann": """SELECT subject_id, event_id, t AS s, t + value * CAST(600 AS DOUBLE) AS e,
        CASE WHEN event_id % 2 = 1 THEN 'hypo' ELSE 'osa' END AS event_type
        FROM timed WHERE event_type = 'error'""",
    "awake": "SELECT subject_id, t AS s, t + value * CAST(600 AS DOUBLE) AS e FROM timed WHERE event_type = 'signup'",
    "anchors": """SELECT subject_id, event_id, t, value / CAST(10 AS DOUBLE) AS lag,
        CAST(event_id % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS correlation FROM timed WHERE event_type = 'click'""",
    "rec": """SELECT subject_id, max(CASE WHEN event_type = 'click' THEN t END) AS recorder_sec,
        max(CASE WHEN event_type = 'view' THEN t END) AS phone_sec,
        least(max(CASE WHEN event_type = 'click' THEN t END), max(CASE WHEN event_type = 'view' THEN t END)) AS common_sec
        FROM timed WHERE event_type IN ('click', 'view') GROUP BY subject_id
        HAVING count(CASE WHEN event_type = 'click' THEN 1 END) > 0 AND count(CASE WHEN event_type = 'view' THEN 1 END) > 0""",
    # Merged awake islands: a row opens one when nothing earlier reaches it.
    "awake_pos": "SELECT * FROM awake WHERE e > s",
    "awake_open": """SELECT a.subject_id, a.s FROM awake_pos a WHERE NOT EXISTS (
        SELECT 1 FROM awake_pos b WHERE b.subject_id = a.subject_id AND b.s < a.s AND b.e >= a.s) GROUP BY a.subject_id, a.s""",
    "awake_merged": """SELECT o.subject_id, o.s, max(p.e) AS e FROM awake_open o JOIN awake_pos p
        ON p.subject_id = o.subject_id AND p.s >= o.s
        AND NOT EXISTS (SELECT 1 FROM awake_open q WHERE q.subject_id = o.subject_id AND q.s > o.s AND q.s <= p.s)
        GROUP BY o.subject_id, o.s""",
    "masked_series": """SELECT x.subject_id, x.t, x.v,
        EXISTS (SELECT 1 FROM awake_pos w WHERE w.subject_id = x.subject_id AND x.t >= w.s AND x.t <= w.e) AS masked
        FROM series x""",
    "based": """SELECT x.subject_id, x.t, x.v, x.masked,
        (SELECT max(y.v) FROM series y WHERE y.subject_id = x.subject_id AND y.t <= x.t AND y.t >= x.t - 604800) AS baseline
        FROM masked_series x""",
    "hits": """SELECT *, baseline - v AS d, (baseline - v >= 30 AND NOT masked) AS hit,
        row_number() OVER (PARTITION BY subject_id ORDER BY t) AS rn FROM based""",
    "islands": """SELECT *, rn - row_number() OVER (PARTITION BY subject_id ORDER BY t) AS grp,
        lag(d) OVER (PARTITION BY subject_id ORDER BY t) AS pd, lag(t) OVER (PARTITION BY subject_id ORDER BY t) AS pt,
        lag(rn) OVER (PARTITION BY subject_id ORDER BY t) AS prn FROM hits WHERE hit""",
    "runs": """SELECT subject_id, min(t) AS s, max(t) AS e, max(t) - min(t) AS duration, max(d) AS max_drop,
        coalesce(sum(CASE WHEN prn = rn - 1 THEN (d + pd) / 2 * (t - pt) END), 0) AS area
        FROM islands WHERE subject_id IN (SELECT subject_id FROM series GROUP BY subject_id HAVING count(*) >= 10)
        GROUP BY subject_id, grp HAVING max(t) - min(t) >= 86400""",
    "devices": """SELECT subject_id, CAST(floor(t / 86400) AS BIGINT) AS day,
        CASE WHEN event_type = 'click' THEN 'R' ELSE 'S' END AS device, avg(value) AS value
        FROM timed WHERE event_type IN ('click', 'view') GROUP BY ALL""",
    "pairs": """SELECT r.subject_id, r.day, r.value AS r, s.value AS s FROM devices r JOIN devices s
        ON s.subject_id = r.subject_id AND s.day = r.day AND r.device = 'R' AND s.device = 'S'""",
    "lines": """SELECT l_orderkey, l_linenumber, CAST(max(l_returnflag) = 'R' AS INTEGER) AS label,
        max(l_suppkey) AS subject_id, CASE WHEN max(l_linestatus) = 'O' THEN 'R' ELSE 'S' END AS device
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "pred": """SELECT l_orderkey || '_' || l_linenumber AS sample_id, subject_id, device, label,
        CAST(subject_id % 5 AS INTEGER) AS fold, 'm' || m AS arm,
        CAST((l_orderkey * 7919 * m + l_linenumber * 104729) % 1009 AS DOUBLE) / CAST(1009 AS DOUBLE) AS probability
        FROM lines CROSS JOIN (VALUES (1), (2)) AS arms(m)""",
    "results": """SELECT *, CASE WHEN subject_id % 2 = 0 THEN 'tree' ELSE 'linear' END AS classifier,
        (CASE WHEN length(sample_id) % 2 = 0 THEN 'R' ELSE 'S' END) || '_' || device AS protocol FROM pred""",
    "runlog": """SELECT o_custkey AS experiment, o_orderpriority AS arm, o_orderdate AS finished, o_orderkey AS path,
        o_orderstatus AS status, o_totalprice AS score FROM orders""",
    "vectors": """SELECT vec_id AS sample_id, embedding, CASE WHEN label % 2 = 0 THEN 'R' ELSE 'S' END AS device,
        CAST(label >= 5 AS INTEGER) AS label, vec_id % 25 AS subject_id, CAST(vec_id % 5 AS INTEGER) AS fold FROM embeddings""",
    "samples": "SELECT subject_id, event_id, CAST(floor(t / 3600) AS BIGINT) AS frame, value AS v, t FROM timed",
}

NEEDS: dict[str, tuple[str, ...]] = {
    "series": ("timed",), "ann": ("timed",), "awake": ("timed",), "anchors": ("timed",), "rec": ("timed",),
    "awake_pos": ("awake",), "awake_open": ("awake_pos",), "awake_merged": ("awake_open",),
    "masked_series": ("series", "awake_pos"), "based": ("masked_series",), "hits": ("based",), "islands": ("hits",),
    "runs": ("islands",), "devices": ("timed",), "pairs": ("devices",), "pred": ("lines",), "results": ("pred",),
    "samples": ("timed",),
}


# Tail areas by Simpson's rule over 2,000 steps from 0 to the statistic.
STEPS = "CROSS JOIN (SELECT unnest(range(0, 2001)) AS i)"
WEIGHT = "CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
NORMAL_TAIL = f"1 - 2 * any_value(z) / 6000 * sum({WEIGHT} * exp(-pow(z * i / 2000, 2) / 2) / sqrt(2 * pi()))"
T_TAIL = f"""1 - 2 * any_value(abs(t)) / 6000 * sum({WEIGHT} * exp(lgamma(n / 2.0::DOUBLE) - lgamma((n - 1) / 2.0::DOUBLE)) / sqrt((n - 1) * pi())
    * pow(1 + pow(t * i / 2000, 2) / (n - 1), -n / 2.0::DOUBLE))"""


# Accuracy and F1 of every subject of an arm.
SUBJECT_SQL = """subj AS (SELECT arm, subject_id, avg(CASE WHEN (probability >= 0.5) = (label = 1) THEN 1.0::DOUBLE ELSE 0 END) AS accuracy,
    coalesce(2 * CAST(count(*) FILTER (label = 1 AND probability >= 0.5) AS DOUBLE) / nullif(2 * count(*) FILTER (label = 1 AND probability >= 0.5)
    + count(*) FILTER (label = 0 AND probability >= 0.5) + count(*) FILTER (label = 1 AND probability < 0.5), 0), 0) AS f1 FROM pred GROUP BY arm, subject_id)"""


def _closure(names: tuple[str, ...]) -> list[str]:
    seen: list[str] = []

    def visit(name: str) -> None:
        for need in NEEDS.get(name, ()):
            visit(need)
        if name not in seen:
            seen.append(name)

    for name in names:
        visit(name)
    return seen


def with_ctes(names: str, body: str, extra: str = "") -> str:
    """``body`` below the named bindings, then ``extra`` expressions local to one query."""
    parts = [f"{n} AS ({CTES[n]})" for n in _closure(tuple(names.split()))]
    if extra:
        parts.append(extra.strip().rstrip(","))
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body.strip() if parts else body.strip()

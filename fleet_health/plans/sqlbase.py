"""DuckDB SQL for the derived fixtures (FIXTURES.md §2), used as CTEs by the
oracle strings.  Literals are cast to DOUBLE so both engines compute the
same IEEE values."""

from __future__ import annotations

METRICS = """
metrics AS (
  SELECT host_id, sample_id, "timestamp", cpu_percent, memory_percent,
         0.16::DOUBLE * memory_percent AS memory_used_gb,
         16.0::DOUBLE - 0.16::DOUBLE * memory_percent AS memory_available_gb,
         disk_usage_percent,
         5.12::DOUBLE * disk_usage_percent AS disk_used_gb,
         512.0::DOUBLE - 5.12::DOUBLE * disk_usage_percent AS disk_free_gb,
         is_anomaly
  FROM (
    SELECT user_id AS host_id, event_id AS sample_id, ts AS "timestamp",
           least(value, 100.0::DOUBLE) AS cpu_percent,
           least(100.0::DOUBLE, 40.0::DOUBLE + 0.6::DOUBLE * CAST(json_extract(props, '$.k') AS DOUBLE)) AS memory_percent,
           CAST(30 + (event_id * 7 + user_id * 13) % 71 AS DOUBLE) AS disk_usage_percent,
           CAST(event_type = 'error' AND value > 60 AS INTEGER) AS is_anomaly
    FROM events) e0
)"""

SCORED = """
scored AS (
  SELECT m.*, least(1.0::DOUBLE, e.value / 120.0::DOUBLE) AS anomaly_probability
  FROM metrics m JOIN events e ON e.event_id = m.sample_id
)"""

VOTES = """
votes AS (
  SELECT user_id AS host_id, event_id AS sample_id, ts AS "timestamp",
         CAST(value > 80 AS INTEGER) AS pred_a,
         CAST(CAST(json_extract(props, '$.k') AS DOUBLE) > 90 AS INTEGER) AS pred_b,
         CAST(CAST(30 + (event_id * 7 + user_id * 13) % 71 AS DOUBLE) > 95 AS INTEGER) AS pred_c,
         CAST(event_type = 'error' AND value > 60 AS INTEGER) AS truth
  FROM events
)"""


def with_ctes(body: str, *ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + body


def m(body: str, *more: str) -> str:
    """SQL over the ``metrics`` CTE (plus any further CTEs)."""
    return with_ctes(body, METRICS, *more)


def calendar_sql(ts: str = '"timestamp"', cyclical: bool = False) -> str:
    s = (f"CAST(hour({ts}) AS INTEGER) AS hour, CAST(isodow({ts}) - 1 AS INTEGER) AS day_of_week, "
         f"CAST(isodow({ts}) - 1 >= 5 AS INTEGER) AS is_weekend")
    if cyclical:
        s += (f", sin(2 * pi() * hour({ts}) / 24.0::DOUBLE) AS hour_sin"
              f", cos(2 * pi() * hour({ts}) / 24.0::DOUBLE) AS hour_cos")
    return s

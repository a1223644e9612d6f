"""Named queries over the driver tables, each with its check in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Views of the checks, in the SQL both engines share.
VIEWS = {
    "stream_rows": """
        SELECT event_id, concat(user_id, '_', event_type, '_', strftime(ts, '%Y%m')) AS record_id,
               user_id % 3 AS project_id,
               concat('GW-', lpad(CAST(user_id % 8 + 1 AS varchar), 8, '0')) AS gateway_code,
               concat('SN-', lpad(CAST(user_id AS varchar), 8, '0')) AS dev_code,
               user_id AS measure_point_id,
               CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3
                               WHEN 'signup' THEN 4 ELSE 5 END AS data_type,
               value, round(value * 100) AS cents, ts AS value_time, event_type, user_id
        FROM events""",
    "readings": """
        SELECT *, CAST(row_number() OVER (PARTITION BY record_id ORDER BY value_time, event_id) - 1
                       AS int) AS value_index,
               min(value_time) OVER (PARTITION BY record_id) AS record_time
        FROM stream_rows""",
    "records": """
        SELECT record_id, project_id, gateway_code, dev_code, measure_point_id, data_type,
               record_time, list(value ORDER BY value_index) AS vals, max(value) AS factor,
               count(*) AS n_vals
        FROM readings GROUP BY ALL""",
    "zscored": """
        SELECT *, count(*) OVER g AS n_values, avg(value) OVER g AS expected_mean,
               stddev_pop(value) OVER g AS expected_std
        FROM readings WINDOW g AS (PARTITION BY record_id)""",
    "flagged": """
        SELECT *, (value - expected_mean) / nullif(expected_std, 0) AS z_score,
               coalesce(n_values >= 5 AND expected_std >= 0.01
                        AND abs((value - expected_mean) / nullif(expected_std, 0)) > 2.5, false)
                 AS is_outlier
        FROM zscored""",
    "devices": """
        SELECT concat('SN-', lpad(CAST(user_id AS varchar), 8, '0')) AS dev_code,
               concat('sensor-', user_id) AS name,
               CASE WHEN user_id % 4 = 0 THEN 'ED' ELSE 'SN' END AS type,
               user_id % 3 AS project_id, concat('10.0.0.', user_id % 250) AS ip, '1' AS version,
               max(ts) AS last_seen, min(ts) AS created_at
        FROM events GROUP BY user_id""",
    "heartbeats": """
        SELECT event_id, concat('SN-', lpad(CAST(user_id AS varchar), 8, '0')) AS dev_code, ts,
               CASE WHEN event_id % 5 = 0 THEN '' ELSE concat('10.0.0.', user_id % 250) END AS ip,
               CASE WHEN CAST(json_extract_string(props, '$.k') AS int) % 3 = 0 THEN ''
                    ELSE json_extract_string(props, '$.k') END AS version,
               json_extract_string(props, '$.k') AS k, event_type
        FROM events""",
}
NEEDS = {
    "readings": ["stream_rows"], "records": ["readings"],
    "zscored": ["readings"], "flagged": ["zscored"],
}


def define(name: str, text: str, *needs: str) -> None:
    """A further view for the checks."""
    VIEWS[name] = text
    NEEDS[name] = list(needs)


def with_views(text: str, *names: str) -> str:
    """`text` with the named views, and those they need, in front."""
    chosen: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS.get(name, []):
            add(other)
        if name not in chosen:
            chosen.append(name)

    for name in names:
        add(name)
    if not chosen:
        return text
    views = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in chosen)
    body = text.strip()
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views},\n{body[15:]}"
    if body.startswith("WITH "):
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query under `name`, with the SQL that must give the same rows."""
    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is defined twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_views(sql, *views)
        return fn
    return keep

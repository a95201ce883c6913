"""Shared pieces of the query registry: named SQL views for the cross-check engine, rounding."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

DIGITS = 6


def r(column, digits: int = DIGITS):
    """Rounded column, so both engines agree past the last bits of a floating sum."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, digits)


def rounded(df, *columns: str, digits: int = DIGITS):
    return df.select(
        *[r(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns]
    )


def R(expr: str, digits: int = DIGITS) -> str:
    """SQL twin of `r` (+0.0 turns a negative zero into zero)."""
    return f"(round({expr}, {digits}) + 0.0)"


VIEWS: dict[str, str] = {
    "cells_raw": """
        SELECT 'd' || lpad(CAST(l_suppkey // 25 AS VARCHAR), 6, '0') AS dataset,
               CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INTEGER) AS t,
               CAST(round(l_discount * 100) AS INTEGER) AS x,
               CAST(round(l_tax * 100) AS INTEGER) AS y,
               CAST(l_quantity AS BIGINT) AS qty,
               CAST(round(l_extendedprice * 100) AS BIGINT) AS cents
        FROM lineitem""",
    "catalog": "SELECT dataset, CAST(max(t) + 1 AS INTEGER) AS n_steps FROM cells_raw GROUP BY 1",
    "grid": """SELECT dataset, 11 AS nx, 9 AS ny, CAST(25.0 AS DOUBLE) / 10 AS dx,
               CAST(2.0 AS DOUBLE) / 8 AS dy FROM catalog""",
    "roles": """
        SELECT dataset, CASE CAST(substr(dataset, 2, 6) AS INTEGER) % 4
               WHEN 3 THEN 'test' WHEN 2 THEN 'val' ELSE 'train' END AS role FROM catalog""",
    "field": """
        SELECT a.dataset, a.t, a.x, a.y, coalesce(f.u_x, 0.0) AS u_x, coalesce(f.u_y, 0.0) AS u_y
        FROM (SELECT dataset, CAST(ts.t AS INTEGER) AS t, CAST(xs.x AS INTEGER) AS x, CAST(ys.y AS INTEGER) AS y
              FROM catalog, unnest(range(n_steps)) AS ts(t), range(11) AS xs(x), range(9) AS ys(y)) a
        LEFT JOIN (SELECT dataset, t, x, y, CAST(sum(qty) AS DOUBLE) / count(*) AS u_x,
                          CAST(sum(cents) AS DOUBLE) / count(*) / 99991.0::DOUBLE AS u_y
                   FROM cells_raw GROUP BY 1, 2, 3, 4) f
        USING (dataset, t, x, y)""",
    "vel": """
        SELECT dataset, t, x, y, 'u_x' AS channel, u_x AS u FROM field
        UNION ALL SELECT dataset, t, x, y, 'u_y', u_y FROM field""",
    "grads": """
        SELECT dataset, t, x, y, u_x, u_y,
          (coalesce(lead(u_x) OVER wx, u_x) - coalesce(lag(u_x) OVER wx, u_x)) / (2.5 * CASE WHEN x IN (0, 10) THEN 1 ELSE 2 END) AS dux_dx,
          (coalesce(lead(u_y) OVER wx, u_y) - coalesce(lag(u_y) OVER wx, u_y)) / (2.5 * CASE WHEN x IN (0, 10) THEN 1 ELSE 2 END) AS duy_dx,
          (coalesce(lead(u_x) OVER wy, u_x) - coalesce(lag(u_x) OVER wy, u_x)) / (0.25 * CASE WHEN y IN (0, 8) THEN 1 ELSE 2 END) AS dux_dy,
          (coalesce(lead(u_y) OVER wy, u_y) - coalesce(lag(u_y) OVER wy, u_y)) / (0.25 * CASE WHEN y IN (0, 8) THEN 1 ELSE 2 END) AS duy_dy
        FROM field
        WINDOW wx AS (PARTITION BY dataset, t, y ORDER BY x), wy AS (PARTITION BY dataset, t, x ORDER BY y)""",
    "series": """
        SELECT a.dataset, a.name, a.t, coalesce(f.value, 0.0) AS value
        FROM (SELECT DISTINCT event_type AS dataset,
                     'u' || lpad(CAST(user_id // 50 AS VARCHAR), 6, '0') AS name, CAST(ts.t AS INTEGER) AS t
              FROM events, range(120) AS ts(t)) a
        LEFT JOIN (SELECT event_type AS dataset, 'u' || lpad(CAST(user_id // 50 AS VARCHAR), 6, '0') AS name,
                          CAST(floor((epoch(date_trunc('second', ts)) - epoch(TIMESTAMP '2024-01-01 00:00:00')) / 21600) AS INTEGER) AS t,
                          CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*) AS value
                   FROM events GROUP BY 1, 2, 3) f
        USING (dataset, name, t)""",
}


def add_view(name: str, sql: str) -> None:
    if name in VIEWS:
        raise ValueError(f"view {name} defined twice")
    VIEWS[name] = sql


def oracle(body: str) -> str:
    """`body` with exactly the views it needs, in dependency order, as one WITH statement."""
    order: list[str] = []

    def visit(text: str) -> None:
        for word in re.findall(r"[a-z_0-9]+", text):
            if word in VIEWS and word not in order and re.search(rf"(?:\bFROM|\bJOIN|,)\s*{word}\b", text):
                visit(VIEWS[word])
                order.append(word)

    visit(body)
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({VIEWS[name]})" for name in order)
    return f"WITH {ctes}\n{body}" if ctes else body

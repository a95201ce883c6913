"""Canonical table schemas. Schemas are fixed and checked, never inferred."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELD = "dataset string, t int, x int, y int, u_x double, u_y double"
FIELD_LINE = "dataset string, t int, x int, u_x array<double>, u_y array<double>"
GRID = "dataset string, nx int, ny int, dx double, dy double"
SERIES = "dataset string, name string, t int, value double"
SPECTRUM = "dataset string, name string, k int, omega double, power double"
SCORES = "model string, grp string, metric string, value double"
FORECAST = (
    "model string, dataset string, member int, lead int, x int, y int, u_x double, u_y double"
)
COMPLEX = "struct<re:double,im:double>"

CHANNELS = ("u_x", "u_y")


def require(df, *columns: str):
    """Fail while planning when `df` lacks a column an operator needs."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}, have {df.columns}")
    return df


@dataclass(frozen=True)
class Grid:
    """The one grid all datasets share: its numbers become literals, so no join is needed."""

    nx: int
    ny: int
    dx: float
    dy: float


def with_grid(df: DataFrame, grid: Grid | DataFrame, *columns: str) -> DataFrame:
    """Adds grid columns: literals of a shared grid, or a join with a (dataset, nx, ny, dx, dy) table."""
    if isinstance(grid, Grid):
        return df.withColumns({c: F.lit(getattr(grid, c)) for c in columns})
    return df.join(grid.select("dataset", *columns), "dataset")

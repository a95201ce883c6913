import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from gridtide.schema import Grid  # noqa: E402
from gridtide.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "gridtide-tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rng():
    return np.random.default_rng(7)


@pytest.fixture
def make_field(spark):
    """{name: (T, 2, X, Y) array} as a field table."""

    def make(arrays, partitions=3):
        rows = []
        for name, a in arrays.items():
            t, x, y = np.indices((a.shape[0], *a.shape[2:]))
            rows += list(
                zip([name] * t.size, t.ravel().tolist(), x.ravel().tolist(), y.ravel().tolist(),
                    a[:, 0].ravel().tolist(), a[:, 1].ravel().tolist())
            )
        return spark.createDataFrame(
            rows, "dataset string, t int, x int, y int, u_x double, u_y double"
        ).repartition(partitions)

    return make


@pytest.fixture
def make_grid():
    return lambda names, nx, ny, dx=1.0, dy=1.0: Grid(nx, ny, dx, dy)


@pytest.fixture
def make_series(spark):
    def make(series):
        return spark.createDataFrame(
            [(n, t, float(v)) for n, s in series.items() for t, v in enumerate(s)], "name string, t int, value double"
        )

    return make

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from helpers import month  # noqa: E402

from monthcast.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def monthly(spark):
    """Build a monthly fact from {product: [quantity per month, None = no row]}."""

    def build(series: dict, category="C1"):
        rows = [
            (p, category, month(i), float(v), 10.0)
            for p, values in series.items()
            for i, v in enumerate(values)
            if v is not None
        ]
        return spark.createDataFrame(
            rows,
            "product_id string, product_category_id string, MONAT date, anz_produkt double, unit_preis double",
        )

    return build

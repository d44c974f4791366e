import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from budgetstar.model import DIMENSIONS, ENTITY_KEYS, MONEY, Star
from budgetstar.session import build_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "budgetstar-tests",
        {
            "spark.master": "local[4]",
            "spark.driver.memory": "6g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": "4",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def layers(spark):
    from budgetstar.plans.layers import Layers

    return Layers(spark, SMALL)


def money(spark, rows, columns):
    """A table whose amount columns are exact: names ending in ``monto`` or ``_yyyy``."""
    from decimal import Decimal

    from pyspark.sql import types as T

    from budgetstar.model import split_cell

    def kind(name, values):
        if name == "monto" or split_cell(name):
            return MONEY
        known = [v for v in values if v is not None]
        return T.LongType() if known and isinstance(known[0], int) and name != "anio" else (
            T.IntegerType() if name == "anio" else T.StringType()
        )

    schema = T.StructType([T.StructField(c, kind(c, [r[i] for r in rows])) for i, c in enumerate(columns)])
    exact = [
        tuple(Decimal(str(v)) if v is not None and isinstance(f.dataType, T.DecimalType) else v for v, f in zip(r, schema))
        for r in rows
    ]
    return spark.createDataFrame(exact, schema)


FACT_NAMES = [*ENTITY_KEYS, "anio", "fase", "monto"]


def facts(spark, rows):
    """Rows of (geography key, year, phase, amount); the other keys are 1."""
    return money(spark, [(g, 1, 1, 1, 1, y, p, m) for g, y, p, m in rows], FACT_NAMES)


def tiny_star(spark, rows, places, cutoff=2025):
    """A star with a geography of (key, department) and one member in every other dimension."""
    dims = {}
    for d in DIMENSIONS:
        values = [(1, *["X"] * len(d.columns))] if d.name != "geografia" else [
            (k, f"{k}", name, *["X"] * (len(d.columns) - 2)) for k, name in places
        ]
        dims[d.name] = spark.createDataFrame(values, d.schema)
    return Star(fact=facts(spark, rows), dims=dims, cutoff=cutoff)

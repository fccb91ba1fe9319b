"""Every query of the engine against its SQL."""

import pytest

from tests.oracle import compare
from tracemill import catalog

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, name):
    compare(spark, DATA, catalog.QUERIES[name], catalog.SQL[name])


def test_all_queries_have_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)


def test_groupings_add_up_to_totals(spark):
    from pyspark.sql import functions as F

    total = catalog.QUERIES["usage_totals"](spark, DATA).first()
    for by in ("harness", "model", "day", "weekday_hour", "project"):
        got = catalog.QUERIES[f"usage_by_{by}"](spark, DATA).agg(F.sum("steps").alias("steps"), F.sum("prompts").alias("prompts"), F.sum("input").alias("input"), F.round(F.sum("cost"), 4).alias("cost")).first()
        assert (got["steps"], got["prompts"], got["input"]) == (total["steps"], total["prompts"], total["input"])
        assert abs(got["cost"] - total["cost"]) < 1e-3

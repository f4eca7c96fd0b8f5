"""Inputs made by SQL are the same in Spark and DuckDB, whatever signs a text has."""

import duckdb
import pandas as pd

from tessera.plans.fixtures import _LONG, _for_spark


def test_capitals(spark):
    texts = ["Straße am Fluß", "ﬁn ŉ ß \U0001f600 é", "", None, *_LONG, *(f"a{c}b{c}" for c in _LONG)]
    d = pd.DataFrame({"id": range(len(texts)), "text": texts})  # noqa: F841
    spark.createDataFrame(list(enumerate(texts)), "id int, text string").createOrReplaceTempView("d")
    sql = "select id, upper(text) as whole, upper(substr(text, 1, 20)) as part from d order by id"
    assert [tuple(r) for r in spark.sql(_for_spark(sql)).collect()] == duckdb.sql(sql).fetchall()

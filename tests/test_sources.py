"""Sources and sinks."""

import datetime as dt
import tempfile

import pytest
from ratecard.sources.io import QUOTE_SCHEMA, read_table, write_table

D = dt.date


def _quotes(spark, rows):
    return spark.createDataFrame(
        [(c, s, d, "Air", "Standard", 1.0, 2.0, 10.0, 1.0, p, a) for c, s, d, p, a in rows],
        QUOTE_SCHEMA)


def test_csv_roundtrip_with_declared_schema(spark):
    q = _quotes(spark, [(1, "A", D(2026, 1, 5), 10.25, 1), (2, "B", D(2026, 2, 1), 7.5, 0)])
    out = tempfile.mkdtemp(prefix="ratecard-csv-")
    write_table(q, f"{out}/quotes", fmt="csv")
    back = read_table(spark, f"{out}/quotes", QUOTE_SCHEMA, fmt="csv")
    assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in QUOTE_SCHEMA]
    assert sorted(back.collect()) == sorted(q.collect())
    with pytest.raises(ValueError):
        read_table(spark, f"{out}/quotes", None, fmt="csv")

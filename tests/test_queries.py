"""Every registered query that has SQL gives the same rows in DuckDB."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from lodestone import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, (list, np.ndarray)):
        return str(list(value))
    if value is None or pd.isna(value):
        return "null"
    return repr(round(float(value), 6) + 0.0) if isinstance(value, (int, float, np.number)) and not isinstance(value, bool) else str(value)


def rows(frame):
    return sorted(map(tuple, frame[sorted(frame.columns)].map(plain).to_numpy().tolist()))


@pytest.mark.parametrize("name", catalog.queries())
def test_query(spark, sf, name):
    found = catalog.queries()[name](spark, sf).toPandas()
    if sql := catalog.oracle_sql().get(name):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        want = con.execute(sql).df()
        assert sorted(found.columns) == sorted(want.columns) and rows(found) == rows(want)
    else:
        assert len(found)

"""Every registered query against the same computation in DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from mnemolake import audit_queries, model_queries, note_queries, page_queries, queries, stream_queries, text_queries  # noqa: F401  (register their queries)

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Nothing to find at this size.
MAY_BE_EMPTY = {"near_dup_vectors", "scope_filter"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(pdf):
    columns = sorted(pdf.columns)

    def plain(v):
        if hasattr(v, "tolist") and getattr(v, "ndim", 0) or isinstance(v, list):
            return tuple(map(plain, v))
        return None if v is None or v is pd.NA or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return columns, sorted((tuple(map(plain, r)) for r in pdf[columns].astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA).toPandas()
    assert len(got) or name in MAY_BE_EMPTY
    if name in queries.SQL:
        assert rows(got) == rows(duck.sql(queries.SQL[name]).df())

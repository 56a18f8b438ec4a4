"""Every registered query with SQL gives DuckDB's rows on the driver's tables."""

import os

import duckdb
import pandas as pd
import pytest

from kinelake.plans import catalogue, clips, listing, measures, poses, records, texts  # noqa: F401

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    out = []
    for row in df.itertuples(index=False):
        cells = []
        for v in row:
            if v is None or (isinstance(v, float) and v != v) or v is pd.NaT or v is pd.NA:
                cells.append("")
            elif isinstance(v, bool) or type(v).__name__ == "bool_":
                cells.append(str(bool(v)))
            elif isinstance(v, (int, float)) or type(v).__module__ == "numpy":
                cells.append(f"{float(v):.6g}" if not str(type(v)).count("datetime") else str(pd.Timestamp(v)))
            elif hasattr(v, "year"):
                cells.append(str(pd.Timestamp(v)))
            else:
                cells.append(str(v))
        out.append(tuple(cells))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_matches_duckdb(spark, duck, name):
    got = catalogue.queries()[name](spark, DATA).toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        return
    want = duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = canonical(got), canonical(want)
    assert len(a) == len(b)
    assert a == b, [x for x in zip(a, b) if x[0] != x[1]][:3]

"""Every query with an SQL counterpart against DuckDB on the smallest tables."""

import duckdb
import pytest

from siftwell.plans.catalog_queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in row) for row in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLES:
        assert rows
        return
    columns = sorted(df.columns)
    con = duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})")
    assert plain(con.fetchall()) == plain([[r[c] for c in columns] for r in rows])


def test_lsh_finds_most(spark):
    exact = {r["label"] for r in QUERIES["knn_cos"](spark, SF).collect()}
    assert len(exact & {r["label"] for r in QUERIES["lsh_knn"](spark, SF).collect()}) >= 0.8 * len(exact)

"""Each review query against its SQL."""

import duckdb
import pytest
from revlens.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = catalog.QUERIES[name](spark, SF)
    if name not in catalog.SQL:
        assert got.count() > 0
        return
    cols = ", ".join(f'"{c}"' for c in got.columns)
    want = con.execute(f"SELECT {cols} FROM ({catalog.SQL[name]})").fetchall()
    plain = lambda r: str([round(v, 9) if isinstance(v, float) else list(v) if isinstance(v, (list, tuple)) else v for v in r])
    assert sorted(map(plain, got.collect())) == sorted(map(plain, want))

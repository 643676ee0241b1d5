"""Every query that has SQL gives the rows that DuckDB gives, on the smallest tables; others give rows."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from spotweave.plans.bindings import ORACLE, QUERIES  # noqa: E402

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(rows, cols):
    def one(v):
        return f"{v:.5f}".replace("-0.00000", "0.00000") if isinstance(v, float) else str(v)

    return sorted(tuple(one(r[c]) for c in sorted(cols)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    rows = [r.asDict() for r in got.collect()]
    if name not in ORACLE:
        assert rows
        return
    found = duck.sql(ORACLE[name])
    assert sorted(found.columns) == sorted(got.columns)
    assert plain(rows, got.columns) == plain([dict(zip(found.columns, r, strict=True)) for r in found.fetchall()], found.columns)

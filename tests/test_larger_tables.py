"""Queries against their SQL on tables made larger by repetition: positions that two spots share, pages that share a url, users far beyond sf0.1's, customers who come twice."""

from pathlib import Path

import duckdb
import pytest
from spotweave.plans.bindings import ORACLE, QUERIES

from .test_oracle import DIR, plain

LARGER = {
    # the second copy's spots begin at index 20,000, where rows of the grid meet those that lie 1,000 rows down
    "embeddings": "SELECT * REPLACE (vec_id + k * 120000 AS vec_id) FROM '{}', range(2) t(k)",
    "events": "SELECT * REPLACE (event_id + k * 1000000 AS event_id, user_id + k * 1500 AS user_id) FROM '{}', range(50) t(k)",
    "pages": "SELECT * REPLACE (page_id + k * 1000000 AS page_id) FROM '{}', range(2) t(k)",
    "customer": "SELECT * FROM '{}', range(2) t(k)",
}


@pytest.fixture(scope="module")
def larger(tmp_path_factory):
    d, c = tmp_path_factory.mktemp("larger"), duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        if p.stem in LARGER:
            c.execute(f"COPY ({LARGER[p.stem].format(p)}) TO '{d / p.name}'")
        else:
            (d / p.name).symlink_to(p)
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{d / p.name}'")
    return str(d), c


BRIDGE = ["array_bridge", "bridge_coverage", "bridge_residual", "registration_error_stats", "soft_target", "match_top1", "soft_cross_entropy"]


COMMON = ["common_positions", "common_positions_sample", "sort_common_keys"]


@pytest.mark.parametrize("name", BRIDGE + COMMON + ["severity_tag", "upload_receipt"])
def test_rows_of_larger_tables(spark, larger, name):
    d, duck = larger
    got, found = QUERIES[name](spark, d), duck.sql(ORACLE[name])
    want = [dict(zip(found.columns, r, strict=True)) for r in found.fetchall()]
    assert plain([r.asDict() for r in got.collect()], got.columns) == plain(want, found.columns)

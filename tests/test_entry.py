"""Driver contract: entry() and the query registry."""

import __spark_entry__ as e

from conftest import SF001


def test_entry_runs(spark):
    rows = e.entry(spark).collect()
    assert rows and {"camera", "n_rows", "rank", "share_pct"} <= set(rows[0].asDict())


def test_registry_consistent():
    qs, orc = e.queries(), e.oracle_sql()
    assert set(orc) <= set(qs) and len(qs) >= 80
    for sql in orc.values():
        assert sql.lstrip().upper().startswith("WITH") or sql.lstrip().upper().startswith("SELECT")


def test_some_queries_smoke(spark):
    qs = e.queries()
    for name in ("conform_images", "plan_rename", "hist_shutter", "catalog_upsert", "hexbin"):
        assert qs[name](spark, SF001).count() >= 0

"""The keep-last of a merge leaves nothing out: existing rows that repeat a key,
and frames in which none repeats."""

from __future__ import annotations

from medialake import schemas
from medialake.operators import lookup, merge


def _others(spark, rows):
    return spark.createDataFrame([(p, None, None, p, size, 0.0) for p, size in rows], schemas.OTHER)


def test_upsert_keeps_one_row_of_a_key_that_existing_rows_repeat(spark):
    old = _others(spark, [("/a", 1), ("/a", 1), ("/./b", 2), ("/b", 3), (None, 4), (None, 5), ("/c", 6)])
    new = _others(spark, [("/c", 7), ("/c", 7), ("/d", 8)])
    got = sorted((r["full_path"] or "", r["size_bytes"]) for r in merge.upsert(old, new, "other").collect())
    assert sorted(p.replace("/./", "/") for p, _ in got) == ["", "/a", "/b", "/c", "/d"]
    assert dict(got)["/c"] == 7 and dict(got)["/a"] == 1


def test_keep_last_compares_also_where_nothing_repeats(spark, monkeypatch):
    kept = []
    write = lookup.materialize
    monkeypatch.setattr(lookup, "materialize", lambda df: kept.append(df.columns) or write(df))
    df = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "k int, wide string")
    assert lookup.keep_last(df, ["k"], ["wide"]).count() == 50
    assert kept[-1] == [lookup.PLACE[1]]  # the rows that go were worked out

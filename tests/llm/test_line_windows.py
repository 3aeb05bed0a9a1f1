"""Line dedup cuts and hashes its windows once."""

from __future__ import annotations

from medialake.llm import line_dedup


def test_windows_are_stored(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\nd\ny"), (3, "a\nb")]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert "posexplode" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [(1, "a\nb\nc\nd", 4, 0), (2, "x\ny", 6, 4), (3, "a\nb", 2, 0)]

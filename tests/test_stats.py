"""Chart tables: top-N ties, histograms (vs numpy), hexbin totals, timelines."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from medialake.operators import geo, histograms, stats


def test_top_n_ties_and_share(spark):
    df = spark.createDataFrame([(c,) for c in "aabbbcdd"] + [(None,)], "camera string")
    got = [(r["camera"], r["n_rows"], r["rank"]) for r in stats.top_n(df, "camera", 3).orderBy("rank").collect()]
    assert got == [("b", 3, 1), ("a", 2, 2), ("d", 2, 3)]
    share = {r["camera"]: r["share_pct"] for r in stats.top_with_share(df, "camera", 2).collect()}
    assert share == {"b": 60.0, "a": 40.0}


def test_equal_width_bins_match_numpy(spark):
    rnd = np.random.default_rng(3)
    xs = rnd.lognormal(1.0, 1.0, 2000)
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    h = histograms.equal_width_bins(df, "x", 25).orderBy("bin").collect()
    counts, edges = np.histogram(xs, bins=25)
    assert [r["n"] for r in h] == counts.tolist()
    assert np.allclose([r["lower"] for r in h], np.round(edges[:-1], 6))
    one = histograms.equal_width_bins(spark.createDataFrame([(2.0,), (2.0,)], "x double"), "x", 4).collect()
    assert sum(r["n"] for r in one) == 2 and min(r["lower"] for r in one) == 1.5


def test_setting_histogram_counts_trimmed_rows(spark):
    vals = [float(v) for v in range(1, 201)]
    df = spark.createDataFrame([(v,) for v in vals], "aperture double")
    h = histograms.setting_histogram(df, "aperture", 25, 0.02, 0.98)
    s = np.array(vals)
    lo, hi = np.quantile(s, 0.02), np.quantile(s, 0.98)
    want = int(((s > lo) & (s <= hi) & (s > 0)).sum())
    assert sum(r["n"] for r in h.collect()) == want


def test_hexbin_counts_sum_to_points(spark):
    rnd = np.random.default_rng(5)
    pts = [(float(a), float(b)) for a, b in zip(rnd.uniform(-10, 10, 500), rnd.uniform(40, 50, 500))]
    df = spark.createDataFrame(pts, "longitude double, latitude double")
    cells = geo.hexbin(df).collect()
    assert sum(r["n"] for r in cells) == 500
    assert len({(r["lattice"], r["i"], r["j"]) for r in cells}) == len(cells)


def test_timeline_zero_fill_and_other(spark):
    rows = [(dt.date(2024, 1, 1), "A")] * 3 + [(dt.date(2024, 2, 1), "B")] + [(dt.date(2024, 2, 1), "C")] + \
           [(None, "A")]
    df = spark.createDataFrame(rows, "date_taken date, camera string")
    t = {(r["period"], r["group_name"]): r["n_photos"] for r in stats.timeline(df, "camera", "month", 2).collect()}
    assert t == {("2024-01", "A"): 3, ("2024-01", "B"): 0, ("2024-01", "Other"): 0,
                 ("2024-02", "A"): 0, ("2024-02", "B"): 1, ("2024-02", "Other"): 1}


def test_summary_totals_hms(spark):
    i = spark.createDataFrame([(1.25,), (2.5,)], "size_mb double")
    v = spark.createDataFrame([(1.0, 3_723_000.0), (1.0, None)], "size_mb double, duration_ms double")
    o = spark.createDataFrame([(0.25,)], "size_mb double")
    r = stats.summary_totals(i, v, o).first()
    assert (r["total_files"], r["total_size_mb"], r["hours"], r["minutes"], r["seconds"]) == (5, 6.0, 1, 2, 3)


def test_empty_inputs_give_empty_tables(spark):
    """One-row aggregates of empty data are NULL scalars: no bins, no cells."""
    from medialake.operators.ranking import exact_quantiles

    empty = spark.createDataFrame([], "x double, latitude double, longitude double")
    assert histograms.equal_width_bins(empty, "x", 5).count() == 0
    assert geo.hexbin(empty).count() == 0
    q = exact_quantiles(empty, "x", [0.5]).collect()
    assert len(q) == 1 and q[0]["q0"] is None and q[0]["n"] is None

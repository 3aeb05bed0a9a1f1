"""Histograms of camera settings and durations (H1-H3) and the quantile trim (F15).

Quantiles are exact (see ``ranking.exact_quantiles``); min/max and quantile
results are one-row tables joined by broadcast. Binning reproduces the
equal-width rule of array histograms: edges ``lo + i*(hi-lo)/n``, the last bin
closed, a zero-width range widened to ``lo-0.5 .. hi+0.5``, and the
edge-comparison correction for values that rounding puts in a neighbour bin.
"""

from __future__ import annotations

from typing import Callable, Optional

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medialake.functions import numbers, ticks
from medialake.functions.scalars import with_scalars
from medialake.operators.ranking import exact_quantiles
from medialake.session import stored as materialize

# Per-setting parser of the chart path.
PARSERS: dict[str, Callable[[Column], Column]] = {
    "aperture": numbers.to_float,
    "shutter_speed": lambda c: numbers.parse_shutter(c, bad="null"),
    "iso": numbers.to_float,
    "focal_length": numbers.to_float,
}


def trim_quantile(df: DataFrame, col: str, lo_q: float, hi_q: float,
                  parser: Optional[Callable[[Column], Column]] = None, out: Optional[str] = None) -> DataFrame:
    """Rows with ``q_lo < x <= q_hi`` and ``x > 0``, quantiles over the
    non-NULL parsed values (linear interpolation)."""
    x = parser(F.col(col)) if parser else F.col(col)
    name = out or col
    d = df.withColumn(name, x) if parser or out else df
    q = exact_quantiles(d, name, [lo_q, hi_q], prefix="_q")
    j = with_scalars(d, q.select("_q0", "_q1"))
    v = F.col(name)
    return j.where((v > F.col("_q0")) & (v <= F.col("_q1")) & (v > 0)).drop("_q0", "_q1")


def equal_width_bins(values: DataFrame, col: str, nbins: int, weight: Optional[str] = None) -> DataFrame:
    """All ``nbins`` bins of ``col`` between its min and max:
    (bin, lower, upper, n); empty input gives no rows. ``weight`` names a
    count column when ``values`` holds (distinct value, count) pairs."""
    v = F.col(col)
    st = values.agg(F.min(v).alias("_mn"), F.max(v).alias("_mx"))
    st = st.where(F.col("_mn").isNotNull()).select(
        F.when(F.col("_mn") == F.col("_mx"), F.col("_mn") - 0.5).otherwise(F.col("_mn")).alias("_lo"),
        F.when(F.col("_mn") == F.col("_mx"), F.col("_mx") + 0.5).otherwise(F.col("_mx")).alias("_hi"))
    st = st.withColumn("_step", (F.col("_hi") - F.col("_lo")) / F.lit(float(nbins)))
    n = F.lit(nbins)

    def edge(i: Column) -> Column:
        return F.when(i >= n, F.col("_hi")).otherwise(i * F.col("_step") + F.col("_lo"))

    j = with_scalars(values.where(v.isNotNull()), st)
    j = j.withColumn("_i0", F.least(
        F.floor((v - F.col("_lo")) * (n / (F.col("_hi") - F.col("_lo")))).cast("bigint"), n - 1))
    i0 = F.col("_i0")
    # the edge correction: a value below its bin's lower edge moves down one
    # bin, one at or above the upper edge moves up (the last bin is closed)
    j = j.withColumn("_i", F.when(v < edge(i0), i0 - 1)
                     .when((v >= edge(i0 + 1)) & (i0 != n - 1), i0 + 1).otherwise(i0))
    counts = j.groupBy("_i").agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))
    grid = st.select("*", F.explode(F.sequence(F.lit(0), F.lit(nbins - 1))).alias("_b"))
    out = grid.join(F.broadcast(counts), grid["_b"] == counts["_i"], "left")
    b = F.col("_b")
    return out.select(
        (b + 1).cast("bigint").alias("bin"),
        F.round(edge(b), 6).alias("lower"),
        F.round(edge(b + 1), 6).alias("upper"),
        F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"),
    )


def _value_counts(images: DataFrame, setting: str, parser: Optional[Callable[[Column], Column]]) -> DataFrame:
    """(_x, _w): parsed values of a setting with their row counts, stored.

    The setting texts are first reduced to (distinct text, count) pairs by a
    partial aggregate, so only distinct texts are parsed, and every pass of a
    chart reads this small table instead of the rows."""
    texts = images.groupBy(F.col(setting).alias("_t")).agg(F.count(F.lit(1)).alias("_w"))
    return materialize(texts.select((parser or PARSERS[setting])(F.col("_t")).alias("_x"), "_w")
                       .where(F.col("_x").isNotNull()).groupBy("_x").agg(F.sum("_w").alias("_w")))


def _trimmed(vc: DataFrame, lo_q: float, hi_q: float) -> DataFrame:
    q = exact_quantiles(vc, "_x", [lo_q, hi_q], prefix="_q", weight="_w")
    x = F.col("_x")
    return with_scalars(vc, q.select("_q0", "_q1")).where((x > F.col("_q0")) & (x <= F.col("_q1")) & (x > 0))


def setting_histogram(images: DataFrame, setting: str, nbins: int = 25, lo_q: float = 0.02,
                      hi_q: float = 0.98, parser: Optional[Callable[[Column], Column]] = None) -> DataFrame:
    """Log10 histogram of a camera setting after the quantile trim; shutter
    values are negated so fast speeds sit left. ``parser`` turns the setting's
    column into a number (default: the setting's own)."""
    lv = F.log10("_x")
    if setting == "shutter_speed":
        lv = -lv
    t = _trimmed(_value_counts(images, setting, parser), lo_q, hi_q)
    return equal_width_bins(t.select(lv.alias("_lv"), "_w"), "_lv", nbins, weight="_w")


def duration_histogram(videos: DataFrame, nbins: int = 50) -> DataFrame:
    """Video durations in seconds, equal-width bins from min to max."""
    d = videos.where(F.col("duration_ms").isNotNull()).select((F.col("duration_ms") / 1000.0).alias("_s"))
    return equal_width_bins(d, "_s", nbins)


def tick_table(spark, mode: str = "plot") -> DataFrame:
    rows = spark.createDataFrame(ticks.tick_rows(mode), "setting string, pos int, value double")
    return rows.withColumn("label", ticks.tick_label(F.col("setting"), F.col("value")))


def hist_ticks(images: DataFrame, setting: str, mode: str = "plot",
               parser: Optional[Callable[[Column], Column]] = None) -> DataFrame:
    """Standard ticks shown under a setting histogram: (setting, value, label).

    ``plot``: values within ``[0.9*min, 1.1*q97]`` of the parsed data, every
    other one when more than ten qualify. ``dashboard``: ``log10(v)`` within
    ``[0.9*min, 1.1*max]`` of the trimmed (1 %/99 %) log data.
    """
    vc = _value_counts(images, setting, parser)
    tt = tick_table(images.sparkSession, mode).where(F.col("setting") == setting)
    if mode == "plot":
        mn = vc.agg(F.min("_x").alias("_mn"))
        q = exact_quantiles(vc, "_x", [0.97], prefix="_q", weight="_w")
        j = with_scalars(with_scalars(tt, mn), q.select("_q0"))
        sel = j.where((F.col("value") >= F.col("_mn") * 0.9) & (F.col("value") <= F.col("_q0") * 1.1))
        w = Window.partitionBy("setting").orderBy("pos")  # bounded: one tick table
        sel = sel.withColumn("_k", F.row_number().over(w) - 1).withColumn(
            "_cnt", F.count(F.lit(1)).over(Window.partitionBy("setting")))
        sel = sel.where((F.col("_cnt") <= 10) | (F.col("_k") % 2 == 0))
    else:
        st = _trimmed(vc, 0.01, 0.99).agg(F.min(F.log10("_x")).alias("_lmn"), F.max(F.log10("_x")).alias("_lmx"))
        lv = F.log10("value")
        sel = with_scalars(tt, st).where((F.col("_lmn") * 0.9 <= lv) & (lv <= F.col("_lmx") * 1.1))
    return sel.select("setting", F.round("value", 9).alias("value"), "label")

"""Summary, top-N and timeline tables (the data behind every report chart).

Every aggregate is a hash aggregate with a map-side partial stage, so a hot
group is combined before the shuffle. Top-N lists and one-row statistics are
bounded by construction and are the only tables broadcast.
"""

from __future__ import annotations

from typing import Optional

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medialake.functions import dates, numbers
from medialake.functions.scalars import with_scalars
from medialake.operators.ranking import rank_within
from medialake.session import stored as materialize

# Labels of the kind counts, in display order.
KIND_LABELS = {"image": "Images", "video": "Videos", "other": "Others"}
OTHER_GROUP = "Other"


def top_n(df: DataFrame, col: str, n: int, value_alias: Optional[str] = None) -> DataFrame:
    """Most frequent non-NULL values: (value, n_rows, rank), count desc then
    value asc. Plans as partial/final aggregate + ``TakeOrderedAndProject``."""
    v = value_alias or col
    counts = (df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias(v))
              .agg(F.count(F.lit(1)).alias("n_rows")))
    top = counts.orderBy(F.col("n_rows").desc(), F.col(v).asc()).limit(n)
    return top.withColumn("rank", F.row_number().over(
        Window.orderBy(F.col("n_rows").desc(), F.col(v).asc())).cast("bigint"))


def top_with_share(df: DataFrame, col: str, n: int = 15) -> DataFrame:
    """Top-N with each value's percent of the top-N total (one decimal)."""
    t = top_n(df, col, n)
    tot = F.sum("n_rows").over(Window.partitionBy())
    return t.withColumn("share_pct", F.round(F.col("n_rows") * 100.0 / tot, 1))


def option_lists(images: DataFrame, fields=("camera", "lens")) -> DataFrame:
    """Distinct values per field, most frequent first: (field, value, n_rows, rank)."""
    out = None
    for f in fields:
        c = (images.where(F.col(f).isNotNull()).groupBy(F.col(f).alias("value"))
             .agg(F.count(F.lit(1)).alias("n_rows")).withColumn("field", F.lit(f)))
        out = c if out is None else out.unionByName(c)
    ranked = rank_within(out.withColumn("_least", -F.col("n_rows")), ["field"], ["_least", "value"], out="_r")
    return ranked.select("value", "n_rows", "field", (F.col("_r") + 1).alias("rank"))


def counts_by_kind(media: DataFrame) -> DataFrame:
    """Images / Videos / Others counts with percent share; zero counts absent."""
    c = media.groupBy("kind").agg(F.count(F.lit(1)).alias("n_files"))
    lab = F.create_map(*[x for k, v in KIND_LABELS.items() for x in (F.lit(k), F.lit(v))])
    tot = F.sum("n_files").over(Window.partitionBy())
    return c.select(lab[F.col("kind")].alias("label"), "n_files",
                    F.round(F.col("n_files") * 100.0 / tot, 1).alias("share_pct"))


def summary_totals(images: DataFrame, videos: DataFrame, others: DataFrame) -> DataFrame:
    """One row: file counts, total MB (sum of rounded per-file MB), video time."""
    cols = ["kind", "size_mb", "duration_ms"]
    u = (images.select(F.lit("image").alias("kind"), "size_mb", F.lit(None).cast("double").alias("duration_ms"))
         .unionByName(videos.select(F.lit("video").alias("kind"), "size_mb", "duration_ms"))
         .unionByName(others.select(F.lit("other").alias("kind"), "size_mb",
                                    F.lit(None).cast("double").alias("duration_ms")))).select(*cols)
    agg = u.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(F.col("kind") == "image").alias("n_images"),
        F.count_if(F.col("kind") == "video").alias("n_videos"),
        F.count_if(F.col("kind") == "other").alias("n_others"),
        F.round(F.coalesce(F.sum("size_mb"), F.lit(0.0)), 2).alias("total_size_mb"),
        (F.coalesce(F.sum("duration_ms"), F.lit(0.0)) / 1000.0).alias("_secs"),
    )
    h, m, s = numbers.hms(F.col("_secs"))
    return agg.select("total_files", "n_images", "n_videos", "n_others", "total_size_mb",
                      F.round("_secs", 3).alias("video_seconds"),
                      h.alias("hours"), m.alias("minutes"), s.alias("seconds"))


def _period(d: Column, time_by: str) -> Column:
    return F.year(d).cast("bigint").cast("string") if time_by == "year" else dates.month_label(d)


def _cells(images: DataFrame, group_by: str, time_by: str, first_day: Optional[str] = None) -> DataFrame:
    """(period, g, n): photos per period and group, stored. Undated and
    ungrouped photos are left out. The only read of the rows: top groups,
    ``Other``, periods and zero cells all come from this small table."""
    d = F.col("date_taken")
    dated = d.isNotNull() if first_day is None else d >= F.lit(first_day).cast("date")
    return materialize(images.where(dated & F.col(group_by).isNotNull())
                       .groupBy(_period(d, time_by).alias("period"), F.col(group_by).alias("g"))
                       .agg(F.count(F.lit(1)).alias("n")))


def _lumped(cells: DataFrame, top: int) -> DataFrame:
    """(period, group_name, n_photos): groups beyond the ``top`` largest (ties
    by name) together as ``Other``."""
    best = (cells.groupBy(F.col("g").alias("group_name")).agg(F.sum("n").alias("all_n"))
            .orderBy(F.col("all_n").desc(), "group_name").limit(top).select("group_name"))
    # bounded by ``top`` rows
    j = cells.join(F.broadcast(best), cells["g"] == best["group_name"], "left")
    return (j.select("period", F.coalesce("group_name", F.lit(OTHER_GROUP)).alias("group_name"), "n")
            .groupBy("period", "group_name").agg(F.sum("n").alias("n_photos")))


def timeline(images: DataFrame, group_by: str = "camera", time_by: str = "month",
             top: int = 15) -> DataFrame:
    """Stacked timeline, long form with zero cells: (period, group_name, n_photos).

    Undated or ungrouped photos are dropped first; the top ``top`` groups of
    the remaining rows keep their name, the rest become ``Other``. Only
    observed periods appear; every (period, group) cell is present.
    """
    counts = _lumped(_cells(images, group_by, time_by), top)
    periods = counts.select("period").distinct()
    # every period gets every group: the group names (at most top + 1) as
    # one array, exploded next to each period
    groups = counts.agg(F.array_sort(F.collect_set("group_name")).alias("_groups"))
    grid = with_scalars(periods, groups).select("period", F.explode("_groups").alias("group_name"))
    return (grid.join(counts, ["period", "group_name"], "left")
            .select("period", "group_name", F.coalesce("n_photos", F.lit(0)).cast("bigint").alias("n_photos")))


def timeline_pivot(images: DataFrame, group_by: str = "camera", time_by: str = "month",
                   top: int = 15) -> DataFrame:
    """Wide form of :func:`timeline`: one column per group, columns by total
    desc (ties by name), rows by period."""
    counts = _lumped(_cells(images, group_by, time_by), top)
    # bounded by top + 1 names
    totals = counts.groupBy("group_name").agg(F.sum("n_photos").alias("n")).orderBy(F.col("n").desc(), "group_name").collect()
    values = [r["group_name"] for r in totals]
    if not values:
        return counts.select("period")
    return counts.groupBy("period").pivot("group_name", values).sum("n_photos").fillna(0).orderBy("period")


def timeline_dashboard(images: DataFrame, group_by: str = "camera", time_by: str = "month",
                       top: int = 10) -> DataFrame:
    """Dashboard timeline: photos from 1970-04-01 on, top 10 + Other, no zero fill."""
    return _lumped(_cells(images, group_by, time_by, "1970-04-01"), top)


def sparse_labels(periods: DataFrame, col: str = "period") -> DataFrame:
    """Month axis labels: the year on each year's first observed month, else ''.

    ``periods`` holds distinct month labels (``yyyy-MM``); the window is
    partitioned by year, whose size is bounded by 12."""
    y = F.substring(F.col(col), 1, 4)
    w = Window.partitionBy(y).orderBy(F.col(col))
    return periods.select(col).distinct().select(
        col, F.when(F.row_number().over(w) == 1, y).otherwise(F.lit("")).alias("label"))


def video_timeline(videos: DataFrame) -> DataFrame:
    """Per month: videos with a name, seconds recorded (NULL = 0), minutes."""
    v = videos.where(F.col("date_taken").isNotNull())
    return (v.groupBy(dates.month_start(F.col("date_taken")).alias("month"))
            .agg(F.count("name").alias("n_videos"),
                 F.sum(F.coalesce(F.col("duration_ms"), F.lit(0.0)) / 1000.0).alias("total_s"))
            .select("month", "n_videos", F.round("total_s", 6).alias("total_s"),
                    F.round(F.col("total_s") / 60.0, 6).alias("total_min")).orderBy("month"))


def video_minutes(videos: DataFrame) -> DataFrame:
    """Dashboard: minutes recorded per ``yyyy-MM``; 1970-01-01 and undated
    excluded; a month of NULL durations counts 0."""
    v = videos.where(F.col("date_taken").isNotNull() & (F.col("date_taken") != F.lit("1970-01-01").cast("date")))
    return (v.groupBy(dates.month_label(F.col("date_taken")).alias("month"))
            .agg(F.coalesce(F.sum("duration_ms"), F.lit(0.0)).alias("_ms"))
            .select("month", F.round(F.col("_ms") / 60000.0, 6).alias("minutes")))


def month_domain(images: DataFrame) -> DataFrame:
    """Every month between the first and last dated image: (month, label)."""
    b = images.agg(F.min("date_taken").alias("_lo"), F.max("date_taken").alias("_hi"))
    m = b.where(F.col("_lo").isNotNull()).select(F.explode(F.sequence(
        F.trunc("_lo", "MM"), F.trunc("_hi", "MM"), F.expr("INTERVAL 1 MONTH"))).alias("month"))
    return m.select("month", F.date_format("month", "MMM yyyy").alias("label"))

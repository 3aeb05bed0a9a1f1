"""Queries for summaries, top-N, timelines (A*, L*, W*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from medialake.operators import filters, stats
from medialake.plans import common
from medialake.plans.registry import query
from oracle_sql import with_media

TOP_SQL = """
SELECT {col}, n_rows, CAST(row_number() OVER (ORDER BY n_rows DESC, {col}) AS BIGINT) AS rank{share}
FROM (SELECT {col}, count(*) AS n_rows FROM {src} WHERE {col} IS NOT NULL GROUP BY {col}
      ORDER BY n_rows DESC, {col} LIMIT {n})
"""


def _top_sql(col, src, n, share=False):
    s = ", round(n_rows * 100.0 / sum(n_rows) OVER (), 1) AS share_pct" if share else ""
    return TOP_SQL.format(col=col, src=src, n=n, share=s)


@query("top_cameras", with_media(_top_sql("camera", "images", 15, share=True)))
def top_cameras(spark, sf_dir):
    return stats.top_with_share(common.images(spark, sf_dir), "camera", 15)


@query("top_lenses", with_media(_top_sql("lens", "images", 15)))
def top_lenses(spark, sf_dir):
    return stats.top_n(common.images(spark, sf_dir), "lens", 15)


ISO_SPEC = filters.FilterSpec(iso_range=(100, 800))


@query("top_cameras_iso", with_media(_top_sql("camera", "(SELECT * FROM images WHERE iso BETWEEN 100 AND 800)", 15,
                                              share=True)))
def top_cameras_iso(spark, sf_dir):
    """Flagship slice: conform -> ISO range filter -> top cameras with share."""
    m = ISO_SPEC.apply(common.media(spark, sf_dir))
    return stats.top_with_share(m, "camera", 15)


from medialake.functions import ticks as _ticks  # noqa: E402
from medialake.operators import geo, histograms  # noqa: E402
from medialake.plans.q_exprs import shutter_null_sql  # noqa: E402
from medialake.schemas import union_kinds  # noqa: E402

MASKED_IMAGES = "masked AS (SELECT * FROM images WHERE date_taken IS NOT NULL)"


@query("counts_by_kind", with_media("""
SELECT label, n_files, round(n_files * 100.0 / sum(n_files) OVER (), 1) AS share_pct
FROM (SELECT CASE kind WHEN 'image' THEN 'Images' WHEN 'video' THEN 'Videos' ELSE 'Others' END AS label,
             count(*) AS n_files FROM media GROUP BY kind)
"""))
def counts_by_kind(spark, sf_dir):
    return stats.counts_by_kind(common.media(spark, sf_dir))


@query("summary_totals", with_media("""
SELECT total_files, n_images, n_videos, n_others, round(coalesce(mb, 0.0), 2) AS total_size_mb,
       round(secs, 3) AS video_seconds, CAST(floor(secs / 3600) AS BIGINT) AS hours,
       CAST(floor((secs % 3600) / 60) AS BIGINT) AS minutes, CAST(floor(secs % 60) AS BIGINT) AS seconds
FROM (SELECT count(*) AS total_files, count_if(kind = 'image') AS n_images, count_if(kind = 'video') AS n_videos,
             count_if(kind = 'other') AS n_others, sum(size_mb) AS mb, coalesce(sum(duration_ms), 0.0) / 1000.0 AS secs
      FROM (SELECT 'image' AS kind, size_mb, NULL::DOUBLE AS duration_ms FROM masked
            UNION ALL SELECT 'video', size_mb, duration_ms FROM videos
            UNION ALL SELECT 'other', size_mb, NULL FROM others))
""", MASKED_IMAGES))
def summary_totals(spark, sf_dir):
    k = common.kinds(spark, sf_dir)
    fi = filters.dashboard_mask(k["image"])
    return stats.summary_totals(fi, k["video"], k["other"])


def _timeline_sql(group, time_by, top, zero_fill=True, src="images", min_date=None):
    period = ("CAST(year(date_taken) AS VARCHAR)" if time_by == "year" else "strftime(date_taken, '%Y-%m')")
    date_cond = f"date_taken >= DATE '{min_date}'" if min_date else "date_taken IS NOT NULL"
    body = f"""base AS (SELECT {period} AS period, {group} AS g FROM {src} WHERE {date_cond} AND {group} IS NOT NULL),
top AS (SELECT g FROM base GROUP BY g ORDER BY count(*) DESC, g LIMIT {top}),
lumped AS (SELECT period, CASE WHEN g IN (SELECT g FROM top) THEN g ELSE 'Other' END AS group_name FROM base),
c AS (SELECT period, group_name, count(*) AS n_photos FROM lumped GROUP BY period, group_name)"""
    if zero_fill:
        sel = """SELECT p.period, gr.group_name, coalesce(c.n_photos, 0) AS n_photos
FROM (SELECT DISTINCT period FROM c) p CROSS JOIN (SELECT DISTINCT group_name FROM c) gr
LEFT JOIN c ON c.period = p.period AND c.group_name = gr.group_name"""
    else:
        sel = "SELECT period, group_name, n_photos FROM c"
    return body, sel


def _reg_timeline(name, group, time_by, top):
    ctes, sel = _timeline_sql(group, time_by, top)

    @query(name, with_media(sel, ctes))
    def run(spark, sf_dir):
        return stats.timeline(common.images(spark, sf_dir), group, time_by, top)


_reg_timeline("timeline_year_camera", "camera", "year", 15)
_reg_timeline("timeline_month_camera", "camera", "month", 15)
_reg_timeline("timeline_year_lens", "lens", "year", 15)
_reg_timeline("timeline_month_lens", "lens", "month", 15)

_tl_ctes, _tl_sel = _timeline_sql("camera", "month", 10, zero_fill=False, src="masked", min_date="1970-04-01")


@query("timeline_dashboard", with_media(_tl_sel, MASKED_IMAGES + ",\n" + _tl_ctes))
def timeline_dashboard(spark, sf_dir):
    fi = filters.dashboard_mask(common.images(spark, sf_dir))
    return stats.timeline_dashboard(fi, "camera", "month", 10)


@query("sparse_labels", with_media("""
SELECT period, CASE WHEN row_number() OVER (PARTITION BY substr(period, 1, 4) ORDER BY period) = 1
                    THEN substr(period, 1, 4) ELSE '' END AS label
FROM (SELECT DISTINCT strftime(date_taken, '%Y-%m') AS period FROM images
      WHERE date_taken IS NOT NULL AND camera IS NOT NULL)
"""))
def sparse_labels(spark, sf_dir):
    i = common.images(spark, sf_dir)
    p = i.where(F.col("date_taken").isNotNull() & F.col("camera").isNotNull()).select(
        F.date_format("date_taken", "yyyy-MM").alias("period"))
    return stats.sparse_labels(p)


@query("video_timeline", with_media("""
SELECT CAST(date_trunc('month', date_taken) AS DATE) AS month, count(name) AS n_videos,
       round(sum(coalesce(duration_ms, 0.0) / 1000.0), 6) AS total_s,
       round(sum(coalesce(duration_ms, 0.0) / 1000.0) / 60.0, 6) AS total_min
FROM videos WHERE date_taken IS NOT NULL GROUP BY 1
"""))
def video_timeline(spark, sf_dir):
    return stats.video_timeline(common.videos(spark, sf_dir))


@query("video_minutes", with_media("""
SELECT strftime(date_taken, '%Y-%m') AS month, round(coalesce(sum(duration_ms), 0.0) / 60000.0, 6) AS minutes
FROM videos WHERE date_taken IS NOT NULL AND date_taken <> DATE '1970-01-01' GROUP BY 1
"""))
def video_minutes(spark, sf_dir):
    return stats.video_minutes(common.videos(spark, sf_dir))


@query("month_domain", with_media("""
SELECT CAST(m AS DATE) AS month, strftime(m, '%b %Y') AS label
FROM (SELECT unnest(generate_series(date_trunc('month', min(date_taken)), date_trunc('month', max(date_taken)),
                                    INTERVAL 1 MONTH)) AS m FROM images)
"""))
def month_domain(spark, sf_dir):
    return stats.month_domain(common.images(spark, sf_dir))


@query("option_lists", with_media("""
SELECT field, value, n_rows, CAST(row_number() OVER (PARTITION BY field ORDER BY n_rows DESC, value) AS BIGINT) AS rank
FROM (SELECT 'camera' AS field, camera AS value, count(*) AS n_rows FROM images WHERE camera IS NOT NULL GROUP BY camera
      UNION ALL SELECT 'lens', lens, count(*) FROM images WHERE lens IS NOT NULL GROUP BY lens)
"""))
def option_lists(spark, sf_dir):
    return stats.option_lists(common.images(spark, sf_dir))


def hist_sql(expr: str, src: str, nbins: int, lo_q=None, hi_q=None, log=True, negate=False) -> tuple[str, str]:
    """Oracle CTEs + select for an equal-width histogram of ``expr``."""
    v = "x"
    if log:
        v = "-log10(x)" if negate else "log10(x)"
    trim = (f"q AS (SELECT quantile_cont(x, {lo_q}) AS q0, quantile_cont(x, {hi_q}) AS q1 FROM raw),\n"
            f"t AS (SELECT {v} AS v FROM raw, q WHERE x > q0 AND x <= q1 AND x > 0)"
            if lo_q is not None else f"t AS (SELECT {v} AS v FROM raw)")
    n = nbins

    def edge(i):
        return f"(CASE WHEN {i} >= {n} THEN hi ELSE {i} * step + lo END)"

    ctes = f"""raw AS (SELECT {expr} AS x FROM {src} WHERE {expr} IS NOT NULL),
{trim},
st0 AS (SELECT min(v) AS mn, max(v) AS mx FROM t),
st AS (SELECT CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo, CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi
       FROM st0 WHERE mn IS NOT NULL),
st2 AS (SELECT lo, hi, (hi - lo) / {n}.0 AS step FROM st),
b0 AS (SELECT v, lo, hi, step, least(CAST(floor((v - lo) * ({n}.0 / (hi - lo))) AS BIGINT), {n - 1}) AS i FROM t, st2),
b1 AS (SELECT v, lo, hi, step, CASE WHEN v < {edge('i')} THEN i - 1 ELSE i END AS i FROM b0),
b2 AS (SELECT CASE WHEN v >= {edge('(i + 1)')} AND i <> {n - 1} THEN i + 1 ELSE i END AS i FROM b1),
c AS (SELECT i, count(*) AS n FROM b2 GROUP BY i),
grid AS (SELECT lo, hi, step, unnest(range(0, {n})) AS b FROM st2)"""
    sel = f"""SELECT CAST(b + 1 AS BIGINT) AS bin, round({edge('b')}, 6) AS lower, round({edge('(b + 1)')}, 6) AS upper,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM grid LEFT JOIN c ON grid.b = c.i"""
    return ctes, sel


SETTING_SQL = {
    "aperture": "TRY_CAST(aperture AS DOUBLE)",
    "shutter_speed": shutter_null_sql("shutter_speed"),
    "iso": "TRY_CAST(iso AS DOUBLE)",
    "focal_length": "TRY_CAST(focal_length AS DOUBLE)",
}


def _reg_hist(name, setting):
    ctes, sel = hist_sql(SETTING_SQL[setting], "images", 25, 0.02, 0.98, log=True, negate=setting == "shutter_speed")

    @query(name, with_media(sel, ctes))
    def run(spark, sf_dir):
        return histograms.setting_histogram(common.images(spark, sf_dir), setting, 25, 0.02, 0.98)


for _name, _setting in (("hist_aperture", "aperture"), ("hist_shutter", "shutter_speed"), ("hist_iso", "iso"),
                        ("hist_focal", "focal_length")):
    _reg_hist(_name, _setting)

_hd_ctes, _hd_sel = hist_sql("duration_ms / 1000.0", "videos", 50, log=False)


@query("hist_duration", with_media(_hd_sel, _hd_ctes))
def hist_duration(spark, sf_dir):
    return histograms.duration_histogram(common.videos(spark, sf_dir), 50)


def _tick_values_sql(mode: str) -> str:
    rows = ", ".join(f"('{s}', {p}, CAST('{v!r}' AS DOUBLE))" for s, p, v in _ticks.tick_rows(mode))

    def text(v):
        return f"CASE WHEN {v} = floor({v}) THEN CAST(CAST({v} AS BIGINT) AS VARCHAR) ELSE CAST({v} AS VARCHAR) END"

    label = (f"CASE setting WHEN 'aperture' THEN 'f' || {text('value')} WHEN 'focal_length' THEN {text('value')} || 'mm' "
             f"WHEN 'iso' THEN {text('value')} ELSE CASE WHEN value < 1 THEN '1/' || {text('round(1 / value, 2)')} "
             f"ELSE {text('value')} || 's' END END")
    return f"SELECT *, {label} AS label FROM (VALUES {rows}) AS t(setting, pos, value)"


def _ticks_plot_sql() -> str:
    parts = []
    for s, expr in SETTING_SQL.items():
        parts.append(f"""SELECT setting, round(value, 9) AS value, label FROM (
  SELECT t.*, row_number() OVER (ORDER BY pos) - 1 AS k, count(*) OVER () AS cnt
  FROM ({_tick_values_sql('plot')}) t,
       (SELECT min(x) AS mn, quantile_cont(x, 0.97) AS q97 FROM (SELECT {expr} AS x FROM images) WHERE x IS NOT NULL) st
  WHERE t.setting = '{s}' AND value >= mn * 0.9 AND value <= q97 * 1.1)
WHERE cnt <= 10 OR k % 2 = 0""")
    return "\nUNION ALL\n".join(parts)


@query("hist_ticks", with_media(_ticks_plot_sql()))
def hist_ticks(spark, sf_dir):
    i = common.images(spark, sf_dir)
    out = None
    for s in SETTING_SQL:
        t = histograms.hist_ticks(i, s, "plot")
        out = t if out is None else out.unionByName(t)
    return out


def _dash_ticks_sql() -> str:
    return "\nUNION ALL\n".join(f"""
SELECT setting, round(value, 9) AS value, label FROM ({_tick_values_sql('dashboard')}) t,
  (SELECT min(log10(x)) AS lmn, max(log10(x)) AS lmx
   FROM (SELECT x FROM (SELECT {expr} AS x FROM images) WHERE x IS NOT NULL) r,
        (SELECT quantile_cont(x, 0.01) AS q0, quantile_cont(x, 0.99) AS q1
         FROM (SELECT {expr} AS x FROM images) WHERE x IS NOT NULL) q
   WHERE x > q0 AND x <= q1 AND x > 0) st
WHERE t.setting = '{setting}' AND lmn * 0.9 <= log10(value) AND log10(value) <= lmx * 1.1"""
                                  for setting, expr in SETTING_SQL.items())


@query("hist_ticks_dashboard", with_media(_dash_ticks_sql()))
def hist_ticks_dashboard(spark, sf_dir):
    i = common.images(spark, sf_dir)
    return _union(histograms.hist_ticks(i, s, "dashboard") for s in SETTING_SQL)


def _union(frames):
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f)
    return out


def _dash_hist_sql() -> str:
    parts = []
    for setting, expr in SETTING_SQL.items():
        ctes, sel = hist_sql(expr, "images", 30, 0.01, 0.99, log=True, negate=setting == "shutter_speed")
        parts.append(f"SELECT '{setting}' AS setting, h.* FROM (WITH {ctes}\n{sel}) h")
    return "\nUNION ALL\n".join(parts)


@query("hist_dashboard", with_media(_dash_hist_sql()))
def hist_dashboard(spark, sf_dir):
    """Dashboard form of all four settings: 30 bins, trimmed at 1 and 99 %."""
    i = common.images(spark, sf_dir)
    return _union(histograms.setting_histogram(i, s, 30, 0.01, 0.99).withColumn("setting", F.lit(s)) for s in SETTING_SQL)


_ISO_SQL = "CASE WHEN iso >= 100 THEN TRY_CAST(iso AS DOUBLE) / 100 END"
_hp_ctes, _hp_sel = hist_sql(_ISO_SQL, "images", 25, 0.02, 0.98)


@query("hist_parser", with_media(_hp_sel, _hp_ctes))
def hist_parser(spark, sf_dir):
    """A caller's own parser: ISO in hundreds, below 100 left out."""
    return histograms.setting_histogram(common.images(spark, sf_dir), "iso",
                                        parser=lambda c: F.when(c >= 100, c.cast("double") / 100))


_tw_ctes, _ = _timeline_sql("camera", "month", 15)


@query("timeline_wide", with_media("""
SELECT p.period, gr.group_name, gr.pos, coalesce(c.n_photos, 0) AS n_photos
FROM (SELECT DISTINCT period FROM c) p CROSS JOIN
     (SELECT group_name, CAST(row_number() OVER (ORDER BY sum(n_photos) DESC, group_name) - 1 AS INTEGER) AS pos
      FROM c GROUP BY group_name) gr
LEFT JOIN c ON c.period = p.period AND c.group_name = gr.group_name""", _tw_ctes))
def timeline_wide(spark, sf_dir):
    """The wide timeline, listed cell by cell with each column's position."""
    wide = stats.timeline_pivot(common.images(spark, sf_dir), "camera", "month", 15)
    cells = F.array(*[F.struct(F.lit(c).alias("group_name"), F.lit(i).alias("pos"), F.col(f"`{c}`").alias("n_photos"))
                      for i, c in enumerate(wide.columns[1:])])
    return wide.select("period", F.inline(cells))


@query("geo_points", with_media("""
SELECT full_path, latitude, longitude, camera, date_taken, name FROM images
WHERE latitude IS NOT NULL AND longitude IS NOT NULL
"""))
def geo_points(spark, sf_dir):
    return geo.geo_points(common.images(spark, sf_dir))


@query("union_locations", with_media("""
SELECT 'image' AS kind, latitude, longitude FROM images UNION ALL SELECT 'video', NULL, NULL FROM videos
"""))
def union_locations(spark, sf_dir):
    k = common.kinds(spark, sf_dir)
    u = union_kinds({"image": k["image"].select("latitude", "longitude"),
                     "video": k["video"].select("name")})
    return u.select("kind", "latitude", "longitude")


@query("hexbin", with_media("""
SELECT lattice, i, j, round(xmin + (i + half) * sx, 6) AS cx, round(y0 + (j + half) * sy, 6) AS cy, count(*) AS n
FROM cells GROUP BY lattice, i, j, half, xmin, y0, sx, sy
""", """pts AS (SELECT latitude, longitude FROM images WHERE latitude IS NOT NULL AND longitude IS NOT NULL),
ext0 AS (SELECT min(longitude) AS x0, max(longitude) AS x1, min(latitude) AS y0, max(latitude) AS y1 FROM pts),
ext1 AS (SELECT x0 - (x1 - x0) * 1e-9 AS xmin, x1 + (x1 - x0) * 1e-9 AS xmax, y0, y1 FROM ext0),
ext AS (SELECT xmin, y0, (xmax - xmin) / 45.0 AS sx, (y1 - y0) / 25.0 AS sy FROM ext1),
uv AS (SELECT (longitude - xmin) / sx AS u, (latitude - y0) / sy AS v, xmin, y0, sx, sy FROM pts, ext),
uv2 AS (SELECT *, round_even(u, 0) AS i1, round_even(v, 0) AS j1, floor(u) AS i2, floor(v) AS j2 FROM uv),
uv3 AS (SELECT *, (u - i1) ** 2 + 3.0 * (v - j1) ** 2 AS d1, (u - i2 - 0.5) ** 2 + 3.0 * (v - j2 - 0.5) ** 2 AS d2
        FROM uv2),
cells AS (SELECT CASE WHEN d1 < d2 THEN 1 ELSE 2 END AS lattice,
                 CAST(CASE WHEN d1 < d2 THEN i1 ELSE i2 END AS BIGINT) AS i,
                 CAST(CASE WHEN d1 < d2 THEN j1 ELSE j2 END AS BIGINT) AS j,
                 CASE WHEN d1 < d2 THEN 0.0 ELSE 0.5 END AS half, xmin, y0, sx, sy FROM uv3)"""))
def hexbin(spark, sf_dir):
    return geo.hexbin(geo.geo_points(common.images(spark, sf_dir), extra=()))

"""Queries for the filter predicates (F1-F15)."""

from __future__ import annotations

from datetime import date


from medialake.operators import filters, histograms, lookup
from medialake.plans import common
from medialake.plans.registry import query
from medialake.sources import fixture
from medialake.plans.q_exprs import shutter_zero_sql
from oracle_sql import with_media

LISTING_CTE = """listing AS (
  SELECT source_file AS path, file_size AS length,
         DATE '2024-01-01' + CAST(file_size % 700 AS INT) AS modification_date
  FROM media_raw
)"""

SPECS = {
    "filter_kind": filters.FilterSpec(filetypes=("video", "other")),
    "filter_photo_only": filters.FilterSpec(filetypes=("image", "video"), cameras=("Brand#2", "Brand#19")),
    "filter_ext": filters.FilterSpec(extensions=filters.normalize_extensions(["jpg", " .CR3 ", "", "mov"])),
    "filter_date_reject": filters.FilterSpec(date_range=(date(1996, 1, 1), date(2024, 1, 15))),
    "filter_camera": filters.FilterSpec(cameras=("Brand#13", "Brand#24", "")),
    "filter_lens": filters.FilterSpec(lenses=("LensID 3", "MEDIUM 5mm f/2.8")),
    "filter_aperture": filters.FilterSpec(aperture_range=(2.0, 4.0)),
    "filter_iso": filters.FilterSpec(iso_range=(100, 800)),
    "filter_shutter": filters.FilterSpec(shutter_speed_range=("1/100", "1/20")),
    "filter_shutter_open": filters.FilterSpec(shutter_speed_range=(None, "1/250s")),
    "filter_shutter_empty": filters.FilterSpec(shutter_speed_range=("1/100", "1/500")),
    "filter_all": filters.FilterSpec(filetypes=("image",), extensions=(".jpg", ".png"),
                                     date_range=(date(1996, 1, 1), None), cameras=("Brand#2", "Brand#4", "Brand#16"),
                                     aperture_range=(None, 5.0), iso_range=(200, None),
                                     shutter_speed_range=("1/400", None)),
    "filter_empty": filters.FilterSpec(),
    "filter_open_range": filters.FilterSpec(iso_range=(None, None)),
}

SQL_WHERE = {
    "filter_kind": "kind IN ('video', 'other')",
    "filter_photo_only": "kind IN ('image', 'video') AND kind = 'image' AND camera <> '' AND camera IN ('Brand#2', 'Brand#19')",
    "filter_ext": "lower(filetype) IN ('.jpg', '.cr3', '.mov')",
    "filter_date_reject": "date_taken IS NOT NULL AND date_taken >= DATE '1996-01-01' AND date_taken <= DATE '2024-01-15'",
    "filter_camera": "kind = 'image' AND camera <> '' AND camera IN ('Brand#13', 'Brand#24', '')",
    "filter_lens": "kind = 'image' AND lens <> '' AND lens IN ('LensID 3', 'MEDIUM 5mm f/2.8')",
    "filter_aperture": "kind = 'image' AND aperture IS NOT NULL AND aperture >= 2.0 AND aperture <= 4.0",
    "filter_iso": "kind = 'image' AND iso IS NOT NULL AND iso >= 100 AND iso <= 800",
    "filter_shutter": "kind = 'image' AND coalesce(shutter_speed, '') <> '' AND s >= 0.01 AND s <= 0.05",
    "filter_shutter_open": "kind = 'image' AND coalesce(shutter_speed, '') <> '' AND s <= 0.004",
    "filter_shutter_empty": "kind = 'image' AND coalesce(shutter_speed, '') <> '' AND s >= 0.01 AND s <= 0.002",
    "filter_all": ("kind = 'image' AND lower(filetype) IN ('.jpg', '.png') AND date_taken >= DATE '1996-01-01' "
                   "AND camera <> '' AND camera IN ('Brand#2', 'Brand#4', 'Brand#16') AND aperture <= 5.0 "
                   "AND iso >= 200 AND coalesce(shutter_speed, '') <> '' AND s >= 0.0025"),
    "filter_empty": "true",
    "filter_open_range": "kind = 'image' AND iso IS NOT NULL",
}

OUT_COLS = "full_path, kind, filetype, date_taken, camera, lens, aperture, iso, shutter_speed"


def _register(name):
    sql = with_media(f"""
SELECT {OUT_COLS} FROM (SELECT *, {shutter_zero_sql('shutter_speed')} AS s FROM media)
WHERE {SQL_WHERE[name]}
""")

    @query(name, sql)
    def run(spark, sf_dir, _spec=SPECS[name]):
        m = common.media(spark, sf_dir)
        return _spec.apply(m).select(*[c.strip() for c in OUT_COLS.split(",")])
    return run


for _n in SPECS:
    _register(_n)


@query("filter_date_mtime", with_media(f"""
SELECT l.path, m.kind, m.date_taken, l.modification_date
FROM listing l JOIN media m ON l.path = m.full_path
WHERE coalesce(m.date_taken, l.modification_date) BETWEEN DATE '1996-01-01' AND DATE '2024-01-15'
""", LISTING_CTE))
def filter_date_mtime(spark, sf_dir):
    listing = fixture.media_listing(spark, sf_dir)
    j = lookup.listing_lookup(listing, common.media_by_key(spark, sf_dir), how="left", columns=["date_taken"], unique=True)
    spec = filters.FilterSpec(date_range=(date(1996, 1, 1), date(2024, 1, 15)), undated="mtime")
    return spec.apply(j, mtime_col="modification_date").select("path", "kind", "date_taken", "modification_date")


@query("select_where", with_media("""
SELECT source_file AS SourceFile, model AS Model, iso AS ISO FROM media_raw
WHERE lower(regexp_extract(source_file, '(\\.[^./]*)$', 1)) = '.jpg'
  AND (model IN ('Brand#2', 'Brand#19') OR model IS NULL) AND coalesce(iso >= 400, false)
  AND lens_model IS NOT DISTINCT FROM lens_model
"""))
def select_where(spark, sf_dir):
    tags = fixture.raw_tags(spark, sf_dir)
    r = filters.select_where(tags, Model=["Brand#2", "Brand#19", None], ISO=lambda c: c >= 400,
                             LensModel=lambda c: c.eqNullSafe(c))
    return r.select("SourceFile", "Model", "ISO")


@query("dashboard_mask", with_media("""
SELECT full_path, camera, lens, date_taken FROM images
WHERE date_trunc('month', date_taken) BETWEEN date_trunc('month', DATE '1997-03-15') AND date_trunc('month', DATE '1999-08-01')
  AND camera IN ('Brand#2', 'Brand#19', 'Brand#4') AND lens IN ('LensID 3', 'LensID 2', 'MEDIUM 5mm f/2.8')
"""))
def dashboard_mask(spark, sf_dir):
    i = common.images(spark, sf_dir)
    r = filters.dashboard_mask(i, (date(1997, 3, 15), date(1999, 8, 1)), cameras=("Brand#2", "Brand#19", "Brand#4"),
                               lenses=("LensID 3", "LensID 2", "MEDIUM 5mm f/2.8"))
    return r.select("full_path", "camera", "lens", "date_taken")


@query("dashboard_mask_default", with_media("""
SELECT full_path, camera, date_taken FROM images
WHERE date_taken IS NOT NULL AND camera IN ('Brand#2', 'Brand#19')
"""))
def dashboard_mask_default(spark, sf_dir):
    i = common.images(spark, sf_dir)
    return filters.dashboard_mask(i, None, cameras=("Brand#2", "Brand#19")).select("full_path", "camera", "date_taken")


@query("trim_quantile", with_media("""
SELECT full_path, aperture FROM images,
  (SELECT quantile_cont(aperture, 0.02) AS lo, quantile_cont(aperture, 0.98) AS hi FROM images WHERE aperture IS NOT NULL)
WHERE aperture > lo AND aperture <= hi AND aperture > 0
"""))
def trim_quantile(spark, sf_dir):
    i = common.images(spark, sf_dir)
    return histograms.trim_quantile(i, "aperture", 0.02, 0.98).select("full_path", "aperture")

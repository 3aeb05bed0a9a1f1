"""Queries for layout planning, collision policies, records, report (O*, J3, J4, K6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from medialake.operators import filters, organize
from medialake.plans import common
from medialake.plans.registry import query
from oracle_sql import with_media

ROOT = "/out"
DEFAULT = organize.LayoutOptions()
MODEL_LENS = organize.LayoutOptions(by_media_type=False, structure=("Year", "Model", "Lens"))
ORDER = ("full_path", "size_bytes")
SAN = "'[^\\p{L}\\p{N}\\p{M}_\\-. ]'"

LAYOUT_SQL = f"""lay0 AS (
  SELECT *, (kind = 'image' AND (date_taken IS NOT NULL OR coalesce(camera, '') <> '' OR coalesce(lens, '') <> ''))
            AS has_img, (kind = 'video' AND date_taken IS NOT NULL) AS has_vid FROM media
),
lay AS (
  SELECT *, CASE WHEN has_img OR has_vid THEN CAST(year(date_taken) AS VARCHAR) END AS lay_year,
         CASE WHEN has_img OR has_vid THEN lpad(CAST(month(date_taken) AS VARCHAR), 2, '0') END AS lay_month,
         CASE WHEN has_img AND coalesce(camera, '') <> '' THEN regexp_replace(camera, {SAN}, '_', 'g') END AS lay_model,
         CASE WHEN has_img AND coalesce(lens, '') <> '' THEN regexp_replace(lens, {SAN}, '_', 'g') END AS lay_lens,
         (has_img OR has_vid) AS has_layout
  FROM lay0
)"""


def _walk(fields):
    if not fields:
        return "''"
    f = organize.FIELD_COLUMNS[fields[0]]
    return f"""(CASE WHEN {f} IS NULL THEN '/No Info' ELSE '/' || {f} || {_walk(fields[1:])} END)"""


def dirs_sql(opts: organize.LayoutOptions, root: str = ROOT) -> str:
    if opts.by_media_type:
        base = f"CASE WHEN kind = 'image' THEN '{root}/Photos' WHEN kind = 'video' THEN '{root}/Videos' ELSE '{root}' END"
    else:
        base = f"'{root}'"
    return f"""dirs AS (
  SELECT *, {base} || CASE WHEN NOT has_layout THEN '/No Info' ELSE {_walk(list(opts.structure))} END AS target_dir
  FROM lay
)"""


PLAN_SQL = """plan AS (
  SELECT *, regexp_extract(full_path, '[^/]*$', 0) AS fname FROM dirs
),
plan2 AS (
  SELECT *, regexp_extract(fname, '^\\.*[^.].*(\\.[^.]*)$', 1) AS ext, target_dir || '/' || fname AS destination
  FROM plan
),
plan3 AS MATERIALIZED (
  SELECT *, CASE WHEN ext = '' THEN fname ELSE substr(fname, 1, length(fname) - length(ext)) END AS stem FROM plan2
),
existing AS MATERIALIZED (SELECT DISTINCT destination AS path FROM plan3 WHERE size_bytes % 20 = 0)"""


def _ctes(opts):
    return ",\n".join([LAYOUT_SQL, dirs_sql(opts), PLAN_SQL])


def _plan(spark, sf_dir, opts):
    return organize.plan_layout(common.media(spark, sf_dir), ROOT, opts)


def _plan_input(spark, sf_dir):
    """What planning reads; the plan is stored, so other columns stay out of it."""
    return common.media(spark, sf_dir).select("full_path", "size_bytes", "kind", "date_taken", "camera", "lens")


def _multi_input(spark, sf_dir):
    """The same, and what the targets ask for."""
    return common.media(spark, sf_dir).select("full_path", "size_bytes", "kind", "date_taken", "camera", "lens", "filetype")


def _existing(spark, sf_dir, opts=DEFAULT):
    """Pre-existing destinations: planned destinations of every 20th-byte file."""
    return _plan(spark, sf_dir, opts).where(F.col("size_bytes") % 20 == 0).select(
        F.col("destination").alias("path")).distinct()


@query("layout_fields", with_media("""
SELECT full_path, kind, lay_year, lay_month, lay_model, lay_lens, has_layout FROM lay
""", LAYOUT_SQL))
def layout_fields(spark, sf_dir):
    return organize.layout_fields(common.media(spark, sf_dir)).select(
        "full_path", "kind", "lay_year", "lay_month", "lay_model", "lay_lens", "has_layout")


@query("plan_dirs", with_media("SELECT full_path, target_dir FROM dirs", LAYOUT_SQL + ",\n" + dirs_sql(DEFAULT)))
def plan_dirs(spark, sf_dir):
    return _plan(spark, sf_dir, DEFAULT).select("full_path", "target_dir")


@query("plan_dirs_model_lens", with_media("SELECT full_path, target_dir FROM dirs",
                                          LAYOUT_SQL + ",\n" + dirs_sql(MODEL_LENS)))
def plan_dirs_model_lens(spark, sf_dir):
    return _plan(spark, sf_dir, MODEL_LENS).select("full_path", "target_dir")


SKIP_SQL = """SELECT full_path, destination,
       CASE WHEN existing.path IS NOT NULL THEN 'skipped'
            WHEN row_number() OVER (PARTITION BY destination ORDER BY full_path, size_bytes) = 1 THEN 'copied'
            ELSE 'skipped' END AS status
FROM plan3 LEFT JOIN existing ON existing.path = plan3.destination"""


@query("plan_skip", with_media(SKIP_SQL, _ctes(DEFAULT)))
def plan_skip(spark, sf_dir):
    opts = organize.LayoutOptions(on_exist="skip")
    m = organize.plan_organize(_plan_input(spark, sf_dir), ROOT, opts, existing=_existing(spark, sf_dir))
    return m.select("full_path", "destination", "status")


@query("plan_skip_fresh", with_media("""
SELECT full_path, destination,
       CASE WHEN row_number() OVER (PARTITION BY destination ORDER BY full_path, size_bytes) = 1 THEN 'copied'
            ELSE 'skipped' END AS status FROM plan3""", _ctes(DEFAULT)))
def plan_skip_fresh(spark, sf_dir):
    opts = organize.LayoutOptions(on_exist="skip")
    return organize.plan_organize(_plan_input(spark, sf_dir), ROOT, opts).select("full_path", "destination", "status")


def rename_sql(with_existing: bool) -> tuple[str, str]:
    """(CTEs, select) of the sequential rename rule, one list fold per family."""
    init = ("coalesce((SELECT list(e.stem) FROM ex e WHERE e.target_dir = f.target_dir AND e.ext = f.ext "
            "AND e.root = f.root), []::VARCHAR[])" if with_existing else "[]::VARCHAR[]")
    ex = """ex AS (
  SELECT target_dir, ext, stem, regexp_replace(stem, '(_[0-9]+)+$', '') AS root FROM (
    SELECT regexp_extract(path, '^(.*)/', 1) AS target_dir, ext,
           CASE WHEN ext = '' THEN fname ELSE substr(fname, 1, length(fname) - length(ext)) END AS stem
    FROM (SELECT path, fname, regexp_extract(fname, '^\\.*[^.].*(\\.[^.]*)$', 1) AS ext
          FROM (SELECT path, regexp_extract(path, '[^/]*$', 0) AS fname FROM existing)))
),"""
    return f"""{ex}
p4 AS (
  SELECT *, regexp_replace(stem, '(_[0-9]+)+$', '') AS root,
         row_number() OVER (PARTITION BY target_dir, ext, regexp_replace(stem, '(_[0-9]+)+$', '')
                            ORDER BY full_path, size_bytes) AS pos
  FROM plan3
),
fam AS (SELECT target_dir, ext, root, list(stem ORDER BY pos) AS stems FROM p4 GROUP BY target_dir, ext, root),
fam2 AS (SELECT f.*, {init} AS init FROM fam f),
solved AS (
  SELECT target_dir, ext, root, len(init) AS n0,
         list_reduce(stems, lambda acc, x: list_append(acc, list_filter(
             list_transform(range(0, len(acc) + 2), lambda k: CASE WHEN k = 0 THEN x ELSE x || '_' || CAST(k AS VARCHAR) END),
             lambda c: NOT list_contains(acc, c))[1]), init) AS names
  FROM fam2
)""", """SELECT p4.full_path, p4.target_dir || '/' || s.names[s.n0 + p4.pos] || p4.ext AS destination
FROM p4 JOIN solved s ON s.target_dir = p4.target_dir AND s.ext = p4.ext AND s.root = p4.root"""


def _rename_query(opts, with_existing):
    ctes, sel = rename_sql(with_existing)
    return with_media(sel, _ctes(opts) + ",\n" + ctes)


@query("plan_rename", _rename_query(DEFAULT, True))
def plan_rename(spark, sf_dir):
    m = organize.plan_organize(_plan_input(spark, sf_dir), ROOT, DEFAULT, existing=_existing(spark, sf_dir))
    return m.select("full_path", "destination")


@query("plan_rename_fresh", _rename_query(DEFAULT, False))
def plan_rename_fresh(spark, sf_dir):
    m = organize.plan_organize(_plan_input(spark, sf_dir), ROOT, DEFAULT)
    return m.select("full_path", "destination")


@query("plan_rename_model_lens", _rename_query(MODEL_LENS, False))
def plan_rename_model_lens(spark, sf_dir):
    m = organize.plan_organize(_plan_input(spark, sf_dir), ROOT, MODEL_LENS)
    return m.select("full_path", "destination")


RECORDS_SQL = f"""skipm AS ({SKIP_SQL.replace('FROM plan3', ', kind, size_bytes, size_mb FROM plan3')})
SELECT kind, destination AS full_path,
       CASE WHEN e = '' THEN f ELSE substr(f, 1, length(f) - length(e)) END AS name,
       regexp_replace(regexp_extract(destination, '^(.*/)', 1), '/+$', '') AS directory,
       CASE WHEN kind = 'other' THEN lower(e) END AS filetype_other, size_bytes,
       CASE WHEN kind <> 'other' THEN size_mb WHEN size_bytes IS NULL OR size_bytes = 0 THEN 0.0
            ELSE round_even(size_bytes / 1048576.0, 2) END AS size_mb
FROM (SELECT *, regexp_extract(f, '^\\.*[^.].*(\\.[^.]*)$', 1) AS e
      FROM (SELECT *, regexp_extract(destination, '[^/]*$', 0) AS f FROM skipm))"""


@query("organized_rows", with_media(RECORDS_SQL.split("\n", 1)[1], _ctes(DEFAULT) + ",\n" + RECORDS_SQL.split("\n", 1)[0]))
def organized_rows(spark, sf_dir):
    opts = organize.LayoutOptions(on_exist="skip")
    media = common.media(spark, sf_dir).select(*_plan_input(spark, sf_dir).columns, "size_mb")  # and what the records ask for
    m = organize.plan_organize(media, ROOT, opts, existing=_existing(spark, sf_dir))
    recs = organize.organized_rows(m)
    out = None
    for kind, df in recs.items():
        d = df.select(F.lit(kind).alias("kind"), "full_path", "name", "directory",
                      (F.col("filetype") if kind == "other" else F.lit(None).cast("string")).alias("filetype_other"),
                      "size_bytes", "size_mb")
        out = d if out is None else out.unionByName(d)
    return out


@query("organize_report", with_media(f"""
SELECT count(*) AS total, count_if(status = 'copied') AS copied, count_if(status IN ('skipped', 'error')) AS excluded
FROM ({SKIP_SQL})""", _ctes(DEFAULT)))
def organize_report(spark, sf_dir):
    opts = organize.LayoutOptions(on_exist="skip")
    m = organize.plan_organize(_plan_input(spark, sf_dir), ROOT, opts, existing=_existing(spark, sf_dir))
    return organize.organize_report(m)


TARGETS = [
    organize.Target("/E/Photos/Canon", filters.FilterSpec(filetypes=("image",), extensions=(".cr3", ".jpg")),
                    organize.LayoutOptions(by_media_type=False, on_exist="skip")),
    organize.Target("/D/Photos/Canon", filters.FilterSpec(filetypes=("image",), extensions=(".cr3", ".jpg")),
                    organize.LayoutOptions(by_media_type=False, on_exist="skip")),
    organize.Target("/E/Videos", filters.FilterSpec(filetypes=("video",), extensions=(".mp4",)),
                    organize.LayoutOptions(by_media_type=False, on_exist="skip")),
]


def _multi_sql():
    parts = []
    for i, (root, kinds, exts) in enumerate([("/E/Photos/Canon", "image", "('.cr3', '.jpg')"),
                                              ("/D/Photos/Canon", "image", "('.cr3', '.jpg')"),
                                              ("/E/Videos", "video", "('.mp4')")]):
        walk = _walk(["Year", "Month"])
        parts.append(f"""SELECT {i} AS target_id, full_path, size_bytes,
  '{root}' || CASE WHEN NOT has_layout THEN '/No Info' ELSE {walk} END || '/' || regexp_extract(full_path, '[^/]*$', 0)
  AS destination FROM lay WHERE kind = '{kinds}' AND lower(filetype) IN {exts}""")
    return "t AS (" + "\nUNION ALL\n".join(parts) + ")"


@query("organize_multi", with_media("""
SELECT target_id, full_path, destination,
       CASE WHEN row_number() OVER (PARTITION BY target_id, destination ORDER BY full_path, size_bytes) = 1
            THEN 'copied' ELSE 'skipped' END AS status
FROM t""", LAYOUT_SQL + ",\n" + _multi_sql()))
def organize_multi(spark, sf_dir):
    m = organize.organize_multi(_multi_input(spark, sf_dir), TARGETS)
    return m.select("target_id", "full_path", "destination", "status")


@query("organize_multi_existing", with_media("""
SELECT t.target_id, t.full_path, t.destination,
       CASE WHEN e.destination IS NOT NULL THEN 'skipped'
            WHEN row_number() OVER (PARTITION BY t.target_id, t.destination ORDER BY t.full_path, t.size_bytes) = 1
            THEN 'copied' ELSE 'skipped' END AS status
FROM t LEFT JOIN (SELECT DISTINCT destination FROM t WHERE size_bytes % 20 = 0) e ON e.destination = t.destination
""", LAYOUT_SQL + ",\n" + _multi_sql()))
def organize_multi_existing(spark, sf_dir):
    """Against what already lies in each target: every 20th-byte file's place."""
    media = _multi_input(spark, sf_dir)
    there = organize.organize_multi(media.where(F.col("size_bytes") % 20 == 0), TARGETS)
    m = organize.organize_multi(media, TARGETS, existing=there.select(F.col("destination").alias("path")))
    return m.select("target_id", "full_path", "destination", "status")


@query("organize_excluded", with_media(f"SELECT full_path, status FROM ({SKIP_SQL}) WHERE status = 'skipped'", _ctes(DEFAULT)))
def organize_excluded(spark, sf_dir):
    opts = organize.LayoutOptions(on_exist="skip")
    m = organize.plan_organize(_plan_input(spark, sf_dir), ROOT, opts, existing=_existing(spark, sf_dir))
    return organize.excluded_files(m)

"""Queries for conform (E1) and the scalar expressions (E3-E19, S6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from medialake.functions import dates, numbers, paths, text
from medialake.plans import common
from medialake.plans.registry import query
from medialake.sources import fixture
from oracle_sql import CC, SHUTTER_TEXT, with_media, with_raw

IMAGE_COLS = ("name, filetype, directory, full_path, date_taken, time_taken, camera, lens, focal_length, "
              "aperture, iso, shutter_speed, latitude, longitude, altitude, size_bytes, size_mb, width, height")
VIDEO_COLS = ("name, filetype, directory, full_path, date_taken, time_taken, size_bytes, size_mb, width, "
              "height, duration_ms, codec, frame_rate")


@query("conform_images", with_media("SELECT * FROM images"))
def conform_images(spark, sf_dir):
    return common.images(spark, sf_dir)


@query("conform_videos", with_media("SELECT * FROM videos"))
def conform_videos(spark, sf_dir):
    return common.videos(spark, sf_dir)


@query("conform_others", with_media("SELECT * FROM others"))
def conform_others(spark, sf_dir):
    return common.others(spark, sf_dir)


@query("path_parts", with_raw(r"""
SELECT source_file AS path,
       CASE WHEN ext = '' THEN base ELSE substr(base, 1, length(base) - length(ext)) END AS name,
       lower(ext) AS filetype, ext AS suffix,
       CASE WHEN regexp_full_match(head, '/+') THEN head ELSE regexp_replace(head, '/+$', '') END AS directory
FROM (SELECT source_file, base, head, regexp_extract(base, '^\.*[^.].*(\.[^.]*)$', 1) AS ext
      FROM (SELECT source_file, regexp_extract(source_file, '[^/]*$', 0) AS base,
                   regexp_extract(source_file, '^(.*/)', 1) AS head FROM media_raw))
"""))
def path_parts(spark, sf_dir):
    p = F.col("source_file")
    return fixture.media_raw(spark, sf_dir).select(
        p.alias("path"), paths.stem(p).alias("name"), paths.filetype(p).alias("filetype"),
        paths.extension(p).alias("suffix"), paths.dirname(p).alias("directory"))


@query("normalize_path", with_raw("""
SELECT source_file AS path, '/media/../media/./' || substr(source_file, 8) AS messy,
       replace(source_file, '/', '//') AS doubled, source_file AS key_messy, '/' || source_file AS key_doubled
FROM media_raw
"""))
def normalize_path(spark, sf_dir):
    """Messy spellings of each path and their keys (all paths start with ``/media/``)."""
    p = F.col("source_file")
    messy = F.concat(F.lit("/media/../media/./"), F.regexp_replace(p, "^/media/", ""))
    doubled = F.regexp_replace(p, "/", "//")
    m = fixture.media_raw(spark, sf_dir)
    return m.select(p.alias("path"), messy.alias("messy"), doubled.alias("doubled"),
                    paths.normalize_path(messy).alias("key_messy"),
                    paths.normalize_path(doubled).alias("key_doubled"))


@query("parse_dates", with_raw("""
SELECT source_file, date_time_original,
       CAST(try_strptime(split_part(date_time_original, ' ', 1), '%Y:%m:%d') AS DATE) AS date_taken,
       CASE WHEN strpos(date_time_original, ' ') = 0 THEN NULL
            ELSE substr(date_time_original, strpos(date_time_original, ' ') + 1) END AS time_taken
FROM media_raw
"""))
def parse_dates(spark, sf_dir):
    m = fixture.media_raw(spark, sf_dir)
    d, t = dates.split_datetime(F.col("date_time_original"))
    return m.select("source_file", "date_time_original",
                    dates.parse_exif_date(d).alias("date_taken"), t.alias("time_taken"))


@query("shutter_format", with_raw(f"""
SELECT source_file, e AS exposure_time, {SHUTTER_TEXT} AS shutter_speed
FROM (SELECT source_file, exposure_time AS e FROM media_raw)
"""))
def shutter_format(spark, sf_dir):
    m = fixture.media_raw(spark, sf_dir)
    return m.select("source_file", F.col("exposure_time"),
                    numbers.format_shutter(F.col("exposure_time")).alias("shutter_speed"))


def shutter_zero_sql(t: str) -> str:
    """SQL twin of ``parse_shutter(bad='zero')`` over column ``t``."""
    s = f"replace(lower({t}), 's', '')"
    parts = f"string_split({s}, '/')"
    return (f"CASE WHEN {t} IS NULL OR {t} = '' THEN 0.0 ELSE coalesce("
            f"CASE WHEN len({parts}) = 2 THEN TRY_CAST({parts}[1] AS DOUBLE) / nullif(TRY_CAST({parts}[2] AS DOUBLE), 0) "
            f"WHEN len({parts}) = 1 THEN TRY_CAST({s} AS DOUBLE) END, 0.0) END")


def shutter_null_sql(t: str) -> str:
    """SQL twin of ``parse_shutter(bad='null')`` over column ``t``."""
    s = f"regexp_replace({t}, 's+$', '')"
    parts = f"string_split({s}, '/')"
    return (f"CASE WHEN len({parts}) = 2 THEN TRY_CAST({parts}[1] AS DOUBLE) / nullif(TRY_CAST({parts}[2] AS DOUBLE), 0) "
            f"WHEN len({parts}) = 1 THEN TRY_CAST({s} AS DOUBLE) END")


@query("shutter_parse", with_media(f"""
SELECT full_path, t AS shutter_speed, {shutter_zero_sql('t')} AS seconds_filter, {shutter_null_sql('t')} AS seconds_chart
FROM (SELECT full_path, shutter_speed AS t FROM images)
"""))
def shutter_parse(spark, sf_dir):
    i = common.images(spark, sf_dir)
    t = F.col("shutter_speed")
    return i.select("full_path", t, numbers.parse_shutter(t, "zero").alias("seconds_filter"),
                    numbers.parse_shutter(t, "null").alias("seconds_chart"))


@query("size_mb", with_raw("""
SELECT source_file, file_size, round_even(file_size / 1048576.0, 2) AS size_mb FROM media_raw
"""))
def size_mb(spark, sf_dir):
    m = fixture.media_raw(spark, sf_dir)
    return m.select("source_file", "file_size", numbers.size_mb(F.col("file_size")).alias("size_mb"))


@query("to_float", with_raw("""
SELECT source_file, focal_length AS focal_text, TRY_CAST(focal_length AS DOUBLE) AS focal_length
FROM media_raw WHERE focal_length IS NOT NULL
"""))
def to_float(spark, sf_dir):
    m = fixture.media_raw(spark, sf_dir).where(F.col("focal_length").isNotNull())
    return m.select("source_file", F.col("focal_length").alias("focal_text"),
                    numbers.to_float(F.col("focal_length")).alias("focal_length"))


@query("clean_text", f"""
SELECT doc_id, length(text) AS n_chars_in, length(c) AS n_chars_out, md5(c) AS text_md5
FROM (SELECT doc_id, text, regexp_replace(text, {CC}, '', 'g') AS c FROM documents)
""")
def clean_text(spark, sf_dir):
    d = fixture.table(spark, sf_dir, "documents")
    c = text.clean_text(F.col("text"))
    return d.select("doc_id", F.length("text").cast("bigint").alias("n_chars_in"),
                    F.length(c).cast("bigint").alias("n_chars_out"), F.md5(c).alias("text_md5"))


@query("sanitize", with_media("""
SELECT field, value, regexp_replace(value, '[^\\p{L}\\p{N}\\p{M}_\\-. ]', '_', 'g') AS folder
FROM (SELECT DISTINCT 'camera' AS field, camera AS value FROM images WHERE camera IS NOT NULL
      UNION SELECT DISTINCT 'lens', lens FROM images WHERE lens IS NOT NULL)
"""))
def sanitize(spark, sf_dir):
    i = common.images(spark, sf_dir)
    vals = (i.where(F.col("camera").isNotNull()).select(F.lit("camera").alias("field"), F.col("camera").alias("value"))
            .unionByName(i.where(F.col("lens").isNotNull()).select(F.lit("lens").alias("field"), F.col("lens").alias("value")))
            .distinct())
    return vals.select("field", "value", text.sanitize_folder_name(F.col("value")).alias("folder"))


@query("year_month", with_media("""
SELECT full_path, kind, CAST(year(date_taken) AS VARCHAR) AS year,
       lpad(CAST(month(date_taken) AS VARCHAR), 2, '0') AS month
FROM media WHERE kind <> 'other'
"""))
def year_month(spark, sf_dir):
    m = common.media(spark, sf_dir).where(F.col("kind") != "other")
    return m.select("full_path", "kind", dates.year_text("date_taken").alias("year"),
                    dates.month_text("date_taken").alias("month"))


def _fixed_sql(c: str) -> str:
    return f"CASE WHEN substr({c}, 6, 2) = '07' THEN substr({c}, 1, 5) || '06' || substr({c}, 8) ELSE {c} END"


@query("fix_month", with_raw(f"""
SELECT source_file, {_fixed_sql('date_time_original')} AS date_time_original, {_fixed_sql('create_date')} AS create_date,
       {_fixed_sql('modify_date')} AS modify_date,
       coalesce(substr(date_time_original, 6, 2) = '07', false) OR coalesce(substr(create_date, 6, 2) = '07', false)
       OR coalesce(substr(modify_date, 6, 2) = '07', false) AS modified
FROM (SELECT *, CASE WHEN file_size % 4 = 0 THEN '2020:07:09 10:11:12' ELSE create_date END AS modify_date FROM media_raw)
WHERE lower(regexp_extract(source_file, '(\\.[^./]*)$', 1)) IN ('.jpg', '.jpeg')
"""))
def fix_month(spark, sf_dir):
    """Three date tags, one ``modified`` flag."""
    m = fixture.media_raw(spark, sf_dir)
    m = m.where(F.lower(F.regexp_extract("source_file", r"(\.[^./]*)$", 1)).isin(".jpg", ".jpeg"))
    m = m.withColumn("modify_date", F.when(F.col("file_size") % 4 == 0, F.lit("2020:07:09 10:11:12"))
                     .otherwise(F.col("create_date")))
    return dates.fix_month(m, ["date_time_original", "create_date", "modify_date"], "07", "06").select(
        "source_file", "date_time_original", "create_date", "modify_date", "modified")


@query("parse_date_text", with_raw("""
SELECT source_file, t AS text, CAST(try_strptime(regexp_replace(regexp_extract(split_part(trim(t), ' ', 1),
         '^([0-9]+)([:-])([0-9]+)[:-]([0-9]+)$', 0), ':', '-', 'g'), '%Y-%m-%d') AS DATE) AS day
FROM (SELECT source_file, CASE file_size % 3 WHEN 0 THEN date_time_original WHEN 1 THEN replace(date_time_original, ':', '-')
             ELSE 'about ' || date_time_original END AS t FROM media_raw)
"""))
def parse_date_text(spark, sf_dir):
    """Tolerant dates: colons, dashes, and text that is no date."""
    o = F.col("date_time_original")
    k = F.col("file_size") % 3
    t = F.when(k == 0, o).when(k == 1, F.replace(o, F.lit(":"), F.lit("-"))).otherwise(F.concat(F.lit("about "), o))
    return fixture.media_raw(spark, sf_dir).select("source_file", t.alias("text"), dates.parse_date_text(t).alias("day"))


@query("date_repair", with_raw("""
SELECT source_file, date_time_original AS raw_text,
       CAST(coalesce(
         try_strptime(regexp_replace(date_time_original, '^(\\d{4}):(\\d{2}):(\\d{2})', '\\1-\\2-\\3'), '%Y-%m-%d'),
         try_strptime(regexp_replace(date_time_original, '^(\\d{4}):(\\d{2}):(\\d{2})', '\\1-\\2-\\3'), '%Y-%m-%d %H:%M:%S'))
         AS DATE) AS date_taken
FROM media_raw WHERE date_time_original IS NOT NULL
"""))
def date_repair(spark, sf_dir):
    m = fixture.media_raw(spark, sf_dir).where(F.col("date_time_original").isNotNull())
    return m.select("source_file", F.col("date_time_original").alias("raw_text"),
                    dates.repair_mixed_date(F.col("date_time_original")).alias("date_taken"))

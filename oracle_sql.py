"""DuckDB oracle SQL for the registered queries.

Every oracle starts with the fixture CTE ``media_raw`` and a hand-written SQL
conform chain (``media``, ``images``, ``videos``, ``others``); the query body
then restates the operator's semantics in plain SQL. Column names equal the
Spark outputs.
"""

from __future__ import annotations

from medialake.sources.fixture import oracle_media_raw

CC = r"'[\x00-\x1F\x7F-\x9F]'"


def _clean(c: str) -> str:
    return f"regexp_replace({c}, {CC}, '', 'g')"


IMAGE_EXT = "('.jpg', '.jpeg', '.png', '.webp', '.cr2', '.cr3')"
VIDEO_EXT = "('.mp4', '.mov', '.avi', '.mkv', '.m4v', '.3gp', '.gif')"

SHUTTER_TEXT = """CASE WHEN e IS NULL THEN NULL WHEN e = 0 THEN '0'
       WHEN e < 1 THEN '1/' || CAST(CAST(round_even(1.0 / e, 0) AS BIGINT) AS VARCHAR) || 's'
       WHEN e = floor(e) THEN CAST(CAST(e AS BIGINT) AS VARCHAR) || 's'
       ELSE CAST(e AS VARCHAR) || 's' END"""

CONFORM_CTES = f"""
ml_r AS (
  SELECT {_clean('source_file')} AS sf, file_size,
         {_clean('date_time_original')} AS dto, {_clean('create_date')} AS cd,
         {_clean('model')} AS model, {_clean('lens_model')} AS lens_model, {_clean('lens_id')} AS lens_id,
         {_clean('focal_length')} AS focal_txt, f_number, iso, exposure_time AS e,
         gps_latitude, gps_longitude, gps_altitude, image_width, image_height, duration,
         {_clean('video_codec_id')} AS video_codec_id, video_frame_rate
  FROM media_raw WHERE source_file IS NOT NULL AND source_file <> ''
),
ml_p AS (
  SELECT *, regexp_extract(sf, '[^/]*$', 0) AS base, regexp_extract(sf, '^(.*/)', 1) AS head,
         coalesce(nullif(dto, ''), cd) AS dtf
  FROM ml_r
),
ml_q AS (
  SELECT *, regexp_extract(base, '^\\.*[^.].*(\\.[^.]*)$', 1) AS ext,
         CASE WHEN dtf IS NULL OR dtf = '' THEN NULL ELSE split_part(dtf, ' ', 1) END AS dtext,
         CASE WHEN dtf IS NULL OR dtf = '' OR strpos(dtf, ' ') = 0 THEN NULL
              ELSE substr(dtf, strpos(dtf, ' ') + 1) END AS ttext
  FROM ml_p
),
ml_k AS (
  SELECT *, CASE WHEN lower(ext) IN {IMAGE_EXT} THEN 'image'
                 WHEN lower(ext) IN {VIDEO_EXT} THEN 'video' ELSE 'other' END AS kind
  FROM ml_q
),
media AS MATERIALIZED (
  SELECT
    CASE WHEN ext = '' THEN base ELSE substr(base, 1, length(base) - length(ext)) END AS name,
    lower(ext) AS filetype,
    CASE WHEN regexp_full_match(head, '/+') THEN head ELSE regexp_replace(head, '/+$', '') END AS directory,
    sf AS full_path,
    kind,
    CASE WHEN kind <> 'other' THEN CAST(try_strptime(dtext, '%Y:%m:%d') AS DATE) END AS date_taken,
    CASE WHEN kind <> 'other' THEN ttext END AS time_taken,
    CASE WHEN kind = 'image' THEN model END AS camera,
    CASE WHEN kind = 'image' THEN coalesce(nullif(lens_model, ''), lens_id) END AS lens,
    CASE WHEN kind = 'image' THEN TRY_CAST(focal_txt AS DOUBLE) END AS focal_length,
    CASE WHEN kind = 'image' THEN nullif(f_number, 0) END AS aperture,
    CASE WHEN kind = 'image' THEN CAST(iso AS BIGINT) END AS iso,
    CASE WHEN kind = 'image' THEN {SHUTTER_TEXT} END AS shutter_speed,
    CASE WHEN kind = 'image' THEN gps_latitude END AS latitude,
    CASE WHEN kind = 'image' THEN gps_longitude END AS longitude,
    CASE WHEN kind = 'image' THEN gps_altitude END AS altitude,
    CAST(file_size AS BIGINT) AS size_bytes,
    round_even(file_size / 1048576.0, 2) AS size_mb,
    CASE WHEN kind = 'image' THEN nullif(image_width, 0) WHEN kind = 'video' THEN image_width END AS width,
    CASE WHEN kind = 'image' THEN nullif(image_height, 0) WHEN kind = 'video' THEN image_height END AS height,
    CASE WHEN kind = 'video' THEN CASE WHEN duration <> 0 THEN duration * 1000 ELSE duration END END AS duration_ms,
    CASE WHEN kind = 'video' THEN nullif(video_codec_id, '') END AS codec,
    CASE WHEN kind = 'video' THEN video_frame_rate END AS frame_rate
  FROM ml_k
),
images AS (
  SELECT name, filetype, directory, full_path, date_taken, time_taken, camera, lens, focal_length,
         aperture, iso, shutter_speed, latitude, longitude, altitude, size_bytes, size_mb, width, height
  FROM media WHERE kind = 'image'
),
videos AS (
  SELECT name, filetype, directory, full_path, date_taken, time_taken, size_bytes, size_mb, width,
         height, duration_ms, codec, frame_rate
  FROM media WHERE kind = 'video'
),
others AS (
  SELECT name, filetype, directory, full_path, size_bytes, size_mb FROM media WHERE kind = 'other'
)"""


def with_media(body: str, extra_ctes: str = "") -> str:
    """``WITH media_raw AS (...), <conform chain>[, extra] <body>``."""
    extra = f",\n{extra_ctes}" if extra_ctes else ""
    return f"WITH media_raw AS MATERIALIZED ({oracle_media_raw()}),\n{CONFORM_CTES}{extra}\n{body}"


def with_raw(body: str, extra_ctes: str = "") -> str:
    extra = f",\n{extra_ctes}" if extra_ctes else ""
    return f"WITH media_raw AS ({oracle_media_raw()}){extra}\n{body}"

"""``media_raw``: raw tag records derived from the driver's test tables.

The same SQL text runs in Spark SQL and DuckDB, so it is both the Spark input
of every registered query and the head of every oracle. Tables are referenced
through ``{lineitem}`` style placeholders: parquet paths for Spark, view names
for the oracle.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEDIA_RAW_SQL = """
SELECT concat('/media/card', CAST(l.l_suppkey AS STRING), '/DCIM/', CAST(l.l_orderkey AS STRING), '_', CAST(l.l_partkey AS STRING), '/IMG_',
         CAST(l.l_partkey % 100 AS STRING),
         CASE WHEN l.l_linenumber = 1 THEN '' ELSE concat('_', CAST(l.l_linenumber - 1 AS STRING)) END,
         CASE l.l_partkey % 6 WHEN 0 THEN '.jpg' WHEN 1 THEN '.JPG' WHEN 2 THEN '.jpeg' WHEN 3 THEN '.png' WHEN 4 THEN '.cr2' ELSE '.CR3' END) AS source_file,
       CAST(round(l.l_extendedprice * 100) AS BIGINT) AS file_size,
       CASE WHEN l.l_partkey % 11 = 0 THEN NULL WHEN l.l_partkey % 97 = 0 THEN '0000:00:00 00:00:00'
            ELSE concat(CAST(year(l.l_shipdate) AS STRING), ':', lpad(CAST(month(l.l_shipdate) AS STRING), 2, '0'), ':', lpad(CAST(day(l.l_shipdate) AS STRING), 2, '0'),
                        ' ', lpad(CAST(CAST(l.l_quantity AS BIGINT) % 24 AS STRING), 2, '0'), ':', lpad(CAST(CAST(l.l_quantity AS BIGINT) AS STRING), 2, '0'), ':00') END AS date_time_original,
       CASE WHEN l.l_partkey % 22 = 0 THEN concat(CAST(year(l.l_shipdate) AS STRING), ':', lpad(CAST(month(l.l_shipdate) AS STRING), 2, '0'), ':', lpad(CAST(day(l.l_shipdate) AS STRING), 2, '0')) ELSE NULL END AS create_date,
       CASE WHEN l.l_suppkey % 13 = 0 THEN NULL ELSE p.p_brand END AS model,
       CASE WHEN l.l_linenumber = 7 THEN NULL WHEN l.l_linenumber = 6 THEN '' ELSE concat(p.p_type, ' ', CAST(p.p_size % 10 AS STRING), 'mm f/2.8') END AS lens_model,
       CASE WHEN l.l_linenumber = 6 THEN concat('LensID ', CAST(p.p_size % 5 AS STRING)) ELSE NULL END AS lens_id,
       CASE WHEN p.p_size % 17 = 0 THEN 'undef' ELSE CAST(p.p_size AS STRING) END AS focal_length,
       CASE WHEN CAST(l.l_quantity AS BIGINT) % 9 = 0 THEN NULL ELSE (14 + l.l_quantity) / 10 END AS f_number,
       CASE WHEN CAST(l.l_quantity AS BIGINT) % 8 = 0 THEN NULL ELSE 50 * CAST(l.l_quantity AS BIGINT) END AS iso,
       CASE WHEN l.l_partkey % 10 = 0 THEN CAST(1 + l.l_linenumber AS DOUBLE) WHEN l.l_partkey % 10 = 1 THEN NULL ELSE CAST(1 AS DOUBLE) / (10 * l.l_quantity) END AS exposure_time,
       CASE WHEN l.l_suppkey % 3 = 0 THEN CAST((l.l_partkey * 37) % 18000 - 9000 AS DOUBLE) / 100 ELSE NULL END AS gps_latitude,
       CASE WHEN l.l_suppkey % 3 = 0 THEN CAST((l.l_orderkey * 53) % 36000 - 18000 AS DOUBLE) / 100 ELSE NULL END AS gps_longitude,
       CASE WHEN l.l_suppkey % 3 = 0 THEN CAST(l.l_linenumber * 71 AS DOUBLE) / 10 ELSE NULL END AS gps_altitude,
       CAST(1000 * l.l_linenumber AS BIGINT) AS image_width, CAST(700 * l.l_linenumber AS BIGINT) AS image_height,
       CAST(NULL AS DOUBLE) AS duration, CAST(NULL AS STRING) AS video_codec_id, CAST(NULL AS DOUBLE) AS video_frame_rate
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey
UNION ALL
SELECT concat('/media/phone', CAST(user_id % 5 AS STRING), '/VID/', event_type, '/VID_', CAST(event_id AS STRING),
         CASE event_id % 4 WHEN 0 THEN '.mp4' WHEN 1 THEN '.MOV' WHEN 2 THEN '.avi' ELSE '.mkv' END),
       CAST(round(value * 100000) AS BIGINT), NULL,
       CASE WHEN event_id % 41 = 0 THEN NULL WHEN event_id % 50 = 0 THEN '1970:01:01 00:00:00'
            ELSE concat(CAST(year(ts) AS STRING), ':', lpad(CAST(month(ts) AS STRING), 2, '0'), ':', lpad(CAST(day(ts) AS STRING), 2, '0'), ' ',
                        lpad(CAST(hour(ts) AS STRING), 2, '0'), ':', lpad(CAST(minute(ts) AS STRING), 2, '0'), ':00') END,
       NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
       CAST(1920 AS BIGINT), CAST(1080 AS BIGINT),
       CASE WHEN event_id % 23 = 0 THEN NULL ELSE value END,
       CASE event_type WHEN 'click' THEN 'avc1' WHEN 'view' THEN 'hvc1' ELSE NULL END,
       CASE WHEN event_id % 7 = 0 THEN 29.97 ELSE CAST(30 AS DOUBLE) END
FROM {events}
UNION ALL
SELECT concat('/media/docs/', source, '/', CASE WHEN doc_id % 10 = 0 THEN concat('README', CAST(doc_id AS STRING)) ELSE concat('doc.', CAST(doc_id AS STRING), '.TXT') END),
       n_chars, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
FROM {documents}
"""

FIXTURE_TABLES = ("lineitem", "part", "events", "documents")
# large tables and the columns by which their rows are dealt to tasks
DEALT_BY = {"lineitem": "l_orderkey, l_linenumber", "events": "event_id"}

# fixture column -> raw tag name (fixed values of the fixture definition)
RAW_TAG_NAMES = {
    "source_file": "SourceFile", "file_size": "FileSize",
    "date_time_original": "DateTimeOriginal", "create_date": "CreateDate",
    "model": "Model", "lens_model": "LensModel", "lens_id": "LensID",
    "focal_length": "FocalLength", "f_number": "FNumber", "iso": "ISO",
    "exposure_time": "ExposureTime", "gps_latitude": "GPSLatitude",
    "gps_longitude": "GPSLongitude", "gps_altitude": "GPSAltitude",
    "image_width": "ImageWidth", "image_height": "ImageHeight",
    "duration": "Duration", "video_codec_id": "VideoCodecID",
    "video_frame_rate": "VideoFrameRate",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def media_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``media_raw`` view over ``sf_dir`` (no temp views, no global state).

    Tag records are made from few compressed bytes, so the splits of a file hold
    very many of them: the narrow rows of the two large tables are dealt to
    ``spark.sql.shuffle.partitions`` tasks before the records are made. Where
    ``part`` is too large to be broadcast, the join with it deals ``lineitem``."""
    sub = {t: f"parquet.`{os.path.join(sf_dir, t + '.parquet')}`" for t in FIXTURE_TABLES}
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def dealt(tables) -> DataFrame:
        return spark.sql(MEDIA_RAW_SQL.format(**sub | {
            t: f"(SELECT /*+ REPARTITION({n}, {DEALT_BY[t]}) */ * FROM {sub[t]})" for t in tables}))

    joined = dealt(["events"])
    if "BroadcastHashJoin" not in joined._jdf.queryExecution().sparkPlan().toString():
        return joined
    return dealt(DEALT_BY)


def raw_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``media_raw`` renamed to raw tag names (``RAW_TAGS`` subset)."""
    df = media_raw(spark, sf_dir)
    return df.select(*[F.col(c).alias(t) for c, t in RAW_TAG_NAMES.items()])


def media_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File listing derived from ``media_raw``: path, length, modification date."""
    m = media_raw(spark, sf_dir)
    return m.select(
        F.col("source_file").alias("path"),
        F.col("file_size").alias("length"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("file_size") % 700).cast("int"))
        .alias("modification_date"),
    )


def oracle_media_raw() -> str:
    """The fixture as a DuckDB CTE body over the pre-registered views."""
    return MEDIA_RAW_SQL.format(**{t: t for t in FIXTURE_TABLES})

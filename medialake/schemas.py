"""Canonical table schemas and the ``conform`` projection.

One missing value everywhere: SQL NULL (NaN is turned into NULL at ingest).
Spark column names use ``full_path`` / ``size_mb``; sinks may alias them back
to the display names ``Full path`` / ``size (MB)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, D, L, DT = T.StringType(), T.DoubleType(), T.LongType(), T.DateType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# Raw tag record as delivered by a tag extractor (numeric values, ``-n`` style).
RAW_TAGS = _struct(
    ("SourceFile", S), ("Directory", S), ("FileSize", L),
    ("DateTimeOriginal", S), ("CreateDate", S), ("Model", S),
    ("LensModel", S), ("LensID", S), ("FocalLength", S), ("FNumber", D),
    ("Aperture", D), ("ISO", L), ("ExposureTime", D), ("GPSLatitude", D),
    ("GPSLongitude", D), ("GPSAltitude", D), ("ImageWidth", L),
    ("ImageHeight", L), ("ExifImageWidth", L), ("ExifImageHeight", L),
    ("Duration", D), ("VideoCodecID", S), ("CompressorID", S),
    ("VideoFrameRate", D),
)

IMAGE = _struct(
    ("name", S), ("filetype", S), ("directory", S), ("full_path", S),
    ("date_taken", DT), ("time_taken", S), ("camera", S), ("lens", S),
    ("focal_length", D), ("aperture", D), ("iso", L), ("shutter_speed", S),
    ("latitude", D), ("longitude", D), ("altitude", D), ("size_bytes", L),
    ("size_mb", D), ("width", L), ("height", L),
)

VIDEO = _struct(
    ("name", S), ("filetype", S), ("directory", S), ("full_path", S),
    ("date_taken", DT), ("time_taken", S), ("size_bytes", L), ("size_mb", D),
    ("width", L), ("height", L), ("duration_ms", D), ("codec", S),
    ("frame_rate", D),
)

OTHER = _struct(
    ("name", S), ("filetype", S), ("directory", S), ("full_path", S),
    ("size_bytes", L), ("size_mb", D),
)

BY_KIND = {"image": IMAGE, "video": VIDEO, "other": OTHER}
TABLE_BY_KIND = {"image": "images", "video": "videos", "other": "others"}

# Display names used by the reference's workbook columns (fixed values).
DISPLAY_NAMES = {"full_path": "Full path", "size_mb": "size (MB)"}


def conform(df: DataFrame, schema: T.StructType, keep: tuple = ()) -> DataFrame:
    """Select exactly ``schema``: canonical order, stray columns dropped,
    missing ones added as typed NULL, present ones cast (``try_cast``).
    ``keep`` names extra columns carried after the canonical ones."""
    present = set(df.columns)
    cols: list[Column] = []
    for f in schema.fields:
        if f.name in present:
            c = F.col(f.name)
            if df.schema[f.name].dataType != f.dataType:
                c = c.try_cast(f.dataType)
            cols.append(c.alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols, *[F.col(c) for c in keep])


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """Typed empty table (never column-less)."""
    return spark.createDataFrame([], schema)


def union_kinds(frames: dict[str, DataFrame]) -> DataFrame:
    """One wide frame over images/videos/others with a ``kind`` column."""
    out = None
    for kind, df in frames.items():
        d = df.withColumn("kind", F.lit(kind))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out

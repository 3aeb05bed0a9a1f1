"""Conform raw tag records to the image / video / other tables.

One ``select`` produces a single wide ``media`` frame with a ``kind`` column;
the per-kind tables are projections of it. Writing the catalog partitioned by
``kind`` therefore needs one scan of the tags, and readers of one kind get
partition pruning.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake import schemas
from medialake.functions import dates, numbers, paths
from medialake.functions.text import clean_text

# Extension sets deciding the media kind (``.gif`` counts as video).
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".cr2", ".cr3")
VIDEO_EXTENSIONS = (".mp4", ".mov", ".avi", ".mkv", ".m4v", ".3gp", ".gif")

MEDIA_COLUMNS = [
    "name", "filetype", "directory", "full_path", "kind", "date_taken", "time_taken",
    "camera", "lens", "focal_length", "aperture", "iso", "shutter_speed",
    "latitude", "longitude", "altitude", "size_bytes", "size_mb", "width", "height",
    "duration_ms", "codec", "frame_rate",
    # stored at ingest for pushed-down filters and path lookups
    "exposure_s", "norm_key",
]


def kind_of(filetype_col) -> Column:
    ft = F.col(filetype_col) if isinstance(filetype_col, str) else filetype_col
    return (F.when(ft.isin(*IMAGE_EXTENSIONS), F.lit("image"))
            .when(ft.isin(*VIDEO_EXTENSIONS), F.lit("video"))
            .otherwise(F.lit("other")))


def path_key(tags: DataFrame) -> Column:
    """The ``norm_key`` that raw tags get, before anything else is worked out."""
    return paths.normalize_path(clean_text(tags["SourceFile"]))


def _with_raw_columns(tags: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Missing raw tags become typed NULL columns (no schema inference)."""
    return schemas.conform(tags, schemas.RAW_TAGS, keep=tuple(carry))


def conform_media(tags: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Raw tags -> wide media rows (``MEDIA_COLUMNS``).

    Records without ``SourceFile`` are dropped. String tags are cleaned of
    control characters before any parsing. ``carry`` names columns passed
    through (e.g. the order of the records).
    """
    t = _with_raw_columns(tags, carry).where(F.col("SourceFile").isNotNull() & (F.col("SourceFile") != ""))
    # stage 1: cleaned tags plus the per-row keys every later column depends on
    names = schemas.RAW_TAGS.fieldNames()
    t = t.select(*[(clean_text(F.col(f.name)) if f.dataType.typeName() == "string" else F.col(f.name)).alias(f.name)
                   for f in schemas.RAW_TAGS.fields], *carry)
    t = t.withColumn("_ft", paths.filetype(F.col("SourceFile")))
    t = t.withColumn("_kind", kind_of(F.col("_ft")))
    s = {n: F.col(n) for n in names}
    src = s["SourceFile"]
    ft = F.col("_ft")
    kind = F.col("_kind")
    is_img, is_vid = kind == "image", kind == "video"
    media = is_img | is_vid

    dt_full = numbers.first_truthy(s["DateTimeOriginal"], s["CreateDate"], zero="")
    d_text, t_text = dates.split_datetime(dt_full)
    d_text = F.when(dt_full != "", d_text)
    t_text = F.when(dt_full != "", t_text)

    def img(c):
        return F.when(is_img, c)

    def vid(c):
        return F.when(is_vid, c)

    duration = s["Duration"]
    exposure = F.when(~F.isnan(s["ExposureTime"]), s["ExposureTime"])
    cols = [
        paths.stem(src).alias("name"),
        ft.alias("filetype"),
        numbers.first_truthy(s["Directory"], paths.dirname(src), zero="").alias("directory"),
        src.alias("full_path"),
        kind.alias("kind"),
        F.when(media, dates.parse_exif_date(d_text)).alias("date_taken"),
        F.when(media, t_text).alias("time_taken"),
        img(s["Model"]).alias("camera"),
        img(numbers.first_truthy(s["LensModel"], s["LensID"], zero="")).alias("lens"),
        img(numbers.to_float(s["FocalLength"])).alias("focal_length"),
        img(numbers.to_float(numbers.first_truthy(s["FNumber"], s["Aperture"], zero=0.0))).alias("aperture"),
        img(s["ISO"]).alias("iso"),
        img(numbers.format_shutter(exposure)).alias("shutter_speed"),
        img(F.when(~F.isnan(s["GPSLatitude"]), s["GPSLatitude"])).alias("latitude"),
        img(F.when(~F.isnan(s["GPSLongitude"]), s["GPSLongitude"])).alias("longitude"),
        img(numbers.to_float(s["GPSAltitude"])).alias("altitude"),
        s["FileSize"].alias("size_bytes"),
        numbers.size_mb(s["FileSize"]).alias("size_mb"),
        F.when(is_img, numbers.first_truthy(s["ImageWidth"], s["ExifImageWidth"]))
        .when(is_vid, s["ImageWidth"]).alias("width"),
        F.when(is_img, numbers.first_truthy(s["ImageHeight"], s["ExifImageHeight"]))
        .when(is_vid, s["ImageHeight"]).alias("height"),
        vid(F.when(~F.isnan(duration), F.when(duration != 0, numbers.duration_ms(duration)).otherwise(duration)))
        .alias("duration_ms"),
        vid(numbers.first_truthy(s["VideoCodecID"], s["CompressorID"], zero="")).alias("codec"),
        vid(F.when(~F.isnan(s["VideoFrameRate"]), s["VideoFrameRate"])).alias("frame_rate"),
        img(numbers.shown_exposure(exposure)).alias("exposure_s"),
        paths.normalize_path(src).alias("norm_key"),
    ]
    # the path key's lambda keeps this projection out of whole-stage code, whose one method for all
    # columns would be too large to be compiled; outside it, each expression is a small method
    return t.select(*cols, *carry)


def split_kinds(media: DataFrame, carry: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Per-kind canonical tables from the wide frame (filter + projection)."""
    return {k: schemas.conform(media.where(F.col("kind") == k), sch, keep=tuple(carry))
            for k, sch in schemas.BY_KIND.items()}


def conform_images(tags: DataFrame) -> DataFrame:
    return split_kinds(conform_media(tags))["image"]


def conform_videos(tags: DataFrame) -> DataFrame:
    return split_kinds(conform_media(tags))["video"]


def conform_others(tags: DataFrame) -> DataFrame:
    return split_kinds(conform_media(tags))["other"]


def other_rows(listing: DataFrame, path_col: str = "path", length_col: str = "length") -> DataFrame:
    """Rows of the ``other`` table from a file listing alone (no tags needed)."""
    p = F.col(path_col)
    return listing.select(
        paths.stem(p).alias("name"),
        paths.filetype(p).alias("filetype"),
        paths.dirname(p).alias("directory"),
        p.alias("full_path"),
        F.col(length_col).cast("bigint").alias("size_bytes"),
        numbers.size_mb(F.col(length_col)).alias("size_mb"),
    )


def with_kind(listing: DataFrame, path_col: str = "path") -> DataFrame:
    """Media kind split of a listing by lower-cased suffix."""
    return listing.withColumn("kind", kind_of(paths.filetype(F.col(path_col))))

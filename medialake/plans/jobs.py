"""End-to-end jobs: analyze (report), organize (+ catalog import), rebuild,
and the dashboard table set.

Each job is a function of a ``SparkSession`` and explicit inputs (a listing
DataFrame or folder roots, tag records or an extractor), so the same code
serves a memory card and a lake.
"""

from __future__ import annotations

import datetime as dt
import logging
from dataclasses import replace
from functools import partial
from typing import Callable, Optional, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialake import schemas
from medialake.functions import paths
from medialake.operators import conform, filters, geo, histograms, lookup, organize, stats
from medialake.session import settled
from medialake.session import stored as materialize
from medialake.sinks import export
from medialake.sources import catalog, listing, tags

log = logging.getLogger(__name__)


def media_from_listing(lst: DataFrame, extractor: Optional[tags.Extractor] = None,
                       tag_records: Optional[DataFrame] = None, batch_size: int = 2500) -> tuple[DataFrame, DataFrame]:
    """(wide media rows, extraction failures) for a listing: tags from
    ``tag_records`` or from the ``extractor`` (images and videos only, each file
    once); ``other`` rows from the listing."""
    spark = lst.sparkSession
    failures = spark.createDataFrame([], "path string, error string")
    if tag_records is None:
        if extractor is None:
            raise ValueError("need tag records or an extractor")
        tag_records, failures = tags.extract_tags(lst, extractor, batch_size)
    media = conform.conform_media(tag_records).where(F.col("kind") != "other")
    oth = listing.kind_split(lst).where(F.col("kind") == "other")
    others = conform.other_rows(oth).withColumn("kind", F.lit("other"))
    return media.unionByName(others, allowMissingColumns=True), failures


def _listed(lst: DataFrame, spec: filters.FilterSpec) -> DataFrame:
    """The listing without files that kind and extension already exclude, so
    that their tags are never read."""
    part = spec.listing_only()
    if part.is_empty():
        return lst
    kinds = listing.kind_split(lst).withColumn("filetype", paths.filetype(F.col("path")))
    return part.apply(kinds).select(*lst.columns)


def run_analyze(spark: SparkSession, lst: DataFrame, out_root: str, spec: Optional[filters.FilterSpec] = None,
                extractor=None, tag_records: Optional[DataFrame] = None, fmt: str = "parquet",
                stamp: Optional[str] = None) -> str:
    """Report job (K5): ``<out_root>/Analysis <stamp>/metadata/{images,videos,others}``
    plus one table per chart under ``charts/`` and ``extraction_failures``. The
    metadata comes first; each chart is built and written on its own, and one
    that fails is logged."""
    stamp = stamp or dt.datetime.now().strftime("%Y-%m-%d_%H-%M-%S")
    out = f"{out_root.rstrip('/')}/Analysis {stamp}"
    spec = spec or filters.FilterSpec()
    media, failures = media_from_listing(_listed(lst, spec), extractor, tag_records)
    if tag_records is not None:  # given records may hold more than the listing
        media = media.join(lst.select(F.col("path").alias("full_path")).distinct(), "full_path", "left_semi")
    media = materialize(spec.apply(media))  # exported and charted: compute once
    frames = conform.split_kinds(media)
    export.export_tables(frames, f"{out}/metadata", fmt=fmt)
    failures.write.parquet(f"{out}/extraction_failures")
    for name, build in chart_tables(frames).items():
        try:
            build().write.mode("overwrite").parquet(f"{out}/charts/{name}")
        except Exception as exc:  # noqa: BLE001 - one chart must not cost the others
            log.error("chart table %s failed: %s", name, exc)
    return out


def chart_tables(frames: dict[str, DataFrame]) -> dict[str, Callable[[], DataFrame]]:
    """The report's chart set (counts, cameras, lenses, settings, yearly and
    monthly timelines by camera and lens, videos, locations), each as a
    function that builds its table."""
    i, v, o = frames["image"], frames["video"], frames["other"]
    media = schemas.union_kinds({"image": i.select("name"), "video": v.select("name"), "other": o.select("name")})
    out = {
        "general_file_types": lambda: stats.counts_by_kind(media),
        "images_cameras": lambda: stats.top_with_share(i, "camera", 15),
        "images_lenses": lambda: stats.top_n(i, "lens", 15),
        "videos_duration": lambda: histograms.duration_histogram(v, 50),
        "videos_timeline": lambda: stats.video_timeline(v),
        "locations": lambda: geo.geo_points(i, extra=()),
        "locations_heatmap": lambda: geo.hexbin(geo.geo_points(i, extra=())),
    }
    for s in ("aperture", "shutter_speed", "iso", "focal_length"):
        out[f"images_settings_{s}"] = partial(histograms.setting_histogram, i, s)
        out[f"images_settings_{s}_ticks"] = partial(histograms.hist_ticks, i, s, "plot")
    for g in ("camera", "lens"):
        for t in ("year", "month"):
            out[f"images_{'yearly' if t == 'year' else 'monthly'}_{g}"] = partial(stats.timeline, i, g, t, 15)
    return out


def _copied(manifest: DataFrame) -> DataFrame:
    """The manifest after copying: rows whose copy failed have status
    ``error``. The statuses come back by the stored row number, so a file that
    is listed twice keeps two rows."""
    manifest = materialize(manifest.withColumn("row_no", F.monotonically_increasing_id()))
    status = materialize(organize.apply_plan(manifest, source_col="path", keep=["row_no"], size_col="length"))
    failed = status.where(F.col("status") == "error").select("row_no", F.lit(True).alias("_err"))
    return materialize(manifest.join(failed, "row_no", "left").withColumn(
        "status", F.when(F.col("_err"), F.lit("error")).otherwise(F.col("status"))).drop("_err", "row_no"))


def _joined(spark: SparkSession, lst: DataFrame, spec: filters.FilterSpec, extractor, tag_records) -> DataFrame:
    """Listed files with their metadata. A filter needs metadata, so files
    without any are dropped by it; plain organizing keeps them as ``other``."""
    listed = _listed(lst, spec)
    media, _ = media_from_listing(listed, extractor, tag_records)
    how = "left" if spec.is_empty() else "inner"
    joined = lookup.listing_lookup(listed, media, how=how)
    if how == "inner":
        joined = joined.withColumn("has_meta", F.lit(True))
        joined = replace(spec, undated="mtime").apply(joined, "modification_date")
    return joined.withColumn("size_bytes", F.coalesce("size_bytes", "length"))


def run_organize(spark: SparkSession, lst: DataFrame, output_root: str, options: organize.LayoutOptions,
                 spec: Optional[filters.FilterSpec] = None, extractor=None,
                 tag_records: Optional[DataFrame] = None, existing: Optional[DataFrame] = None,
                 catalog_root: Optional[str] = None, copy: bool = True) -> dict:
    """Organize job: lookup -> filter -> plan -> (copy) -> record -> catalog.

    The manifest is stored once; copying is a separate action whose per-file
    status is stored before the records are appended to the catalog (add +
    refresh, never prune). ``excluded`` lists the files that were not placed."""
    if existing is None:
        existing = listing.scan_listing(spark, [output_root]).select("path")
    joined = partial(_joined, spark, lst, spec or filters.FilterSpec(), extractor, tag_records)
    manifest = settled(lambda: organize.plan_organize(joined, output_root, options, existing=existing, path_col="path",
                                                      has_meta_col="has_meta", order=("path", "length")))
    if copy:
        manifest = _copied(manifest)
    recs = organize.organized_rows(manifest, has_meta_col="has_meta", carry=("path", "length"))
    if catalog_root:
        # the manifest is stored: its rows are told apart by their places, not stored once more
        placed = organize.organized_rows(lookup.with_place(manifest), has_meta_col="has_meta", carry=("path", "length", *lookup.PLACE))
        catalog.append_catalog(placed, catalog_root, order=("path", "length"))
    return {"manifest": manifest, "report": organize.organize_report(manifest), "records": recs,
            "excluded": organize.excluded_files(manifest, "path")}


def run_organize_multi(spark: SparkSession, lst: DataFrame, targets: Sequence[organize.Target], extractor=None,
                       tag_records: Optional[DataFrame] = None, copy: bool = True) -> dict:
    """Every file against every target (J4), against what already lies in each
    target, into each target's own catalog."""
    media, _ = media_from_listing(lst, extractor, tag_records)
    joined = lookup.listing_lookup(lst, media, how="inner").withColumn("has_meta", F.lit(True))
    existing = listing.scan_listing(spark, [t.root for t in targets]).select("path")
    manifest = materialize(organize.organize_multi(
        joined.withColumn("size_bytes", F.coalesce("size_bytes", "length")), targets, path_col="path",
        has_meta_col="has_meta", order=("path", "length"), existing=existing))
    if copy:
        manifest = _copied(manifest)
    for root in dict.fromkeys(t.catalog for t in targets if t.catalog):
        recs = organize.organized_rows(manifest.where(F.col("catalog") == root), has_meta_col="has_meta",
                                       carry=("path", "length"))
        catalog.append_catalog(recs, root, order=("path", "length"))
    return {"manifest": manifest, "report": organize.organize_report(manifest),
            "excluded": organize.excluded_files(manifest, "path")}


def run_rebuild(spark: SparkSession, roots: Sequence[str], catalog_root: str, extractor=None,
                tag_records: Optional[DataFrame] = None) -> str:
    """Full catalog rebuild (M5): scan + conform + a new folder in the place of
    all others, no merge; what an earlier rebuild replaced is deleted. Returns
    the folder's name."""
    began = catalog.begin(spark, catalog_root)
    lst, unread = listing.scan_tree(spark, roots)
    if not unread.isEmpty():
        log.warning("%d folders or files could not be read", unread.count())
    media, _ = media_from_listing(lst, extractor, tag_records)
    name = catalog.write_catalog(conform.split_kinds(materialize(media)), catalog_root, began)
    catalog.prune_catalog(spark, catalog_root)
    return name


def dashboard_tables(images: DataFrame, videos: DataFrame, others: DataFrame, month_range=None,
                     cameras=None, lenses=None) -> dict[str, DataFrame]:
    """Dashboard tables sharing one filtered image frame (masks on images
    only; videos and others unfiltered)."""
    fi = filters.dashboard_mask(images, month_range, cameras, lenses)
    media = schemas.union_kinds({"image": fi.select("name"), "video": videos.select("name"),
                                 "other": others.select("name")})
    out = {
        "totals": stats.summary_totals(fi, videos, others),
        "file_types": stats.counts_by_kind(media),
        "cameras": stats.top_n(fi, "camera", 10),
        "lenses": stats.top_n(fi, "lens", 10),
        "timeline": stats.timeline_dashboard(fi, "camera", "month", 10),
        "video_minutes": stats.video_minutes(videos),
        "map": geo.geo_points(fi),
        "months": stats.month_domain(images),
        "options": stats.option_lists(images),
    }
    for s in ("aperture", "shutter_speed", "iso", "focal_length"):
        out[f"settings_{s}"] = histograms.setting_histogram(fi, s, 30, 0.01, 0.99)
        out[f"settings_{s}_ticks"] = histograms.hist_ticks(fi, s, "dashboard")
    return out


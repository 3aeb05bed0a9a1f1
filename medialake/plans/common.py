"""Shared inputs of the registered queries (all derived from the driver's tables).

The conformed media catalog of a data set is built once per Spark
application: raw tags -> conform -> a Parquet table partitioned by ``kind``
in the shared checkpoint folder, the way an ingest job writes the catalog
that reports and dashboards then read. Queries read that table, so column
pruning, predicate pushdown and ``kind`` partition pruning apply, and the
conform expressions run once instead of once per query. Its rows are written
where they are conformed, neither shuffled nor sorted. The first lookup by path
writes them bucketed by the normalized path key, from the catalog if it is there
already, so that lookups move only the other side.
"""

from __future__ import annotations

import os
import threading

from pyspark.sql import DataFrame, SparkSession

from medialake.operators import conform
from medialake.session import scratch_path, write_partitioned
from medialake.sources import buckets, fixture

_LOCK = threading.RLock()
_CATALOGS: dict[tuple, str] = {}  # paths
_BY_KEY: dict[tuple, str] = {}  # tables


def _once(made: dict[tuple, str], spark: SparkSession, sf_dir: str, make) -> str:
    """What ``make`` gives for a folder of the catalog; made once per application and data set."""
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir))
    with _LOCK:
        if key not in made:
            made[key] = make(scratch_path(spark, "media-" + os.path.basename(os.path.abspath(sf_dir))))
        return made[key]


def build_catalog(spark: SparkSession, sf_dir: str) -> str:
    """Conform the fixture's raw tags and write the catalog table; returns its path."""
    def write(path):
        write_partitioned(conform.conform_media(fixture.raw_tags(spark, sf_dir)), path, "kind")
        return path

    return _once(_CATALOGS, spark, sf_dir, write)


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide conformed media rows of the fixture (from the stored catalog)."""
    path = build_catalog(spark, sf_dir)
    return spark.read.parquet(path).select(*conform.MEDIA_COLUMNS)


def media_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows, from the buckets of their path key: for joins on it."""
    def write(path):
        if (spark.sparkContext.applicationId, os.path.abspath(sf_dir)) in _CATALOGS:
            return buckets.write_bucketed(media(spark, sf_dir), path, "norm_key", ["kind"])
        tags = fixture.raw_tags(spark, sf_dir)  # narrower than media rows: dealt before they are conformed
        rows = conform.conform_media(tags.repartition(buckets.default_buckets(spark), conform.path_key(tags)))
        return buckets.write_bucketed(rows.select(*conform.MEDIA_COLUMNS), path, "norm_key", ["kind"], dealt=True)

    name = _once(_BY_KEY, spark, sf_dir, write)
    return spark.table(name).select(*conform.MEDIA_COLUMNS)


def kinds(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return conform.split_kinds(media(spark, sf_dir))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kinds(spark, sf_dir)["image"]


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kinds(spark, sf_dir)["video"]


def others(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kinds(spark, sf_dir)["other"]

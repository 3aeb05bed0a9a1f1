"""Queries for the path-keyed joins and keep-last (J1, J2, M4, W1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from medialake.operators import lookup
from medialake.plans import common
from medialake.plans.registry import query
from medialake.sources import fixture
from oracle_sql import with_media

# listing of the fixture plus an ``.xmp`` sidecar (no metadata) for every 10th-byte file
SIDECAR_LISTING_SQL = """listing AS (
  SELECT source_file AS path, file_size AS length FROM media_raw
  UNION ALL SELECT source_file || '.xmp', 0 FROM media_raw WHERE file_size % 10 = 0
)"""


def _listing_with_sidecars(spark, sf_dir):
    lst = fixture.media_listing(spark, sf_dir).select("path", "length")
    side = lst.where(F.col("length") % 10 == 0).select(F.concat("path", F.lit(".xmp")).alias("path"),
                                                       F.lit(0).cast("bigint").alias("length"))
    return lst.unionByName(side)


@query("listing_lookup_inner", with_media("""
SELECT l.path, m.kind, m.camera, m.size_bytes FROM listing l JOIN media m ON m.full_path = l.path
""", SIDECAR_LISTING_SQL))
def listing_lookup_inner(spark, sf_dir):
    j = lookup.listing_lookup(_listing_with_sidecars(spark, sf_dir), common.media_by_key(spark, sf_dir), "inner",
                              columns=["camera"], unique=True)
    return j.select("path", "kind", "camera", "size_bytes")


@query("listing_lookup_left", with_media("""
SELECT l.path, coalesce(m.kind, 'other') AS kind, m.kind IS NOT NULL AS has_meta, m.camera, m.size_bytes
FROM listing l LEFT JOIN media m ON m.full_path = l.path
""", SIDECAR_LISTING_SQL))
def listing_lookup_left(spark, sf_dir):
    j = lookup.listing_lookup(_listing_with_sidecars(spark, sf_dir), common.media_by_key(spark, sf_dir), "left",
                              columns=["camera"], unique=True)
    return j.select("path", "kind", "has_meta", "camera", "size_bytes")


# second tree: a backup of most files plus extra files only there
BACKUP_SQL = """a AS (SELECT source_file AS path FROM media_raw),
b AS (SELECT replace(source_file, '/media/', '/backup/') AS path FROM media_raw WHERE file_size % 10 <> 0
      UNION ALL SELECT replace(source_file, '/media/', '/backup/extra/') FROM media_raw WHERE file_size % 17 = 0),
ra AS (SELECT substr(path, 8) AS rel, max(path) AS pa FROM a WHERE starts_with(path, '/media/') GROUP BY 1),
rb AS (SELECT substr(path, 9) AS rel, max(path) AS pb FROM b WHERE starts_with(path, '/backup/') GROUP BY 1)"""


@query("compare_listings", with_media("""
SELECT CASE WHEN pa IS NOT NULL AND pb IS NOT NULL THEN 'common' WHEN pa IS NOT NULL THEN 'only_a' ELSE 'only_b' END
       AS side, coalesce(ra.rel, rb.rel) AS rel, coalesce(pa, pb) AS path
FROM ra FULL OUTER JOIN rb ON ra.rel = rb.rel
""", BACKUP_SQL))
def compare_listings(spark, sf_dir):
    m = fixture.media_raw(spark, sf_dir)
    a = m.select(F.col("source_file").alias("path"))
    b = (m.where(F.col("file_size") % 10 != 0)
         .select(F.replace("source_file", F.lit("/media/"), F.lit("/backup/")).alias("path"))
         .unionByName(m.where(F.col("file_size") % 17 == 0).select(
             F.replace("source_file", F.lit("/media/"), F.lit("/backup/extra/")).alias("path"))))
    return lookup.compare_listings(a, "/media", b, "/backup")


@query("keep_last", with_media("""
SELECT full_path, camera, size_bytes FROM (
  SELECT *, row_number() OVER (PARTITION BY full_path ORDER BY src DESC) AS rn FROM (
    SELECT full_path, camera, size_bytes, 0 AS src FROM images
    UNION ALL SELECT full_path, camera || ' v2', size_bytes, 1 FROM images WHERE size_bytes % 3 = 2))
WHERE rn = 1
"""))
def keep_last(spark, sf_dir):
    i = common.images(spark, sf_dir).select("full_path", "camera", "size_bytes")
    later = i.where(F.col("size_bytes") % 3 == 2).withColumn("camera", F.concat("camera", F.lit(" v2")))
    u = i.withColumn("_src", F.lit(0)).unionByName(later.withColumn("_src", F.lit(1)))
    return lookup.keep_last(u, ["full_path"], ["_src"]).select("full_path", "camera", "size_bytes")

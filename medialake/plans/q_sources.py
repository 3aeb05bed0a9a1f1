"""Queries for sources and sinks (S1-S7, K1-K3, T1)."""

from __future__ import annotations

import os
import uuid
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialake import schemas
from medialake.operators import conform, copying, organize
from medialake.plans import common, jobs
from medialake.plans.registry import query
from medialake.session import cleared, scratch_path
from medialake.sinks import export
from medialake.sources import catalog, files, fixture, listing, tags
from medialake.streaming import ingest
from oracle_sql import IMAGE_EXT, VIDEO_EXT, with_media, with_raw

LISTING_SQL = """SELECT source_file AS path, file_size AS length,
       DATE '2024-01-01' + CAST(file_size % 700 AS INT) AS modification_date FROM media_raw"""
EXT_SQL = "lower(regexp_extract(regexp_extract(path, '[^/]*$', 0), '^\\.*[^.].*(\\.[^.]*)$', 1))"
KIND_SQL = f"CASE WHEN {EXT_SQL} IN {IMAGE_EXT} THEN 'image' WHEN {EXT_SQL} IN {VIDEO_EXT} THEN 'video' ELSE 'other' END"


def written_tree(spark, sf_dir) -> str:
    """A folder tree with one small file per fixture path (``file_size % 64``
    bytes, the most of a repeated path; zeros, which take no block of the disk),
    written by executors; returns its root."""
    root = scratch_path(spark, "tree")

    def write(batches):
        for pdf in batches:
            for path, size in zip(pdf["path"], pdf["size"]):
                files.write_blank(root + path, int(size))
            yield pdf[["path"]]

    rows = fixture.media_listing(spark, sf_dir).groupBy("path").agg(F.max(F.col("length") % 64).alias("size"))
    with cleared(spark):
        rows.repartition(spark.sparkContext.defaultParallelism).mapInPandas(write, "path string").write.format("noop").mode(
            "overwrite").save()
    return root


@query("scan_listing", with_raw("""
SELECT path, kind, max(length) AS length FROM (
  SELECT path, length % 64 AS length, """ + KIND_SQL + """ AS kind FROM (""" + LISTING_SQL + """))
GROUP BY path, kind
"""))
def scan_listing(spark, sf_dir):
    """Scan of a folder tree that holds a file for every fixture row."""
    root = written_tree(spark, sf_dir)
    plain = root.removeprefix("file:") if root.startswith("file:") else root
    plain = "/" + plain.lstrip("/") if root.startswith(("file:", "/")) else plain
    found = listing.kind_split(listing.scan_listing(spark, [root]))
    return found.select(F.substr(F.col("path"), F.lit(len(plain) + 1)).alias("path"), "kind", "length")


@query("copy_listed", with_raw("""
SELECT path, CASE WHEN row_number() OVER (PARTITION BY regexp_extract(path, '[^/]*$', 0) ORDER BY path) = 1
                  THEN 'copied' ELSE 'skipped' END AS status
FROM (SELECT DISTINCT path FROM (""" + LISTING_SQL + """))
"""))
def copy_listed(spark, sf_dir):
    """Every file of a folder tree copied into one folder, the first of a name."""
    root = written_tree(spark, sf_dir)
    plain = "/" + root.removeprefix("file:").lstrip("/")
    done = organize.copy_listed(listing.scan_listing(spark, [root]), scratch_path(spark, "flat"))
    return done.select(F.substr(F.col("path"), F.lit(len(plain) + 1)).alias("path"), "status")


COPY_PART, COPY_TASK = 1 << 22, 1 << 26


@query("copy_tasks", with_raw(f"""
SELECT task, count(*) AS n_parts, sum(bytes)::BIGINT AS bytes FROM (
  SELECT bytes, floor((sum(bytes + 65536) OVER (ORDER BY path, length, part ROWS UNBOUNDED PRECEDING) - bytes - 65536) / {COPY_TASK})::INT AS task
  FROM (SELECT path, length, part, least({COPY_PART}, length - part * {COPY_PART}) AS bytes
        FROM (SELECT path, length, unnest(range(0, greatest((length - 1) // {COPY_PART}, 0) + 1)) AS part FROM ({LISTING_SQL}))))
GROUP BY task
"""))
def copy_tasks(spark, sf_dir):
    """Parts and bytes of each task of a copy that is planned, not made."""
    todo = fixture.media_listing(spark, sf_dir).select("path", "length", F.col("path").alias("src"), F.concat(F.lit("/out"), "path").alias("dst"))
    parts = copying.copy_parts(todo, ["path", "length"], COPY_PART, COPY_TASK)
    return parts.groupBy("task").agg(F.count(F.lit(1)).alias("n_parts"), F.sum("bytes").alias("bytes"))


@query("kind_split", with_raw(f"SELECT path, {KIND_SQL} AS kind FROM ({LISTING_SQL})"))
def kind_split(spark, sf_dir):
    return listing.kind_split(fixture.media_listing(spark, sf_dir)).select("path", "kind")


@query("other_rows", with_raw(f"""
SELECT CASE WHEN e = '' THEN b ELSE substr(b, 1, length(b) - length(e)) END AS name, lower(e) AS filetype,
       regexp_replace(regexp_extract(path, '^(.*/)', 1), '/+$', '') AS directory, path AS full_path,
       length AS size_bytes, round_even(length / 1048576.0, 2) AS size_mb
FROM (SELECT path, length, b, regexp_extract(b, '^\\.*[^.].*(\\.[^.]*)$', 1) AS e
      FROM (SELECT path, length, regexp_extract(path, '[^/]*$', 0) AS b FROM ({LISTING_SQL})
            WHERE {KIND_SQL} = 'other'))
"""))
def other_rows(spark, sf_dir):
    lst = listing.kind_split(fixture.media_listing(spark, sf_dir)).where(F.col("kind") == "other")
    return conform.other_rows(lst)


def _path_reader(paths_: list, profile: str, wanted: list) -> list:
    """A tag reader that knows what the path says, and how many tags it was
    asked for; it cannot read one kind of file."""
    if any(p.endswith(".cr2") for p in paths_):
        raise ValueError("unreadable")
    return [{"SourceFile": p, "Directory": p.rsplit("/", 1)[0], "Model": profile, "ISO": len(wanted)} for p in paths_]


@query("extract_tags", with_raw(f"""
SELECT path AS SourceFile, CASE WHEN path LIKE '%.cr2' THEN NULL ELSE regexp_extract(path, '^(.*)/', 1) END AS Directory,
       CASE WHEN path NOT LIKE '%.cr2' THEN {KIND_SQL} END AS Model,
       CASE WHEN path LIKE '%.cr2' THEN NULL WHEN {KIND_SQL} = 'image' THEN 17 ELSE 11 END AS ISO,
       CASE WHEN path LIKE '%.cr2' THEN 'ValueError: unreadable' END AS error
FROM ({LISTING_SQL}) WHERE {KIND_SQL} <> 'other'
"""))
def extract_tags(spark, sf_dir):
    """Records of readable files, and the files of failed batches."""
    records, failures = tags.extract_tags(fixture.media_listing(spark, sf_dir), _path_reader, batch_size=1)
    got = records.select("SourceFile", "Directory", "Model", "ISO", F.lit(None).cast("string").alias("error"))
    lost = failures.select(F.col("path").alias("SourceFile"), *[F.lit(None).cast(t).alias(c) for c, t in (
        ("Directory", "string"), ("Model", "string"), ("ISO", "bigint"))], "error")
    return got.unionByName(lost)


@query("read_tags", with_raw("SELECT " + ", ".join(f'{c} AS "{t}"' for c, t in fixture.RAW_TAG_NAMES.items()) + """
FROM media_raw WHERE source_file IS NOT NULL AND source_file <> ''
"""))
def read_tags(spark, sf_dir):
    """Tag records written as compressed JSON files and read back, all fixture tags."""
    path = scratch_path(spark, "tags-json")
    with cleared(spark):
        fixture.raw_tags(spark, sf_dir).write.json(path, compression="gzip")
    return tags.read_tags(spark, path, multi_line=False).select(*fixture.RAW_TAG_NAMES.values())


def written_arrays(spark, sf_dir) -> str:
    """The fixture's tag records as JSON arrays, a file per task that makes them,
    objects over several lines; returns their folder."""
    root = scratch_path(spark, "tag-arrays")

    def write(batches):
        def pieces():
            between = "["
            for pdf in batches:
                for text in pdf["json"]:
                    yield f"{between}{text}".encode()
                    between = ",\n  "
            yield b"[]" if between == "[" else b"]\n"

        files.write_pieces(f"{root}/tags-{uuid.uuid4().hex}.json", pieces())
        yield pd.DataFrame({"json": []}, dtype=str)

    rows = fixture.raw_tags(spark, sf_dir).select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("json"))
    with cleared(spark):  # the texts are written where they are made, not shuffled
        rows.mapInPandas(write, "json string").write.format("noop").mode("overwrite").save()
    return root


@query("read_tag_arrays", with_raw("SELECT " + ", ".join(f'{c} AS "{t}"' for c, t in fixture.RAW_TAG_NAMES.items()) + """
FROM media_raw WHERE source_file IS NOT NULL AND source_file <> ''
"""))
def read_tag_arrays(spark, sf_dir):
    """Tag records written as JSON arrays and read back by byte ranges."""
    return tags.read_tags(spark, written_arrays(spark, sf_dir), range_bytes=1 << 18).select(*fixture.RAW_TAG_NAMES.values())


@query("link_column", with_media("SELECT full_path, 'file:///' || full_path AS link FROM media"))
def link_column(spark, sf_dir):
    return export.with_link(common.media(spark, sf_dir)).select("full_path", "link")


def _widths_sql():
    cols = [f.name for f in schemas.IMAGE.fields if f.dataType.typeName() in ("string", "long", "date")]
    parts = [f"SELECT '{c}' AS \"column\", CAST(greatest(coalesce(max(length(CAST({c} AS VARCHAR))), 0), "
             f"{len(c)}) + 2 AS BIGINT) AS width FROM images" for c in cols]
    return "\nUNION ALL\n".join(parts), cols


@query("column_widths", with_media(_widths_sql()[0]))
def column_widths(spark, sf_dir):
    i = common.images(spark, sf_dir).select(*_widths_sql()[1])
    return export.column_widths(i)


@query("export_counts", with_media("""
SELECT CASE kind WHEN 'image' THEN 'images' WHEN 'video' THEN 'videos' ELSE 'others' END AS "table",
       count(*) AS n_rows FROM media GROUP BY kind
"""))
def export_counts(spark, sf_dir):
    out = scratch_path(spark, "export")
    export.export_tables(common.kinds(spark, sf_dir), out)
    back = {k: spark.read.parquet(os.path.join(out, t)) for k, t in schemas.TABLE_BY_KIND.items()}
    return export.counts(back)


@query("job_analyze", with_media("""
SELECT CASE kind WHEN 'image' THEN 'images' WHEN 'video' THEN 'videos' ELSE 'others' END AS "table", count(*) AS n_rows FROM media GROUP BY kind
UNION ALL SELECT 'extraction_failures', 0
UNION ALL SELECT 'chart_file_types', count(DISTINCT kind) FROM media
UNION ALL SELECT 'chart_cameras', least(count(DISTINCT camera), 15) FROM media WHERE kind = 'image' AND camera <> ''
"""))
def job_analyze(spark, sf_dir):
    """The analysis job over the fixture: its tables and charts as written."""
    out = jobs.run_analyze(spark, fixture.media_listing(spark, sf_dir), scratch_path(spark, "analysis"),
                           tag_records=fixture.raw_tags(spark, sf_dir), stamp="now")
    back = {t: f"metadata/{t}" for t in schemas.TABLE_BY_KIND.values()} | {
        "extraction_failures": "extraction_failures", "chart_file_types": "charts/general_file_types", "chart_cameras": "charts/images_cameras"}
    frames = [spark.read.parquet(f"{out}/{path}").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table"), "n_rows")
              for name, path in back.items()]
    return reduce(DataFrame.unionByName, frames)


@query("catalog_roundtrip", with_media("SELECT kind, full_path, date_taken, size_mb FROM media"))
def catalog_roundtrip(spark, sf_dir):
    root = scratch_path(spark, "catalog")
    catalog.write_catalog(common.kinds(spark, sf_dir), root)
    back = catalog.read_catalog(spark, root)
    return schemas.union_kinds({k: v.select("full_path", "size_mb", *(["date_taken"] if k != "other" else []))
                                for k, v in back.items()}).select("kind", "full_path", "date_taken", "size_mb")


@query("stream_ingest", with_media("SELECT kind, full_path, size_mb FROM media"))
def stream_ingest(spark, sf_dir):
    """Tag dumps written as compressed JSON files, ingested by the streaming job (two
    halves, the second replayed), then read back from the catalog."""
    base = scratch_path(spark, "stream")
    raw = fixture.raw_tags(spark, sf_dir)
    h = F.xxhash64("SourceFile") % 2
    with cleared(spark):
        raw.where(h == 0).write.mode("append").json(f"{base}/tags", compression="gzip")
    ingest.ingest_available(spark, f"{base}/tags", f"{base}/catalog", f"{base}/ckpt", multi_line=False)
    with cleared(spark):
        raw.where(h != 0).write.mode("append").json(f"{base}/tags", compression="gzip")
    frames = ingest.ingest_available(spark, f"{base}/tags", f"{base}/catalog", f"{base}/ckpt", multi_line=False)
    return ingest.with_kind_column(frames)

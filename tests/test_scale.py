"""Shape of the shared inputs: what is shuffled, sorted and dealt to tasks."""

from __future__ import annotations

import glob
import re

from pyspark.sql import functions as F

from conftest import SF001
from medialake.operators import conform
from medialake.plans import common
from medialake.session import scratch_path, write_partitioned
from medialake.sources import fixture


def test_shared_catalog_is_written_without_buckets(spark):
    # a bucketed writer puts the bucket's number into the names of its files
    assert not [f for f in common.media(spark, SF001).inputFiles() if re.search(r"_\d{5}\.c\d{3}", f)]
    by_path, by_key = common.media(spark, SF001), common.media_by_key(spark, SF001)
    assert by_path.count() == by_key.count() > 0 and by_path.exceptAll(by_key).isEmpty()
    want = conform.conform_media(fixture.raw_tags(spark, SF001)).select(*by_path.columns)
    assert want.exceptAll(by_path).isEmpty() and want.count() == by_path.count()


def test_records_are_made_in_many_tasks(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = fixture.raw_tags(spark, SF001).where(F.col("SourceFile").startswith("/media/card"))
    tasks = rows.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(tasks) >= n and max(r["count"] for r in tasks) < 3 * sum(r["count"] for r in tasks) / n


def test_write_partitioned(spark):
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name, None)
    rows = spark.range(1000).select("id", F.concat(F.lit("k"), F.col("id") % 20).alias("kind"), F.lit(None).cast("string").alias("x"))
    for writers in (2, 8, 30):  # more values than writers too
        path = scratch_path(spark, "partitioned")
        write_partitioned(rows.coalesce(1), path, "kind", writers)
        assert spark.conf.get(name, None) == before
        assert spark.read.parquet(path).select("id", "kind", "x").exceptAll(rows).isEmpty() and spark.read.parquet(path).count() == 1000
        assert len(glob.glob(f"{path}/kind=*")) == 20

"""Filter predicates (F1-F15), option building and the generic selector."""

import datetime as dt

from pyspark.sql import functions as F

from medialake import schemas
from medialake.operators import filters


def media(spark):
    rows = [
        ("/a/1.jpg", ".jpg", "image", dt.date(2024, 5, 1), "Cam A", "L1", 2.8, 100, "1/200s"),
        ("/a/2.JPG", ".jpg", "image", None, "Cam B", "", None, None, None),
        ("/a/3.cr3", ".cr3", "image", dt.date(2023, 1, 1), "", "L2", 8.0, 3200, "2s"),
        ("/a/4.mp4", ".mp4", "video", dt.date(2024, 6, 1), None, None, None, None, None),
        ("/a/5.txt", ".txt", "other", None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "full_path string, filetype string, kind string, date_taken date, "
                                     "camera string, lens string, aperture double, iso bigint, shutter_speed string")
    return df.withColumn("modification_date", F.lit(dt.date(2024, 5, 20)))


def paths_of(df):
    return sorted(r["full_path"] for r in df.select("full_path").collect())


def test_option_building():
    assert filters.normalize_extensions(["jpg", " .CR3 ", "", "  "]) == [".jpg", ".CR3"]
    assert filters.normalize_extensions([]) is None
    assert filters.FilterSpec().is_empty()
    assert not filters.FilterSpec(iso_range=(None, None)).is_empty()


def test_kind_ext_photo_only(spark):
    m = media(spark)
    assert paths_of(filters.FilterSpec(filetypes=("video", "other")).apply(m)) == ["/a/4.mp4", "/a/5.txt"]
    assert paths_of(filters.FilterSpec(extensions=(".JPG",)).apply(m)) == ["/a/1.jpg", "/a/2.JPG"]
    spec = filters.FilterSpec(filetypes=("image", "video"), cameras=("Cam A",))
    assert paths_of(spec.apply(m)) == ["/a/1.jpg"]


def test_date_undated_rules(spark):
    m = media(spark)
    rng = (dt.date(2024, 1, 1), dt.date(2024, 12, 31))
    assert paths_of(filters.FilterSpec(date_range=rng).apply(m)) == ["/a/1.jpg", "/a/4.mp4"]
    got = paths_of(filters.FilterSpec(date_range=rng, undated="mtime").apply(m))
    assert got == ["/a/1.jpg", "/a/2.JPG", "/a/4.mp4", "/a/5.txt"]
    assert paths_of(filters.FilterSpec(date_range=(None, dt.date(2023, 6, 1))).apply(m)) == ["/a/3.cr3"]


def test_camera_lens_reject_empty(spark):
    m = media(spark)
    assert paths_of(filters.FilterSpec(cameras=("", "Cam B")).apply(m)) == ["/a/2.JPG"]
    assert paths_of(filters.FilterSpec(lenses=("", "L2")).apply(m)) == ["/a/3.cr3"]


def test_ranges_reject_missing(spark):
    m = media(spark)
    assert paths_of(filters.FilterSpec(aperture_range=(None, 4.0)).apply(m)) == ["/a/1.jpg"]
    assert paths_of(filters.FilterSpec(iso_range=(None, None)).apply(m)) == ["/a/1.jpg", "/a/3.cr3"]
    assert paths_of(filters.FilterSpec(iso_range=(100, 400)).apply(m)) == ["/a/1.jpg"]


def test_shutter_range_in_seconds(spark):
    m = media(spark)
    assert paths_of(filters.FilterSpec(shutter_speed_range=("1/500", "1/100")).apply(m)) == ["/a/1.jpg"]
    # "min 1/100, max 1/500" is an empty interval in seconds
    assert paths_of(filters.FilterSpec(shutter_speed_range=("1/100", "1/500")).apply(m)) == []
    assert paths_of(filters.FilterSpec(shutter_speed_range=("1", None)).apply(m)) == ["/a/3.cr3"]


def test_empty_filter_is_identity(spark):
    m = media(spark)
    assert filters.FilterSpec().apply(m).count() == 5


def test_select_where(spark):
    names = schemas.RAW_TAGS.fieldNames()

    def rec(**kw):
        return tuple(kw.get(n) for n in names)

    tags = spark.createDataFrame([rec(SourceFile="/a.jpg", Model="X", ISO=800), rec(SourceFile="/b.jpeg", Model="X"),
                                  rec(SourceFile="/c.JPG", Model=None, ISO=100)], schemas.RAW_TAGS)
    got = [r["SourceFile"] for r in filters.select_where(tags, Model=["X", None]).collect()]
    assert sorted(got) == ["/a.jpg", "/c.JPG"]
    got = [r["SourceFile"] for r in filters.select_where(tags, ISO=lambda c: c > 200).collect()]
    assert got == ["/a.jpg"]
    got = [r["SourceFile"] for r in filters.select_where(tags, Model=None).collect()]
    assert got == ["/c.JPG"]


def test_dashboard_mask(spark):
    rows = [("/1", dt.date(2024, 1, 5), "A", "L"), ("/2", dt.date(2024, 3, 5), "B", "L"), ("/3", None, "A", "L")]
    i = spark.createDataFrame(rows, "full_path string, date_taken date, camera string, lens string")
    assert paths_of(filters.dashboard_mask(i)) == ["/1", "/2"]  # undated vanish when span > 1 month
    assert paths_of(filters.dashboard_mask(i, (dt.date(2024, 3, 1), dt.date(2024, 3, 1)))) == ["/2"]
    one_month = i.where(F.col("full_path") != "/2")
    assert paths_of(filters.dashboard_mask(one_month, cameras=("A",))) == ["/1", "/3"]

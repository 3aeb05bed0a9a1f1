"""Scalar rules and conform goldens (the reference's asserted values)."""

import datetime as dt

from pyspark.sql import functions as F

from medialake import schemas
from medialake.functions import dates, numbers, paths, text
from medialake.operators import conform


def one(spark, col_expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(col_expr.alias("r")).first()["r"]


def tags_df(spark, records):
    return spark.createDataFrame(records, schemas.RAW_TAGS)


def rec(**kw):
    return tuple(kw.get(n) for n in schemas.RAW_TAGS.fieldNames())


def test_image_goldens(spark):
    rows = [
        rec(SourceFile="/x/test.jpg", FileSize=123456, DateTimeOriginal="2021:05:17 11:49:34",
            Model="Canon EOS Rebel T6", LensModel="EF-S18-55mm f/3.5-5.6 III", FocalLength="55.0",
            FNumber=5.6, ISO=100, ExposureTime=0.00125, ImageWidth=5184, ImageHeight=3456,
            GPSLatitude=51.5125864, GPSLongitude=-0.1369751, GPSAltitude=71.16),
        rec(SourceFile="/x/IMG.CR2", DateTimeOriginal="2025:04:19 16:59:43", Model="Canon EOS Rebel T6",
            LensModel="EF-S18-55mm f/3.5-5.6 III", FocalLength="28", FNumber=4.0, ISO=100, ExposureTime=0.0025,
            ImageWidth=5184, ImageHeight=3456),
        rec(SourceFile="/x/IMG.CR3", DateTimeOriginal="2026:02:14 14:00:21", Model="Canon EOS R8",
            LensModel="RF24-105mm F4-7.1 IS STM", FocalLength="24", FNumber=4.0, ISO=100, ExposureTime=0.0005,
            ImageWidth=6000, ImageHeight=4000),
    ]
    img = {r["filetype"]: r for r in conform.conform_images(tags_df(spark, rows)).collect()}
    j = img[".jpg"]
    assert (j["name"], j["camera"], j["lens"]) == ("test", "Canon EOS Rebel T6", "EF-S18-55mm f/3.5-5.6 III")
    assert j["date_taken"] == dt.date(2021, 5, 17) and j["time_taken"] == "11:49:34"
    assert (j["width"], j["height"], j["focal_length"], j["aperture"], j["iso"]) == (5184, 3456, 55.0, 5.6, 100)
    assert j["shutter_speed"] == "1/800s"
    assert round(j["latitude"], 6) == 51.512586 and round(j["longitude"], 6) == -0.136975
    assert j["altitude"] == 71.16 and j["directory"] == "/x"
    assert img[".cr2"]["shutter_speed"] == "1/400s" and img[".cr2"]["date_taken"] == dt.date(2025, 4, 19)
    assert img[".cr3"]["shutter_speed"] == "1/2000s" and img[".cr3"]["camera"] == "Canon EOS R8"


def test_video_golden(spark):
    rows = [rec(SourceFile="/v/clip.mp4", FileSize=1024, CreateDate="2026:01:14 16:57:59", Duration=3.5,
                VideoCodecID="avc1", VideoFrameRate=29.97, ImageWidth=1920, ImageHeight=1080)]
    v = conform.conform_videos(tags_df(spark, rows)).first()
    assert v["date_taken"] == dt.date(2026, 1, 14) and v["time_taken"] == "16:57:59"
    assert v["duration_ms"] == 3500.0 and v["codec"] == "avc1" and v["frame_rate"] == 29.97
    assert (v["size_bytes"], v["width"], v["height"]) == (1024, 1920, 1080)


def test_typed_empty_tables(spark):
    e = conform.split_kinds(conform.conform_media(spark.createDataFrame([], schemas.RAW_TAGS)))
    assert e["image"].schema == schemas.IMAGE and e["image"].count() == 0
    assert e["video"].columns == schemas.VIDEO.fieldNames()
    assert e["other"].columns == schemas.OTHER.fieldNames()


def test_records_without_source_dropped_and_truthiness(spark):
    rows = [rec(SourceFile=""), rec(SourceFile=None),
            rec(SourceFile="/a/b.jpg", LensModel="", LensID="ID 3", FNumber=0.0, Aperture=2.8,
                ImageWidth=0, ExifImageWidth=640, DateTimeOriginal="", CreateDate="2020:01:02")]
    r = conform.conform_images(tags_df(spark, rows)).collect()
    assert len(r) == 1
    r = r[0]
    assert (r["lens"], r["aperture"], r["width"]) == ("ID 3", 2.8, 640)
    assert r["date_taken"] == dt.date(2020, 1, 2) and r["time_taken"] is None


def test_invalid_date_is_null(spark):
    assert one(spark, dates.parse_exif_date(F.col("v")), "0000:00:00") is None
    assert one(spark, dates.parse_exif_date(F.col("v")), "2026:06:07") == dt.date(2026, 6, 7)


def test_year_month(spark):
    d = spark.createDataFrame([(dt.date(2026, 6, 7),), (None,)], "d date")
    got = [(r[0], r[1]) for r in d.select(dates.year_text("d"), dates.month_text("d")).collect()]
    assert got == [("2026", "06"), (None, None)]
    for txt in ("2026:06:07 12:00:00", "2026-06-07"):
        y, m = dates.year_month_from_text(F.col("v"))
        assert one(spark, y, txt) == "2026" and one(spark, m, txt) == "06"


def test_path_parts(spark):
    cases = {"/a/b/c.tar.gz": ("c.tar", ".gz", "/a/b"), "/a/.bashrc": (".bashrc", "", "/a"),
             "/a/README": ("README", "", "/a"), "c.JPG": ("c", ".JPG", ""), "/c.x": ("c", ".x", "/")}
    for p, (stem, ext, d) in cases.items():
        assert one(spark, paths.stem(F.col("v")), p) == stem
        assert one(spark, paths.extension(F.col("v")), p) == ext
        assert one(spark, paths.dirname(F.col("v")), p) == d


def test_odd_extensions(spark):
    cases = {"..": "", "..a": "", "..a.b": ".b", "a.": ".", "a..": ".", "/x.d/a": "", "/a.\nb": ".\nb", "": "", None: ""}
    for p, ext in cases.items():
        assert one(spark, paths.extension(F.col("v")), p) == ext


def test_pushed_conditions_make_the_path_seldom(spark):
    """Conditions on the kind and the key of a path are pushed down to where it
    is put together; each mention there puts it together anew."""
    made = spark.range(3).select(F.concat(F.lit("/m/"), F.col("id").cast("string"), F.lit(".jpg")).alias("path"))
    for cond in (conform.kind_of(paths.filetype("path")) != "other", conform.kind_of(paths.filetype("path")) == "other"):
        plan = made.where(cond).select("path")._jdf.queryExecution().optimizedPlan().toString()
        assert sum(line.count("concat(/m/") for line in plan.split("\n") if "Filter" in line) <= 2
    normal = made.where(paths.normalize_path("path").isNotNull())
    plan = normal._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.split("THEN")[0].count("concat(/m/") for line in plan.split("\n") if "Filter" in line) <= 2


def test_normalize_path(spark):
    cases = {"/a/./b//c/../d.jpg": "/a/b/d.jpg", "/../x": "/x", "//srv/x": "//srv/x", "///a": "/a",
             "rel/x.jpg": "/base/rel/x.jpg", "/": "/", "": "/base", "/a/": "/a", "/a/.": "/a", "/a/..": "/", "/a/...": "/a/...", None: None}
    for p, want in cases.items():
        assert one(spark, paths.normalize_path(F.col("v"), base="/base"), p) == want
    assert one(spark, paths.normalize_path(F.col("v"), case_insensitive=True), "C:\\Pics\\A.JPG") == "/c:/pics/a.jpg"


def test_shutter_rules(spark):
    fmt = {0.00125: "1/800s", 0.4: "1/2s", 2.0: "2s", 1.5: "1.5s", 0.0: "0", None: None}
    for x, want in fmt.items():
        assert one(spark, numbers.format_shutter(F.col("v")), x, "v double") == want
    z = {"1/800s": 1 / 800, "2s": 2.0, "bad": 0.0, "": 0.0, None: 0.0, "1/0": 0.0, "1/2/3": 0.0}
    for t, want in z.items():
        assert one(spark, numbers.parse_shutter(F.col("v"), "zero"), t) == want
    n = {"1/800s": 1 / 800, "2ss": 2.0, "bad": None, "1/0": None, "1/8S": None}
    for t, want in n.items():
        assert one(spark, numbers.parse_shutter(F.col("v"), "null"), t) == want


def test_size_mb_half_even(spark):
    assert one(spark, numbers.size_mb(F.col("v")), 131072, "v long") == 0.12  # 0.125 -> 0.12
    assert one(spark, numbers.size_mb(F.col("v")), 393216, "v long") == 0.38  # 0.375 -> 0.38


def test_clean_and_sanitize(spark):
    assert one(spark, text.clean_text(F.col("v")), "a\tb\nc\x7fd\x85e") == "abcde"
    assert one(spark, text.sanitize_folder_name(F.col("v")), "Brand#1 f/2.8 Émile-é_x") == "Brand_1 f_2.8 Émile-é_x"


def test_fix_month(spark):
    assert one(spark, dates.shift_month_text(F.col("v")), "2023:07:04 10:00:00") == "2023:06:04 10:00:00"
    assert one(spark, dates.shift_month_text(F.col("v")), "2023:08:04 10:00:00") == "2023:08:04 10:00:00"


def test_normalize_path_matches_posix(spark):
    """Fast path (already normal) and segment walk agree with ``posixpath.normpath``."""
    import posixpath
    import random

    from medialake.functions import paths as P

    rnd = random.Random(7)
    segs = ["a", "b", ".", "..", "", "c.d", "e f"]
    cases = ["/", "//", "///", "//a", "/a/", "/a/.", "/a/..", "a", "./a", "../a"]
    for _ in range(300):
        p = "/".join(rnd.choice(segs) for _ in range(rnd.randint(1, 6)))
        cases.append(rnd.choice(["", "/", "//", "///"]) + p + rnd.choice(["", "/"]))
    df = spark.createDataFrame([(c,) for c in cases], "p string")
    got = dict(df.select("p", P.normalize_path(F.col("p")).alias("n")).collect())
    for c in cases:
        want = posixpath.normpath(c if c.startswith("/") else "/" + c)
        assert got[c] == want, (c, got[c], want)

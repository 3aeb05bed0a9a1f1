"""The four jobs over real folders: extraction counts, filters, statuses,
second imports, isolated charts."""

import os

from pyspark.sql import functions as F

from medialake import schemas
from medialake.operators import organize
from medialake.operators.filters import FilterSpec
from medialake.plans import jobs
from medialake.sources import catalog, listing


def tree(tmp, names):
    for rel in names:
        p = os.path.join(tmp, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "w") as f:
            f.write(rel)
    return os.path.join(tmp, "in")


def counting(log):
    """An extractor that writes every path it is asked for to a file."""
    def extractor(paths, profile, wanted):
        with open(log, "a") as f:
            f.writelines(p + "\n" for p in paths)
        return [{"SourceFile": p, "Model": "Cam", "DateTimeOriginal": "2024:05:06 07:08:09", "FileSize": os.path.getsize(p)}
                for p in paths if "bare" not in p]
    return extractor


def asked(log):
    with open(log) as f:
        return sorted(os.path.basename(x.strip()) for x in f)


NAMES = ["in/_MG_1.jpg", "in/a/b.jpg", "in/a/bare.jpg", "in/c.mp4", "in/n.txt"]


def test_rebuild_extracts_each_file_once(spark, tmp):
    root, log, cat = tree(tmp, NAMES), os.path.join(tmp, "log"), os.path.join(tmp, "cat")
    assert [jobs.run_rebuild(spark, [root], cat, extractor=counting(log))] == catalog.imports(spark, cat)
    assert asked(log) == ["_MG_1.jpg", "b.jpg", "bare.jpg", "c.mp4"]
    got = {k: sorted(os.path.basename(r["full_path"]) for r in v.collect()) for k, v in catalog.read_catalog(spark, cat).items()}
    assert got == {"image": ["_MG_1.jpg", "b.jpg"], "video": ["c.mp4"], "other": ["n.txt"]}


def test_filter_job_drops_files_without_metadata(spark, tmp):
    root, log = tree(tmp, NAMES), os.path.join(tmp, "log")
    lst = listing.scan_listing(spark, [root])
    done = jobs.run_organize(spark, lst, os.path.join(tmp, "out"), organize.LayoutOptions(), spec=FilterSpec(extensions=(".jpg",)),
                             extractor=counting(log))
    assert asked(log) == ["_MG_1.jpg", "b.jpg", "bare.jpg"]  # no .mp4 is extracted under a .jpg filter
    got = {os.path.basename(r["path"]): (r["destination"][len(tmp):], r["status"]) for r in done["manifest"].collect()}
    assert got == {"_MG_1.jpg": ("/out/Photos/2024/05/_MG_1.jpg", "copied"), "b.jpg": ("/out/Photos/2024/05/b.jpg", "copied")}


def test_organize_twice_with_catalog(spark, tmp):
    root, log, cat, out = tree(tmp, NAMES), os.path.join(tmp, "log"), os.path.join(tmp, "cat"), os.path.join(tmp, "out")
    lst = listing.scan_listing(spark, [root, os.path.join(root, "a")])  # overlapping roots: two rows for a/*
    opts = organize.LayoutOptions(on_exist="skip")
    first = jobs.run_organize(spark, lst, out, opts, extractor=counting(log), catalog_root=cat)
    rep = first["report"].first()
    assert (rep["total"], rep["copied"], rep["excluded"]) == (7, 5, 2)
    assert {os.path.basename(r["path"]) for r in first["excluded"].collect()} == {"b.jpg", "bare.jpg"}
    before = {k: sorted(map(str, v.collect())) for k, v in catalog.read_catalog(spark, cat).items()}
    assert sum(map(len, before.values())) == 5
    second = jobs.run_organize(spark, lst, out, opts, extractor=counting(log), catalog_root=cat)
    assert second["report"].first()["copied"] == 0
    assert {k: sorted(map(str, v.collect())) for k, v in catalog.read_catalog(spark, cat).items()} == before


def test_organize_rename_never_overwrites(spark, tmp):
    root, out = tree(tmp, ["in/x/_MG_1.jpg", "in/y/_MG_1.jpg"]), os.path.join(tmp, "out")
    tree(tmp, ["out/Photos/2024/05/_MG_1.jpg"])
    done = jobs.run_organize(spark, listing.scan_listing(spark, [root]), out, organize.LayoutOptions(),
                             extractor=counting(os.path.join(tmp, "log")))
    assert sorted(os.path.basename(r["destination"]) for r in done["manifest"].collect()) == ["_MG_1_1.jpg", "_MG_1_2.jpg"]
    with open(os.path.join(out, "Photos/2024/05/_MG_1.jpg")) as f:
        assert f.read() == "out/Photos/2024/05/_MG_1.jpg"


def test_multi_target_job(spark, tmp):
    root = tree(tmp, NAMES)
    targets = [organize.Target(os.path.join(tmp, "e"), FilterSpec(filetypes=("image",)), catalog=os.path.join(tmp, "cat-e")),
               organize.Target(os.path.join(tmp, "v"), FilterSpec(filetypes=("video",)), catalog=os.path.join(tmp, "cat-v"))]
    lst = listing.scan_listing(spark, [root])
    for _ in range(2):
        done = jobs.run_organize_multi(spark, lst, targets, extractor=counting(os.path.join(tmp, "log")))
    # the second run meets the files of the first and takes free names beside them
    names = sorted(os.path.basename(r["destination"]) for r in done["manifest"].collect())
    assert names == ["_MG_1_1.jpg", "b_1.jpg", "c_1.mp4"]
    assert catalog.read_catalog(spark, targets[0].catalog)["image"].count() == 4
    assert catalog.read_catalog(spark, targets[1].catalog)["video"].count() == 2


def test_analyze_isolates_charts_and_lists_failures(spark, tmp, monkeypatch):
    root, reader = tree(tmp, NAMES), counting(os.path.join(tmp, "log"))

    def extractor(paths, profile, wanted):
        if profile == "video":
            raise OSError("no reader")
        return reader(paths, profile, wanted)

    def broken(*a, **k):
        raise RuntimeError("no histogram")

    monkeypatch.setattr(jobs.histograms, "setting_histogram", broken)
    out = jobs.run_analyze(spark, listing.scan_listing(spark, [root]), os.path.join(tmp, "out"), extractor=extractor, stamp="t")
    assert sorted(os.listdir(os.path.join(out, "metadata"))) == ["images", "others", "videos"]
    charts = os.listdir(os.path.join(out, "charts"))
    assert "images_cameras" in charts and "images_monthly_lens" in charts and "images_settings_iso" not in charts
    lost = spark.read.parquet(os.path.join(out, "extraction_failures")).collect()
    assert [(os.path.basename(r["path"]), r["error"]) for r in lost] == [("c.mp4", "OSError: no reader")]


def test_dashboard_tables_build(spark):
    i = schemas.empty(spark, schemas.IMAGE)
    t = jobs.dashboard_tables(i, schemas.empty(spark, schemas.VIDEO), schemas.empty(spark, schemas.OTHER))
    assert t["totals"].first()["total_files"] == 0 and t["cameras"].where(F.col("rank") > 0).count() == 0

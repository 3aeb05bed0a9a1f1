"""Layout planning, collision policies (vs a sequential simulation), records,
the copy action, and the forced hot-key split of the rank helper."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from medialake.operators import organize, ranking


def sequential(files, existing, policy):
    """Reference walk: files = [(order, dir, name)], existing = set of paths."""
    taken = set(existing)
    out = {}
    for order, d, name in sorted(files):
        dest = f"{d}/{name}"
        if policy == "skip":
            out[order] = (dest, "skipped" if dest in taken else "copied")
            taken.add(dest)
            continue
        stem, ext = (name.rsplit(".", 1)[0], "." + name.rsplit(".", 1)[1]) if "." in name else (name, "")
        k = 1
        while dest in taken:
            dest = f"{d}/{stem}_{k}{ext}"
            k += 1
        taken.add(dest)
        out[order] = (dest, "copied")
    return out


def frame(spark, files):
    rows = [(f"/src/{o:05d}/{name}", o, d) for o, d, name in files]
    df = spark.createDataFrame(rows, "full_path string, size_bytes bigint, target_dir string")
    return df.withColumn("destination", F.concat("target_dir", F.lit("/"), F.regexp_extract("full_path", "[^/]*$", 0))) \
        .withColumn("_rid", F.col("size_bytes"))


def run(spark, files, existing, policy):
    plan = frame(spark, files)
    ex = spark.createDataFrame([(p,) for p in existing], "path string") if existing else None
    res = (organize.resolve_skip(plan, ex, ["full_path", "size_bytes"]) if policy == "skip"
           else organize.resolve_rename(plan, ex, ["full_path", "size_bytes"]))
    return {r["size_bytes"]: (r["destination"], r["status"]) for r in res.collect()}


def random_case(seed):
    rnd = random.Random(seed)
    stems = ["a", "a_1", "a_1_1", "a_2", "b", "IMG_5", "IMG_5_1", "c_01"]
    files = [(i, rnd.choice(["/o/x", "/o/y"]), rnd.choice(stems) + rnd.choice([".jpg", ".JPG", ""]))
             for i in range(rnd.randint(1, 25))]
    existing = {f"{rnd.choice(['/o/x', '/o/y'])}/{rnd.choice(stems)}{rnd.choice(['.jpg', ''])}"
                for _ in range(rnd.randint(0, 6))}
    return files, existing


@pytest.mark.parametrize("seed", range(6))
def test_rename_equals_sequential(spark, seed):
    files, existing = random_case(seed)
    assert run(spark, files, existing, "rename") == sequential(files, existing, "rename")


@pytest.mark.parametrize("seed", range(3))
def test_skip_equals_sequential(spark, seed):
    files, existing = random_case(100 + seed)
    assert run(spark, files, existing, "skip") == sequential(files, existing, "skip")


def test_hot_folder(spark):
    """One folder + name holding most rows, with blocked indices."""
    files = [(i, "/o/hot", "IMG.jpg") for i in range(300)] + [(300 + i, "/o/cold", f"f{i}.jpg") for i in range(20)]
    existing = {"/o/hot/IMG_3.jpg", "/o/hot/IMG_7.jpg"}
    assert run(spark, files, existing, "rename") == sequential(files, existing, "rename")
    assert run(spark, files, existing, "skip") == sequential(files, existing, "skip")


def test_rank_over_many_ranges(spark):
    rows = [("k", i) for i in range(200)] + [("j", i) for i in range(7)] + [(None, i) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, o bigint").repartition(8)
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that key "k" spans ranges
    try:
        got = {(r["k"], r["o"]): r["rank"] for r in ranking.rank_within(df, ["k"], ["o"]).collect()}
        assert len(got) == 210 and all(got[(k, o)] == o for k, o in got)
        whole = ranking.running_sum(df.where("k = 'k'").withColumn("w", F.col("o")), [], ["o"], "w", "s", inclusive=True)
        assert all(r["s"] == r["o"] * (r["o"] + 1) // 2 for r in whole.collect())
        q = ranking.exact_quantiles(spark.range(1, 101).toDF("x"), "x", [0.02, 0.5, 0.98]).first()
        assert (q["q0"], q["q1"], q["q2"]) == (2.98, 50.5, 98.02)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)


def test_quantile_plan_has_no_nested_loop(spark):
    q = ranking.exact_quantiles(spark.range(1000).toDF("x"), "x", [0.5])
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_rename_long_suffix_and_wide_parent(spark):
    """A 20-digit suffix is no index that a file can reach; one ``IMG`` next to
    very many ``IMG_k`` does not make them one family."""
    files = [(0, "/o/x", "p.jpg"), (1, "/o/x", "p.jpg"), (2, "/o/x", "IMG.jpg")]
    files += [(3 + i, "/o/x", f"IMG_{1000 + i}.jpg") for i in range(10_000)] + [(20_000, "/o/x", "IMG.jpg")]
    existing = {"/o/x/p_12345678901234567890.jpg", "/o/x/p_1.jpg"}
    assert run(spark, files, existing, "rename") == sequential(files, existing, "rename")


def media(spark):
    rows = [
        ("/c/a.jpg", "image", dt.date(2024, 5, 1), "Cam/1", "L#2", 10),
        ("/c/b.jpg", "image", None, None, None, 11),
        ("/c/c.jpg", "image", None, "Cam", None, 12),
        ("/c/v.mp4", "video", dt.date(2023, 1, 2), None, None, 13),
        ("/c/w.mp4", "video", None, None, None, 14),
        ("/c/t.txt", "other", None, None, None, 0),
    ]
    return spark.createDataFrame(rows, "full_path string, kind string, date_taken date, camera string, "
                                       "lens string, size_bytes bigint")


def dirs(spark, opts):
    p = organize.plan_layout(media(spark), "/out", opts)
    return {r["full_path"]: r["target_dir"] for r in p.collect()}


def test_layout_dirs(spark):
    d = dirs(spark, organize.LayoutOptions())
    assert d["/c/a.jpg"] == "/out/Photos/2024/05"
    assert d["/c/b.jpg"] == "/out/Photos/No Info"
    assert d["/c/c.jpg"] == "/out/Photos/No Info"  # walk stops at the first missing field
    assert d["/c/v.mp4"] == "/out/Videos/2023/01"
    assert d["/c/w.mp4"] == "/out/Videos/No Info"
    assert d["/c/t.txt"] == "/out/No Info"
    d = dirs(spark, organize.LayoutOptions(by_media_type=False, structure=("Model", "Lens")))
    assert d["/c/a.jpg"] == "/out/Cam_1/L_2" and d["/c/c.jpg"] == "/out/Cam/No Info"
    assert d["/c/v.mp4"] == "/out/No Info"
    d = dirs(spark, organize.LayoutOptions(structure=()))
    assert d["/c/a.jpg"] == "/out/Photos" and d["/c/v.mp4"] == "/out/Videos/No Info"


def test_records_and_report(spark):
    m = organize.plan_organize(media(spark), "/out", organize.LayoutOptions(on_exist="skip"))
    rep = organize.organize_report(m).first()
    assert (rep["total"], rep["copied"], rep["excluded"]) == (6, 6, 0)
    recs = organize.organized_rows(m)
    img = {r["full_path"]: r for r in recs["image"].collect()}
    assert "/out/Photos/2024/05/a.jpg" in img and img["/out/Photos/2024/05/a.jpg"]["camera"] == "Cam/1"
    assert img["/out/Photos/2024/05/a.jpg"]["directory"] == "/out/Photos/2024/05"
    oth = recs["other"].first()
    assert oth["full_path"] == "/out/No Info/t.txt" and oth["size_mb"] == 0.0


def test_apply_plan_copies(spark, tmp):
    src = os.path.join(tmp, "src")
    os.makedirs(src)
    for n in ("a.jpg", "b.jpg"):
        with open(os.path.join(src, n), "wb") as f:
            f.write(b"x" * 10)
    rows = [(os.path.join(src, "a.jpg"), os.path.join(tmp, "out", "2024", "a.jpg"), "copied"),
            (os.path.join(src, "b.jpg"), os.path.join(tmp, "out", "2024", "b.jpg"), "skipped"),
            (os.path.join(src, "missing.jpg"), os.path.join(tmp, "out", "m.jpg"), "copied")]
    man = spark.createDataFrame(rows, "full_path string, destination string, status string")
    st = {r["src"].rsplit("/", 1)[1]: r["status"] for r in organize.apply_plan(man).collect()}
    assert st == {"a.jpg": "copied", "missing.jpg": "error"}
    assert os.path.getsize(os.path.join(tmp, "out", "2024", "a.jpg")) == 10
    st2 = {r["status"] for r in organize.apply_plan(man.where(F.col("full_path").endswith("a.jpg"))).collect()}
    assert st2 == {"copied"}  # retry is harmless


def test_apply_plan_never_replaces_a_file(spark, tmp):
    def put(rel, data):
        p = os.path.join(tmp, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "wb") as f:
            f.write(data)
        return p

    rows = []
    for name, new, old in (("same", b"NEWDATA", b"NEWDATA"), ("size", b"NEWDATA", b"OLDDATA"), ("longer", b"NEW", b"OLDLONGER")):
        rows.append((put(f"src/{name}.jpg", new), put(f"out/{name}.jpg", old), "copied"))
    # two rows for one place: one wins, the other is an error (other content)
    rows += [(put("src/p.jpg", b"1"), os.path.join(tmp, "out/p.jpg"), "copied"), (put("src/q.jpg", b"2"), os.path.join(tmp, "out/p.jpg"), "copied")]
    man = spark.createDataFrame(rows, "full_path string, destination string, status string")
    st = {os.path.basename(r["src"]): r["status"] for r in organize.apply_plan(man).collect()}
    assert (st["same.jpg"], st["size.jpg"], st["longer.jpg"]) == ("copied", "error", "error")
    assert sorted((st["p.jpg"], st["q.jpg"])) == ["copied", "error"]
    with open(os.path.join(tmp, "out/size.jpg"), "rb") as f:
        assert f.read() == b"OLDDATA"
    assert not [n for n in os.listdir(os.path.join(tmp, "out")) if n.endswith(".part")]


def test_copy_listed_flat(spark, tmp):
    for rel in ("a/x.jpg", "b/x.jpg", "b/_y.jpg"):
        p = os.path.join(tmp, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "w") as f:
            f.write(rel)
    lst = spark.createDataFrame([(os.path.join(tmp, r),) for r in ("a/x.jpg", "b/x.jpg", "b/_y.jpg", "b/gone.jpg")], "path string")
    got = {r["path"][len(tmp) + 1:]: r["status"] for r in organize.copy_listed(lst, os.path.join(tmp, "flat")).collect()}
    assert got == {"a/x.jpg": "copied", "b/x.jpg": "skipped", "b/_y.jpg": "copied", "b/gone.jpg": "error"}


def test_organize_multi(spark):
    from medialake.operators.filters import FilterSpec
    t = [organize.Target("/E/Photos", FilterSpec(filetypes=("image",))),
         organize.Target("/E/Videos", FilterSpec(filetypes=("video",)), organize.LayoutOptions(on_exist="skip"))]
    m = organize.organize_multi(media(spark), t)
    got = sorted((r["target_id"], r["destination"]) for r in m.collect())
    assert (0, "/E/Photos/Photos/2024/05/a.jpg") in got and (1, "/E/Videos/Videos/2023/01/v.mp4") in got
    assert len(got) == 5
    there = spark.createDataFrame([("/E/Videos/Videos/2023/01/v.mp4",), ("/E/Photos/Photos/2024/05/a.jpg",)], "path string")
    again = {(r["target_id"], r["full_path"]): (r["destination"], r["status"]) for r in
             organize.organize_multi(media(spark), t, existing=there).collect()}
    assert again[(0, "/c/a.jpg")] == ("/E/Photos/Photos/2024/05/a_1.jpg", "copied")
    assert again[(1, "/c/v.mp4")][1] == "skipped"
    with pytest.raises(ValueError):
        organize.organize_multi(media(spark), [t[0], t[0]])


def random_deep_case(seed):
    rnd = random.Random(seed)
    stems = ["a", "a_1", "a_1_1", "a_1_1_1", "a_2", "a_10", "b", "b_1_1", "IMG_5", "IMG_5_1", "c_01", "c_0",
             "x__1", "x_", "d_1"]
    files = [(i, rnd.choice(["/o/x", "/o/y"]), rnd.choice(stems) + rnd.choice([".jpg", ".png", ""]))
             for i in range(rnd.randint(1, 40))]
    existing = {f"{rnd.choice(['/o/x', '/o/y'])}/{rnd.choice(stems)}{rnd.choice(['.jpg', ''])}"
                for _ in range(rnd.randint(0, 10))}
    return files, existing


@pytest.mark.parametrize("seed", range(12))
def test_rename_nested_stems_equals_sequential(spark, seed):
    files, existing = random_deep_case(200 + seed)
    assert run(spark, files, existing, "rename") == sequential(files, existing, "rename")


@pytest.mark.parametrize("seed", range(4))
def test_decide_one_stem_over_many_stretches(spark, seed):
    """A folder with very many contested names of one stem: the same decisions as
    one walk in order, with the names spread evenly over tasks."""
    rnd = random.Random(seed)
    rows = []
    for stem, n in (("IMG", 4000), ("a", 3), ("z", 700)):
        lost = rnd.randint(0, 1)
        for k in range(1, n + 1):
            q = [0, rnd.randint(0, k), k // 2 + rnd.randint(-40, 40), n][seed]
            rows.append((stem.encode(), k, k - rnd.randint(0, 1), q, lost))
    want, state = {}, {}
    for s, k, free, q, lost in rows:
        blocked = state.get(s, lost)
        want[s, k] = free - blocked < q
        state[s] = blocked + (not want[s, k])
    rnd.shuffle(rows)
    level = spark.createDataFrame(rows, "_sid binary, _k bigint, _free bigint, _q bigint, _lost int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        done = organize._decide(level)
        got = {(bytes(r["_sid"]), r["_k"]): r["_took"] for r in done.collect()}
        sizes = sorted(r["count"] for r in level.repartitionByRange(*organize.STEM, "_k").groupBy(F.spark_partition_id()).count().collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == want
    assert len(sizes) >= 7 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_rename_a_million_style_folder(spark):
    """Files named IMG beside files named IMG_k for many k, in mixed order."""
    rnd = random.Random(5)
    names = ["IMG.jpg"] * 300 + [f"IMG_{k}.jpg" for k in range(1, 400)] * 2
    rnd.shuffle(names)
    files = [(i, "/o/x", n) for i, n in enumerate(names)]
    assert run(spark, files, {"/o/x/IMG_7.jpg"}, "rename") == sequential(files, {"/o/x/IMG_7.jpg"}, "rename")


def _stored_columns(spark, df):
    return {c for d in {os.path.dirname(f) for f in df.inputFiles()} for c in spark.read.parquet(d).columns}


@pytest.mark.parametrize("policy", ["skip", "rename"])
def test_plan_stores_no_unused_fields(spark, policy):
    """Layout fields are given with the manifest but not stored in the plan."""
    m = organize.plan_organize(media(spark), "/out", organize.LayoutOptions(on_exist=policy, structure=("Year", "Lens")))
    assert not any(c.startswith("lay_") or c == "has_layout" for c in _stored_columns(spark, m))
    want = organize.layout_fields(media(spark)).select("full_path", *organize.FIELD_COLUMNS.values(), "has_layout")
    assert m.select(*want.columns).exceptAll(want).isEmpty() and m.count() == want.count() and "_sid" not in m.columns
    multi = organize.organize_multi(media(spark), [organize.Target("/a"), organize.Target("/b", options=organize.LayoutOptions(on_exist="skip"))])
    assert not any(c.startswith("lay_") for c in _stored_columns(spark, multi)) and multi.count() == 2 * want.count()


def test_multi_targets_store_what_they_use(spark):
    from conftest import SF001
    from medialake.plans import common, q_organize
    catalog_columns = set(common.media(spark, SF001).columns)
    stored = _stored_columns(spark, q_organize.organize_multi(spark, SF001)) & catalog_columns
    assert stored == {"full_path", "size_bytes", "kind", "date_taken", "camera", "lens", "filetype"}

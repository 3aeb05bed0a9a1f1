"""Layout planning: destination folders, name-collision policy, records.

Planning is lazy and pure (a manifest ``DataFrame``); copying is a separate
action (``apply_plan``).

Collision policies, defined by a sequential walk over the files in input
order (``order`` columns, default ``full path, size``):

* ``skip``: the first file claiming a destination takes it; later claimants,
  and files whose destination already exists, are ``skipped``.
* ``rename``: a file takes the first free name among ``stem``, ``stem_1``,
  ``stem_2``, ... (free = not pre-existing, not given out earlier).

``rename`` is solved exactly without a global sequential pass. Names of a
stem ``u`` are ``u`` (index 0) and ``u_k``; pre-existing names block indices.
Two planned stems share at most one name: index ``k`` of ``u`` is index 0 of
the planned stem ``v = u_k``. Such a name is contested, and goes to whichever
wants it first: ``v``'s first file, or the file of ``u`` that gets that far.

1. One skew-safe running sum over (files of a stem, first files of its child
   stems) gives each file its rank ``r`` in its stem, and each contested name
   ``q`` = the number of ``u``'s files that come before ``v``'s first.
2. With ``s`` blocked indices below ``k``, the file of ``u`` that wants ``k``
   has rank ``k - s``: ``u`` takes the name if ``k - s < q``, else it is blocked
   for ``u``. This is decided in ascending ``k`` over the contested names alone
   (never over files), in stretches whose only state is the count ``s`` carried
   from one to the next (``_decide``). Whether ``u``'s own index 0 was taken is
   known from its parent, so this runs once per nesting level of contested names.
3. The file of rank ``r`` gets the ``r``-th index that is not blocked: ``r``
   plus the number of blocked indices ``b_j`` with ``b_j - j <= r``, one more
   running sum over the stems that have any.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable, Optional, Sequence, Union

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medialake import schemas
from medialake.functions import dates, numbers, paths
from medialake.functions.text import sanitize_folder_name
from medialake.operators import copying
from medialake.operators.ranking import rank_within, running_sum
from medialake.session import settled
from medialake.session import stored as materialize

# Folder names of the layout.
NO_INFO = "No Info"
MEDIA_FOLDERS = {"image": "Photos", "video": "Videos"}
STRUCTURE_FIELDS = ("Year", "Month", "Model", "Lens")
# layout field -> column holding it (Spark names are case-insensitive: "Lens" would clash with "lens")
FIELD_COLUMNS = {"Year": "lay_year", "Month": "lay_month", "Model": "lay_model", "Lens": "lay_lens"}
# a stem: 128-bit hash of folder, extension and stem; files of one stem compete for the same names
STEM = ["_sid"]

CHILD_RE = r"^(.*)_([1-9][0-9]*)$"


@dataclass(frozen=True)
class LayoutOptions:
    by_media_type: bool = True
    structure: tuple = ("Year", "Month")
    on_exist: str = "rename"  # or "skip"

    def __post_init__(self):
        for f in self.structure:
            if f not in STRUCTURE_FIELDS:
                raise ValueError(f"unknown structure field {f!r}")
        if self.on_exist not in ("rename", "skip"):
            raise ValueError(self.on_exist)


def _truthy_text(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def layout_fields(df: DataFrame, kind_col: str = "kind", has_meta_col: Optional[str] = None) -> DataFrame:
    """Add the layout fields ``lay_year, lay_month, lay_model, lay_lens`` and
    ``has_layout`` (O1).

    Images: all four (Model/Lens sanitized); no layout when all are missing.
    Videos: Year and Month; no layout when both are missing. Others: none.
    """
    kind = F.col(kind_col)
    has_meta = F.col(has_meta_col) if has_meta_col else F.lit(True)
    d = F.col("date_taken")
    year, month = dates.year_text(d), dates.month_text(d)
    cam, lens = F.col("camera"), F.col("lens")
    model = F.when(_truthy_text(cam), sanitize_folder_name(cam))
    lensf = F.when(_truthy_text(lens), sanitize_folder_name(lens))
    is_img = has_meta & (kind == "image")
    is_vid = has_meta & (kind == "video")
    has_img = is_img & (d.isNotNull() | _truthy_text(cam) | _truthy_text(lens))
    has_vid = is_vid & d.isNotNull()
    return df.select(
        "*",
        F.when(has_img | has_vid, year).alias("lay_year"),
        F.when(has_img | has_vid, month).alias("lay_month"),
        F.when(has_img, model).alias("lay_model"),
        F.when(has_img, lensf).alias("lay_lens"),
        (has_img | has_vid).alias("has_layout"),
    )


def _join(a: str, b: str) -> str:
    return b if a == "" else (a + b if a.endswith("/") else a + "/" + b)


def target_dir_expr(root: str, options: LayoutOptions, kind_col: str = "kind",
                    has_meta_col: Optional[str] = None) -> Column:
    """Destination folder of each row (O2/O3), folded into one expression:
    root [/Photos|/Videos] then the structure fields up to the first missing
    one, which becomes ``No Info``. Needs :func:`layout_fields` columns."""
    root = root.rstrip("/") or "/"
    kind = F.col(kind_col)
    has_meta = F.col(has_meta_col) if has_meta_col else F.lit(True)
    if options.by_media_type:
        base = (F.when(has_meta & (kind == "image"), F.lit(_join(root, MEDIA_FOLDERS["image"])))
                .when(has_meta & (kind == "video"), F.lit(_join(root, MEDIA_FOLDERS["video"])))
                .otherwise(F.lit(root)))
    else:
        base = F.lit(root)

    def walk(i: int) -> Column:
        if i == len(options.structure):
            return F.lit("")
        v = F.col(FIELD_COLUMNS[options.structure[i]])
        return F.when(v.isNull(), F.lit("/" + NO_INFO)).otherwise(F.concat(F.lit("/"), v, walk(i + 1)))

    tail = F.when(~F.col("has_layout"), F.lit("/" + NO_INFO))
    if not options.structure:
        tail = tail.when(has_meta & (kind == "video"), F.lit("/" + NO_INFO)).otherwise(F.lit(""))
    else:
        tail = tail.otherwise(walk(0))
    folder = F.concat(base, tail)
    return F.regexp_replace(folder, "^//", "/") if root == "/" or root.startswith("//") else folder


def plan_layout(df: DataFrame, root: str, options: LayoutOptions, path_col: str = "full_path",
                kind_col: str = "kind", has_meta_col: Optional[str] = None) -> DataFrame:
    """Rows + ``target_dir`` and the initial ``destination`` (folder + base name)."""
    d = layout_fields(df, kind_col, has_meta_col)
    d = d.withColumn("target_dir", target_dir_expr(root, options, kind_col, has_meta_col))
    return d.withColumn("destination", F.concat(F.col("target_dir"), F.lit("/"), paths.basename(F.col(path_col))))


def _stored(build: Callable[[], DataFrame], rename: bool) -> DataFrame:
    """The plan that ``build`` gives, written once with a unique ``_rid`` and,
    for ``rename``, each row's stem; what ``build`` has stored on the way goes.
    The fields that the folder does not use are not worked out for it."""
    def rows() -> DataFrame:
        plan = build().drop(*FIELD_COLUMNS.values(), "has_layout")
        return (_with_stem(plan) if rename else plan).withColumn("_rid", F.monotonically_increasing_id())

    return settled(rows)


def _with_fields(manifest: DataFrame, kind_col: str, has_meta_col: Optional[str]) -> DataFrame:
    """The manifest with the layout fields, worked out where a reader asks for
    them, in front of the columns that planning adds."""
    ends = [c for c in ("target_root", "catalog", "target_dir", "destination", "status") if c in manifest.columns]
    rows = layout_fields(manifest.drop("_rid"), kind_col, has_meta_col)
    return rows.select(*[c for c in rows.columns if c not in ends], *ends)


def resolve_skip(plan: DataFrame, existing: Optional[DataFrame], order: Sequence[str]) -> DataFrame:
    """``skip`` policy: the first file by ``order`` that claims a destination
    is ``copied`` unless the destination exists; everything else ``skipped``.

    ``plan`` carries a stored unique ``_rid``. The winner of a destination is
    the minimum of a narrow (order, row id) struct, combined map-side, so a
    destination claimed by very many files is no hot key; the winners come back
    to the wide rows by the unique row id."""
    cols = plan.columns
    place = F.struct(*[F.col(c) for c in order], F.col("_rid").alias("_rid"))
    first = plan.groupBy("destination").agg(F.min(place).alias("_first"))
    if existing is not None:
        first = first.join(existing.select(F.col("path").alias("destination")).distinct(), "destination", "left_anti")
    # stored first: the destinations are no longer on disk when the wide rows are shuffled
    winners = materialize(first.select(F.col("_first._rid").alias("_rid"))).withColumn("_wins", F.lit(True))
    won = plan.join(winners, "_rid", "left")
    return won.select(*cols, F.when(F.col("_wins"), F.lit("copied")).otherwise(F.lit("skipped")).alias("status"))


def _child_of(stem: Column) -> tuple[Column, Column]:
    """(parent stem, index) of a stem ``u_k``; NULL for any other stem and for
    an index beyond 64 bits, which no file can reach."""
    k = F.regexp_extract(stem, CHILD_RE, 2)
    return F.nullif(F.regexp_extract(stem, CHILD_RE, 1), F.lit("")), F.nullif(k, F.lit("")).try_cast("bigint")


def _stem_id(folder: Column, ext: Column, stem: Column) -> Column:
    """No name holds a NUL or, but for the folder's, a slash."""
    return F.unhex(F.md5(F.concat_ws("\0", folder, ext, stem).cast("binary")))


def _with_stem(plan: DataFrame) -> DataFrame:
    dest = F.col("destination")
    return plan.withColumn("_sid", _stem_id(F.col("target_dir"), paths.extension(dest), paths.stem(dest)))


def _blocked_by_existing(existing: DataFrame, stems: DataFrame) -> DataFrame:
    """(stem, _k) for indices of planned stems whose name exists."""
    p = F.col("path")
    ex = existing.select(paths.dirname(p).alias("_dir"), paths.stem(p).alias("_stem"), paths.extension(p).alias("_ext"))
    parent, k = _child_of(F.col("_stem"))
    own = ex.select(_stem_id(F.col("_dir"), F.col("_ext"), F.col("_stem")).alias("_sid"), F.lit(0).cast("bigint").alias("_k"))
    kid = ex.select("_dir", "_ext", parent.alias("_stem"), k.alias("_k")).where("_stem IS NOT NULL AND _k IS NOT NULL").select(
        _stem_id(F.col("_dir"), F.col("_ext"), F.col("_stem")).alias("_sid"), "_k")
    return own.unionByName(kid).distinct().join(stems.select(*STEM), STEM, "left_semi")


def _walk(cut: DataFrame, carried: dict[int, int], summary: bool) -> DataFrame:
    """Walk the stretches of ``cut`` in order. ``carried``: names blocked before a
    stretch that goes on with the stem of the one before. Gives each contested
    name's decision, or with ``summary`` a row per stretch: its first and last
    stem, and the names newly blocked in each."""
    spread = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut.repartition(spread, "_part").sortWithinPartitions("_part", "_nth")

    def walk(batches):
        part = stem = None
        blocked = start = 0
        ends: list = []  # of the stretch at hand: first stem, its blocked names, last stem, its start and blocked names
        for pdf in batches:
            took, done = [], []
            for p, s, free, q, lost in zip(*[pdf[c] for c in ("_part", "_sid", "_free", "_q", "_lost")]):
                if p != part or s != stem:
                    if p != part:
                        if ends:
                            done.append((part, *ends))
                        blocked = start = carried.get(p, int(lost))
                        ends = [s, 0, s, int(lost), 0]
                    else:
                        blocked = start = int(lost)
                        ends[2:] = [s, int(lost), 0]
                    part, stem = p, s
                takes = free - blocked < q
                blocked += not takes
                took.append(takes)
                ends[4] = blocked - start
                if ends[0] == ends[2]:
                    ends[1] = blocked - start
            if summary:
                yield pd.DataFrame(done, columns=["part", "lo", "lo_new", "hi", "hi_lost", "hi_new"])
            else:
                yield pdf[[*STEM, "_k"]].assign(_took=took)
        if summary and ends:
            yield pd.DataFrame([(part, *ends)], columns=["part", "lo", "lo_new", "hi", "hi_lost", "hi_new"])

    if summary:
        return rows.mapInPandas(walk, "part int, lo binary, lo_new bigint, hi binary, hi_lost bigint, hi_new bigint")
    return rows.mapInPandas(walk, "_sid binary, _k bigint, _took boolean")


def _decide(level: DataFrame) -> DataFrame:
    """The contested names of one nesting level, with ``_took``: whether the
    parent stem takes the name. In ascending index, a stem's only state is the
    number of names blocked so far.

    Names are cut into stretches of (stem, index), so a stem with any number of
    them is spread over tasks. What a stretch blocks depends on the number
    carried into it, and only for its first stem. All stretches are walked with
    the numbers known so far, the sums of what they block give the numbers
    anew, until none changes: each round settles at least one more stretch, and
    all of them where what a stretch blocks does not change any more."""
    cut = materialize(level.select(*STEM, "_k", "_free", "_q", "_lost").repartitionByRange(*STEM, "_k").sortWithinPartitions(*STEM, "_k")
                      .withColumns({"_part": F.spark_partition_id(), "_nth": F.monotonically_increasing_id()}))
    carried: dict[int, int] = {}
    while True:
        after, last, blocked = {}, None, 0
        for r in sorted(_walk(cut, carried, True).collect(), key=lambda r: r["part"]):  # one row per stretch
            start = r["hi_lost"]
            if r["lo"] == last:
                after[r["part"]] = start = blocked
            one_stem = r["lo"] == r["hi"]
            last, blocked = r["hi"], (start + r["lo_new"]) if one_stem else (r["hi_lost"] + r["hi_new"])
        if after == carried:
            return _walk(cut, carried, False)
        carried = after


def _contest(contested: DataFrame) -> DataFrame:
    """All contested names with ``_took``, level by level: a stem whose own
    name is contested waits for its parent's decision."""
    done = None
    todo = contested
    kid = F.col("_kid").alias("_sid")
    while True:
        waiting = todo.select(kid)
        level = todo.join(waiting, STEM, "left_anti")
        lost = F.lit(0)
        if done is not None:
            taken = done.where("_took").select(kid, F.lit(1).alias("_is_lost"))
            level = level.join(taken, STEM, "left")
            lost = F.coalesce("_is_lost", F.lit(0))
        decided = _decide(level.withColumn("_lost", lost))
        named = decided.join(todo.select(*STEM, "_k", "_kid"), [*STEM, "_k"])
        done = materialize(named if done is None else done.unionByName(named))
        todo = materialize(todo.join(waiting, STEM, "left_semi"))
        if todo.isEmpty():
            return done


def resolve_rename(plan: DataFrame, existing: Optional[DataFrame], order: Sequence[str]) -> DataFrame:
    """``rename`` policy (see module doc); all rows ``copied``. ``plan`` carries
    a stored unique ``_rid``, and may carry each row's stem."""
    cols = [c for c in plan.columns if c not in STEM]
    if "_sid" not in plan.columns:
        plan = _with_stem(plan)
    dest = F.col("destination")
    place = [*order, "_rid"]
    folder, ext, stem = F.col("target_dir"), paths.extension(dest), paths.stem(dest)
    files_ = plan.select("_rid", *STEM, folder.alias("_dir"), dest.alias("_dest"), *order)
    # the files of a stem have one folder and one first destination
    stems = files_.groupBy(*STEM).agg(F.min(F.struct(*place)).alias("_first"), F.count("*").alias("_files"),
                                      *[F.min(c).alias(c) for c in ("_dir", "_dest")])
    stems = materialize(stems.select(*STEM, "_first", "_files", "_dir", paths.extension("_dest").alias("_ext"),
                                     paths.stem("_dest").alias("_stem")))

    parent, k = _child_of(F.col("_stem"))
    kids = stems.select("_dir", "_ext", parent.alias("_stem"), k.alias("_k"), F.col("_sid").alias("_kid"), "_first").where(
        "_stem IS NOT NULL AND _k IS NOT NULL")
    kids = kids.select(_stem_id(F.col("_dir"), F.col("_ext"), F.col("_stem")).alias("_sid"), "_k", "_kid", "_first")
    contested = kids.join(stems.select(*STEM), STEM, "left_semi")
    static = None
    if existing is not None:
        static = materialize(_blocked_by_existing(existing, stems))
        contested = contested.join(static, [*STEM, "_k"], "left_anti")
    contested = materialize(contested)

    # ranks of files, and the files before each child stem's first one
    none = F.lit(None)
    marks = contested.select(none.cast("bigint").alias("_rid"), *STEM, "_k", *[F.col("_first").getField(c).alias(f"_o{i}")
                                                                            for i, c in enumerate(place)], F.lit(0).cast("bigint").alias("_w"))
    own = files_.select("_rid", *STEM, none.cast("bigint").alias("_k"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(place)],
                        F.lit(1).cast("bigint").alias("_w"))
    ranked = settled(lambda: running_sum(
        own.unionByName(marks), STEM, [f"_o{i}" for i in range(len(place))], "_w", "_r").select("_rid", *STEM, "_k", "_r"))
    ranks = ranked.where("_rid IS NOT NULL").drop("_k")

    blocked = static
    if not contested.isEmpty():
        names = contested.select(*STEM, "_k", "_kid").join(
            ranked.where("_rid IS NULL").select(*STEM, "_k", F.col("_r").alias("_q")), [*STEM, "_k"])
        if static is None:
            names = names.withColumn("_free", F.col("_k"))
        else:  # index among those that no existing name blocks
            both = names.withColumn("_w", F.lit(0).cast("bigint")).unionByName(
                static.withColumn("_w", F.lit(1).cast("bigint")), allowMissingColumns=True)
            names = running_sum(both, STEM, ["_k"], "_w", "_below").where("_w = 0").withColumn(
                "_free", F.col("_k") - F.col("_below")).drop("_below", "_w")
        decided = _contest(materialize(names.select(*STEM, "_k", "_kid", "_q", "_free")))
        taken = decided.where("_took").select(F.col("_kid").alias("_sid"), F.lit(0).cast("bigint").alias("_k"))
        kept = decided.where(~F.col("_took")).select(*STEM, "_k")
        blocked = taken.unionByName(kept) if blocked is None else blocked.unionByName(taken).unionByName(kept)
    if blocked is None:
        ranks = ranks.select("_rid", F.col("_r").alias("_x"))
    else:
        # indices that some file gets as far as: b_j - j below the number of files
        gaps = rank_within(blocked.distinct(), STEM, ["_k"], out="_j").select(*STEM, (F.col("_k") - F.col("_j")).alias("_gap"))
        gaps = materialize(gaps.join(stems.select(*STEM, "_files"), STEM).where("_gap < _files").drop("_files"))
        hit = gaps.select(*STEM).distinct()
        free = ranks.join(hit, STEM, "left_anti").select("_rid", F.col("_r").alias("_x"))
        merged = (ranks.join(hit, STEM, "left_semi").select("_rid", *STEM, F.col("_r").alias("_at"), F.lit(0).cast("bigint").alias("_w"))
                  .unionByName(gaps.select(none.cast("bigint").alias("_rid"), *STEM, F.col("_gap").alias("_at"),
                                           F.lit(1).cast("bigint").alias("_w")))
                  .withColumn("_late", 1 - F.col("_w")))
        moved = running_sum(merged, STEM, ["_at", "_late"], "_w", "_shift").where("_rid IS NOT NULL")
        ranks = free.unionByName(moved.select("_rid", (F.col("_at") + F.col("_shift")).alias("_x")))

    # the first file of a stem keeps its destination
    given = F.when(F.col("_x") == 0, dest).otherwise(F.concat(folder, F.lit("/"), stem, F.lit("_"), F.col("_x").cast("string"), ext))
    out = plan.drop(*STEM).join(ranks, "_rid").withColumn("_given", given)
    return out.select(*[c for c in cols if c != "destination"], F.col("_given").alias("destination"),
                      F.lit("copied").alias("status"))


def plan_organize(df: Union[DataFrame, Callable[[], DataFrame]], root: str, options: LayoutOptions, existing: Optional[DataFrame] = None,
                  path_col: str = "full_path", kind_col: str = "kind", has_meta_col: Optional[str] = None,
                  order: Sequence[str] = ("full_path", "size_bytes")) -> DataFrame:
    """Manifest: input rows + ``target_dir``, final ``destination``, ``status``.

    ``existing`` lists files already present under ``root`` (column ``path``).
    ``df`` may be a function that gives the rows: what it stores on the way is
    deleted once the plan is written.
    """
    # the plan feeds several passes (ranks, contested names, the join back):
    # it is written once in the shared checkpoint folder
    # ``_rid`` is assigned before the write, so it is stored, not recomputed
    build = df if callable(df) else lambda: df
    plan = _stored(lambda: plan_layout(build(), root, options, path_col, kind_col, has_meta_col), options.on_exist == "rename")
    if existing is not None:
        existing = materialize(existing.select("path").distinct())
    resolve = resolve_skip if options.on_exist == "skip" else resolve_rename
    return _with_fields(resolve(plan, existing, order), kind_col, has_meta_col)


def organized_rows(manifest: DataFrame, kind_col: str = "kind", has_meta_col: Optional[str] = None,
                   size_col: str = "size_bytes", carry: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Catalog rows for placed files (O6): copied and skipped rows are
    recorded; images/videos with metadata keep their tags with the path
    fields rewritten to the destination (E15); anything else becomes a
    minimal ``other`` row (missing or zero size -> 0.0 MB). ``carry`` names
    manifest columns kept next to the canonical ones (e.g. the source order
    for a later keep-last merge)."""
    m = manifest.where(F.col("status").isin("copied", "skipped"))
    dest = F.col("destination")
    has_meta = F.col(has_meta_col) if has_meta_col else F.lit(True)
    media = m.where(has_meta & F.col(kind_col).isin("image", "video"))
    media = media.withColumn("full_path", dest).withColumn("directory", paths.dirname(dest)) \
        .withColumn("name", paths.stem(dest))
    rest = m.where(~(has_meta & F.col(kind_col).isin("image", "video")))
    size = F.col(size_col)
    others = rest.select(
        *[F.col(c) for c in carry],
        paths.stem(dest).alias("name"), paths.filetype(dest).alias("filetype"), paths.dirname(dest).alias("directory"),
        dest.alias("full_path"), size.cast("bigint").alias("size_bytes"),
        F.when(size.isNull() | (size == 0), F.lit(0.0)).otherwise(numbers.size_mb(size)).alias("size_mb"))
    def canon(df, sch):
        return schemas.conform(df, sch, keep=tuple(carry))

    return {
        "image": canon(media.where(F.col(kind_col) == "image"), schemas.IMAGE),
        "video": canon(media.where(F.col(kind_col) == "video"), schemas.VIDEO),
        "other": canon(others, schemas.OTHER),
    }


def organize_report(manifest: DataFrame) -> DataFrame:
    """One row: files considered, copied, excluded (skipped + error) (K6)."""
    s = F.col("status")
    return manifest.agg(F.count(F.lit(1)).alias("total"), F.count_if(s == "copied").alias("copied"),
                        F.count_if(s.isin("skipped", "error")).alias("excluded"))


def excluded_files(manifest: DataFrame, path_col: str = "full_path") -> DataFrame:
    """The files that were not placed, with the reason (skipped or error)."""
    return manifest.where(F.col("status").isin("skipped", "error")).select(path_col, "status")


@dataclass(frozen=True)
class Target:
    """One destination of a multi-target organize run."""
    root: str
    spec: object = None  # FilterSpec
    options: LayoutOptions = field(default_factory=LayoutOptions)
    catalog: Optional[str] = None


def organize_multi(df: DataFrame, targets: Sequence[Target], path_col: str = "full_path",
                   kind_col: str = "kind", has_meta_col: Optional[str] = None,
                   order: Sequence[str] = ("full_path", "size_bytes"),
                   existing: Optional[DataFrame] = None) -> DataFrame:
    """Every file tested against every target (J4) in one scan: a row is
    exploded to the ids of the targets that want it, with the target's layout;
    collisions are resolved per target (distinct roots). ``existing`` lists
    files that already lie under any of the roots (column ``path``)."""
    roots = [t.root.rstrip("/") for t in targets]
    if len(set(roots)) != len(roots):
        raise ValueError("target roots must be distinct")
    wants = []
    for i, t in enumerate(targets):
        all_rows = t.spec is None or t.spec.is_empty()
        wants.append(F.when(F.lit(True) if all_rows else t.spec.predicate(), F.lit(i)))
    ids = F.filter(F.array(*wants), lambda i: i.isNotNull())
    tid = F.col("target_id")
    x = layout_fields(df.select("*", F.explode(ids).alias("target_id")), kind_col, has_meta_col)
    tdir, root, cat = (F.lit(None).cast("string") for _ in range(3))
    for i, t in enumerate(targets):
        tdir = F.when(tid == i, target_dir_expr(t.root, t.options, kind_col, has_meta_col)).otherwise(tdir)
        root = F.when(tid == i, F.lit(t.root)).otherwise(root)
        cat = F.when(tid == i, F.lit(t.catalog or t.root)).otherwise(cat)
    rows = x.withColumn("target_root", root).withColumn("catalog", cat).withColumn("target_dir", tdir).withColumn(
        "destination", F.concat(F.col("target_dir"), F.lit("/"), paths.basename(F.col(path_col))))
    plan = _stored(lambda: rows, any(t.options.on_exist == "rename" for t in targets))
    if existing is not None:
        existing = materialize(existing.select("path").distinct())
    out = None
    for policy, resolve in (("rename", resolve_rename), ("skip", resolve_skip)):
        chosen = [i for i, t in enumerate(targets) if t.options.on_exist == policy]
        if chosen:
            own = plan if policy == "rename" else plan.drop(*STEM)
            part = resolve(own.where(tid.isin(*chosen)), existing, order)
            out = part if out is None else out.unionByName(part)
    return _with_fields(out, kind_col, has_meta_col)


def apply_plan(manifest: DataFrame, source_col: str = "full_path", keep: Sequence[str] = (),
               size_col: Optional[str] = None) -> DataFrame:
    """Copy every ``copied`` row to its destination (O8), as a distributed
    action: (``keep`` columns, src, dst, status) with status ``copied`` or
    ``error``; one failure does not stop the others. ``size_col`` names the
    files' lengths, by which they are dealt to tasks (``copying``).

    A file is never replaced (``files.copy_new``): where the destination holds
    the same content, an earlier attempt has copied it; where it holds anything
    else, the row is an ``error`` and both files stay as they are."""
    size = F.col(size_col) if size_col else F.lit(None)
    todo = manifest.where(F.col("status") == "copied").select(
        *keep, F.col(source_col).alias("src"), F.col("destination").alias("dst"), size.cast("bigint").alias("length"))
    return copying.copy_files(todo, keep)


def copy_listed(listing: DataFrame, target_dir: str, path_col: str = "path") -> DataFrame:
    """Copy listed files flat into one folder: (path, destination, status).

    Of several files of one name the first by path is copied; the others, and
    files whose copy fails, are reported as ``skipped`` and ``error``."""
    p = F.col(path_col)
    dest = F.concat(F.lit(target_dir.rstrip("/") + "/"), paths.basename(p))
    size = F.col("length") if "length" in listing.columns else F.lit(None).cast("bigint")
    rows = materialize(listing.select(p.alias("full_path"), dest.alias("destination"), size.alias("length"))
                       .withColumn("_rid", F.monotonically_increasing_id()))
    plan = resolve_skip(rows, None, ["full_path"])
    done = apply_plan(plan, size_col="length").select(F.col("src").alias("path"), F.col("dst").alias("destination"), "status")
    rest = plan.where(F.col("status") == "skipped").select(F.col("full_path").alias("path"), "destination", "status")
    return done.unionByName(rest)

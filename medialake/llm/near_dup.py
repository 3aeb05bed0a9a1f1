"""MinHash near-dedup (operator 9): bottom-k sketches from one hash function.

Documents with equal shingle sets form a class; the work is on classes. A
class keeps its k smallest shingle hashes (bottom-k). Two sets of Jaccard
similarity J keep the same hash at each place of their merged sketch with
probability J, so similar sets share runs of adjacent retained values. The
inverted lists are keyed by such runs (three values, which is rarer than a
single value by far): a list holds the classes that retain the run. Pairs in a
list are estimated from the bottom k of the union of their sketches, and those
that may reach the threshold are verified on their full shingle sets.

For J >= 0.85 a pair misses all 46 runs of 48 indexed values with a
probability of about 0.63 ** 48 = 2e-10; sets with up to 48 values share a run
of three for certain (shorter runs are added for sets of up to eight values,
where one differing value could break all runs of three).

Long lists. A list longer than ``LIST`` classes is not expanded into pairs:
 1. Its classes are compared with the list's own centre, one pair each: the
    class most of whose runs are in long lists, which is the least edited one.
 2. Where members are still in different components, differences decide. For a
    centre c, let D(x) be the symmetric difference of x and c. If u is not
    linked with c but with m, then |u ^ m| <= k (|u| + |m|), while
    |D(u)| > k (|u| + |c|), with k = (1 - t) / (1 + t) for threshold t; so u and
    m share more than (|D(m)| + k (|c| - |m|)) / 2 hashes of D(u) and D(m).
    Hence, in any fixed order of hashes, one of them is among the first
    |D(m)| - that + 1 of D(m). These are indexed, classes not linked with c look
    up theirs, both as far down as the pair's own bound allows, and the pairs
    found are verified. The order puts hashes that c has not before those of c,
    these by halves of the hash range, and in each part the rare around c first.
    So a class that shares little with c enters without the hashes of c; hashes
    of one component only, or of no class unlinked with c, are not followed.
So no link between different components is lost that a union-sketch estimate lets
pass. Every list has a centre of its own: families of pages that share a site's
boilerplate meet their own family's centre in its lists, and only what remains
apart is looked up by differences.

Components: ``medialake.llm.components``. All intermediate tables are stored
under the shared checkpoint folder.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medialake.llm import rows as R
from medialake.llm import shingles as S
from medialake.llm.components import connected_components
from medialake.session import materialize

#: Retained values per sketch, those that are indexed, run length, long-list bound.
SKETCH, INDEXED, RUN, LIST = 64, 48, 3, 24
#: Sets up to this size also index runs of two.
SMALL = 8


def _run_keys(s: np.ndarray) -> np.ndarray:
    """Hashes of the runs of adjacent values among the indexed ones."""
    v = s[:INDEXED]
    out = []
    for r in ((RUN, RUN - 1) if len(s) <= SMALL else (RUN,)):
        if len(v) >= r and len(s) >= 4:
            h = np.full(len(v) - r + 1, r, np.uint64)
            for i in range(r):
                h = S.mix(h * np.uint64(0x9E3779B97F4A7C15) + v[i:len(v) - r + 1 + i])
            out.append(h)
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _sketch_udf(words: int):
    @F.pandas_udf("cls binary, n long, sketch array<long>, runs array<long>")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        cls, n, low, runs = [], [], [], []
        for t in texts:
            s = S.shingle_set(t, words)
            n.append(len(s))
            cls.append(S.set_digest(s) if len(s) else None)
            low.append(s[:SKETCH].view(np.int64))
            runs.append(_run_keys(s).view(np.int64))
        return pd.DataFrame({"cls": cls, "n": n, "sketch": low, "runs": runs})
    return sketch


def _set_udf(words: int):
    @F.pandas_udf("cls binary, hashes binary")
    def full(texts: pd.Series) -> pd.DataFrame:
        sets = [S.shingle_set(t, words) for t in texts]
        return pd.DataFrame({"cls": [S.set_digest(s) if len(s) else None for s in sets],
                             "hashes": [s.tobytes() for s in sets]})
    return full


def _common_udf():
    """Sizes of the intersections of two columns of ascending uint64 sets."""
    def one(x: bytes, y: bytes) -> int:
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        if len(x) > len(y):
            x, y = y, x
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        return int((y[at] == x).sum())

    @F.pandas_udf("long")
    def common(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="int64")
    return common


def _sizes_allow(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _candidates(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose union-sketch estimate may reach the threshold: at
    least five standard deviations of the estimate below it."""
    one = classes.select(F.col("cls").alias("a"), F.col("sketch").alias("sa"))
    two = classes.select(F.col("cls").alias("b"), F.col("sketch").alias("sb"))
    p = percent / 100
    least = p - 5 * (p * (1 - p) / SKETCH) ** 0.5
    low = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, SKETCH)
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb", low.alias("u"))
    both = F.size(F.array_intersect(F.array_intersect("u", "sa"), F.col("sb")))
    return joined.filter(both >= F.lit(least) * F.size("u")).select("a", "b")


def _full_sets(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(cls, hashes) for the classes in ``pairs``, stored. The sets are made
    again, from one document of each of these classes only."""
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
    heads = wanted.join(classes.select("cls", "head"), "cls").select(F.col("head").alias("hid"), F.col("cls").alias("want"))
    texts = docs.join(heads, F.col("id").eqNullSafe(F.col("hid"))).select("want", "text")
    # not deterministic, as far as the optimizer knows: no condition on the result moves below the join
    made = texts.select("want", _set_udf(words).asNondeterministic()("text").alias("s"))
    return materialize(made.filter(F.col("want") == F.col("s.cls"))
                       .groupBy(F.col("want").alias("cls")).agg(F.first("s.hashes").alias("hashes")))


def _both_sets(pairs: DataFrame, a: str, b: str, sets: DataFrame) -> DataFrame:
    one = sets.select(F.col("cls").alias(a), F.col("hashes").alias("ha"))
    two = sets.select(F.col("cls").alias(b), F.col("hashes").alias("hb"))
    return pairs.join(one, a).join(two, b)


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs whose full sets reach the threshold, stored."""
    na, nb = F.length("ha") / 8, F.length("hb") / 8
    done = _both_sets(pairs, "a", "b", sets).select("a", "b", (na + nb).alias("all"), _common_udf()("ha", "hb").alias("i"))
    return materialize(done.filter(F.col("i") * 100 >= (F.col("all") - F.col("i")) * percent).select("a", "b"))


def _difference_udf():
    """Symmetric differences of two columns of ascending uint64 sets, in three
    parts: hashes of the second set alone, then the low and the high half of the
    first's alone; and where these parts end."""
    half = np.uint64(1 << 63)

    @F.pandas_udf("d array<long>, ends array<int>")
    def difference(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        d, ends = [], []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            own, lost = np.setdiff1d(y, x, assume_unique=True), np.setdiff1d(x, y, assume_unique=True)
            d.append(np.concatenate((own, lost)).view(np.int64))
            ends.append(np.array([len(own), len(own) + np.searchsorted(lost, half), len(own) + len(lost)], np.int32))
        return pd.DataFrame({"d": d, "ends": ends})
    return difference


def _by_differences(star: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes around one centre, of different components, that
    may be linked (see the module text, 2). ``star``: (c, x, root, far)."""
    k = (100 - percent) / (100 + percent)
    made = _both_sets(star, "c", "x", sets).select(
        "c", "x", "root", "far", (F.length("ha") / 8).alias("nc"), (F.length("hb") / 8).alias("n"),
        _difference_udf()("ha", "hb").alias("s"))
    made = made.select("c", "x", "root", "far", "nc", "n", "s.d", "s.ends", F.col("s.ends")[2].alias("size"))
    size = F.col("size")
    # least number of hashes shared with any partner, and with one that is not linked with the centre
    any_way = F.greatest(F.ceil(size - k * F.col("n") * (1 + 100 / percent) - 1e-6), F.lit(1))
    with_far = F.greatest(F.floor((size + k * (F.col("nc") - F.col("n"))) / 2) + 1, any_way)
    made = made.withColumns({"index_to": size - with_far + 1, "probe_to": (size - any_way + 1).cast("int")})
    # the parts are whole stretches of the order: those behind the last place of use are left out
    used = F.array_min(F.filter("ends", lambda e: e >= F.col("probe_to")))
    made = materialize(made.select("c", "x", "root", "far", "n", "size", "index_to", "probe_to", "ends", F.slice("d", F.lit(1), used).alias("d")))
    e, p = F.col("ends"), F.col("p")
    end = F.when(p < e[0], e[0]).when(p < e[1], e[1]).otherwise(e[2])
    hashes = made.select("c", "x", "root", "far", "ends", F.posexplode("d").alias("p", "h"))
    hashes = hashes.select("c", "x", "root", "far", "h", end.alias("end"))
    # in a part, hashes that no pair of interest can share come first and are met by nobody: their number is the offset of the others
    often = (hashes.groupBy("c", "h").agg(F.count("*").alias("often"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("far").alias("asked"))
             .filter("asked AND lo <> hi").select("c", "h", "often"))
    seen = hashes.join(often, ["c", "h"])
    mine = Window.partitionBy("c", "x", "end")
    nth = F.row_number().over(mine.orderBy("often", "h"))
    ranked = seen.select("c", "x", "h", (F.col("end") - F.count("*").over(mine) + nth).alias("place"))
    hashes = materialize(ranked.join(made.drop("d", "ends"), ["c", "x"]).filter("place <= probe_to"))
    index = hashes.filter("place <= index_to").select("c", "h", "x", "n", "root", "size", "place")
    probe = hashes.filter("far").select("c", "h", *[F.col(v).alias(f"{v}2") for v in ("x", "n", "root", "size", "place")])
    # the first hash that two classes share is at most this far down in both
    need = F.greatest((F.col("size") + F.col("size2") - k * (F.col("n") + F.col("n2"))) / 2 - 1e-6, F.lit(1))
    fits = (F.col("place") <= F.col("size") - need + 1) & (F.col("place2") <= F.col("size2") - need + 1)
    met = index.join(probe, ["c", "h"]).filter(
        (F.col("root") != F.col("root2")) & _sizes_allow(F.col("n"), F.col("n2"), percent) & fits)
    return met.select(*_ordered("x", "x2")).distinct()


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def near_duplicate_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``df``: ``id``, ``key`` (text digest), ``n``
    (shingles), ``root`` (the group, NULL for a text without words) and
    ``component_id`` (smallest id in the group).

    Defined cases: NULL and word-less texts have no shingles and are groups of
    their own; equal texts are always one group; a NULL id is no smallest id
    unless the group has no other; rows that repeat an id are rows of their own.
    """
    docs = df.select(R.quoted(id_col).alias("id"), R.quoted(text_col).alias("text"))
    made = docs.select("id", R.digest(F.col("text")).alias("key"), _sketch_udf(words)("text").alias("s"))
    base = materialize(made.select("id", "key", "s.cls", "s.n", "s.sketch", "s.runs"))
    members = base.select("id", "key", "cls", "n")
    classes = materialize(base.filter("n > 0").groupBy("cls").agg(
        F.min("id").alias("head"), F.count("*").alias("copies"), F.first("n").alias("n"),
        F.first("sketch").alias("sketch"), F.first("runs").alias("runs")))

    posts = classes.select("cls", "n", "copies", F.explode("runs").alias("run"))
    # stored, so that a join of two plain tables meets a hot run, which adaptive execution can split
    sizes = materialize(posts.groupBy("run").agg(F.count("*").alias("m")).filter("m > 1"))
    lists = materialize(posts.join(sizes, "run"))

    short = lists.filter(F.col("m") <= LIST).select("run", "cls", "n")
    other = short.select("run", F.col("cls").alias("cls2"), F.col("n").alias("n2"))
    in_short = (short.join(other, "run").filter((F.col("cls") < F.col("cls2")) & _sizes_allow(F.col("n"), F.col("n2"), percent))
                .select(F.col("cls").alias("a"), F.col("cls2").alias("b")))

    hot = lists.filter(F.col("m") > LIST)
    warm = hot.groupBy("cls").agg(F.count("*").alias("hot_runs"))
    runs_of = classes.select("cls", F.size("runs").alias("all_runs"))
    shares = warm.join(runs_of, "cls").select("cls", (F.col("hot_runs") / F.col("all_runs")).alias("share"))
    long = materialize(hot.join(shares, "cls").select("run", "cls", "share", "copies"))
    centre = materialize(long.groupBy("run").agg(F.max(F.struct("share", "copies", "cls")).alias("top")).select("run", F.col("top.cls").alias("c")))
    star = materialize(long.join(centre, "run").filter(F.col("cls") != F.col("c")).select("c", F.col("cls").alias("x")).distinct())

    pairs = materialize(_candidates(in_short.distinct(), classes, percent).union(star.select(*_ordered("c", "x"))).distinct())
    sets = _full_sets(pairs, classes, docs, words)
    links = _links(pairs, sets, percent)
    roots = connected_components(links)

    # centres whose members are still in several components
    root_of = roots.select(F.col("node").alias("x"), "root")
    near = links.select(F.col("a").alias("c"), F.col("b").alias("x")).union(links.select(F.col("b").alias("c"), F.col("a").alias("x")))
    placed = (star.join(near.withColumn("near", F.lit(True)), ["c", "x"], "left").join(root_of, "x", "left")
              .select("c", "x", F.coalesce("root", "x").alias("root"), F.col("near").isNull().alias("far")))
    several = placed.groupBy("c").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("c")
    part = materialize(placed.join(several, "c", "left_semi"))
    if not part.isEmpty():
        more = _by_differences(part, sets, percent).join(pairs, ["a", "b"], "left_anti")
        late = _links(materialize(_candidates(more, classes, percent)), sets, percent)
        if not late.isEmpty():
            roots = connected_components(links.union(late))

    known = classes.select("cls", "head", "copies").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    named = known.filter(F.col("root").isNotNull() | (F.col("copies") > 1)).select(
        "cls", "head", F.coalesce("root", "cls").alias("root"))
    least = named.groupBy("root").agg(F.min("head").alias("least"))
    named = named.select("cls", "root").join(least, "root")
    out = members.join(named, "cls", "left")
    return out.select("id", "key", "n", F.coalesce("root", "cls").alias("root"),
                      F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``df``: ``id_col``, ``n_shingles``, ``component_id``
    and ``kept`` (the row's id is the group's smallest)."""
    g = near_duplicate_groups(df, id_col, text_col, words, percent)
    return g.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
                    F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         words: int = 5, percent: int = 80) -> DataFrame:
    """``df`` with one row of each group (smallest id, then text digest; of
    rows that repeat both, the smallest whole row). Texts without words stay."""
    columns = df.columns
    g = materialize(near_duplicate_groups(df, id_col, text_col, words, percent))
    mine = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    stays = g.filter("root IS NOT NULL").groupBy("root").agg(
        F.min(mine).alias("stay"), F.count("*").alias("size")).filter("size > 1")
    grouped = g.join(stays, "root").select("id", "key", "stay")
    same_id = F.col("id").eqNullSafe(F.col("stay.id")) & (F.col("key") == F.col("stay.key"))
    gone = grouped.filter(~same_id).select(F.col("id").alias("gid"), F.col("key").alias("gkey")).distinct()
    twice = materialize(grouped.filter(same_id).groupBy(F.col("id").alias("gid"), F.col("key").alias("gkey"))
                        .agg(F.count("*").alias("c")).filter("c > 1"))
    rows = R.pack(df, id=R.quoted(id_col), key=R.digest(R.quoted(text_col)))
    is_row = F.col("id").eqNullSafe(F.col("gid")) & (F.col("key") == F.col("gkey"))
    left = rows.join(gone, is_row, "left_anti")
    if not twice.isEmpty():
        again = left.join(twice, is_row, "left_semi").groupBy("id", "key").agg(F.min(R.ROW).alias(R.ROW))
        left = left.join(twice, is_row, "left_anti").unionByName(again)
    return R.unpack(left, columns)

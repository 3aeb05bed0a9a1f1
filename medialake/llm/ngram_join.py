"""N-gram Jaccard join (operator 13): a token-group matrix.

Tokens are the 64-bit hashes of a document's distinct word shingles. Documents
with equal token sets form a class; the work is on classes.

1. Groups. Similar classes are partitioned into groups: a class posts the runs of
   three adjacent values among its smallest tokens, and is compared with the
   centre of each of its runs' lists, the class whose runs are most common. Real
   links with centres, closed by connected components, are the groups. A list of
   any length costs one pair per member, never all its pairs.
2. Matrix. The distinct (token, group) rows are the token unions of the groups;
   those of groups of several members that a query meets are stored.
3. Bound. A class q and a member m with at most as many tokens need
   ``need = p (|q| + |m|) / (100 + p)`` common tokens. Tokens are ordered by the
   number of classes that have them, rarest first, then by hash. Then the first
   token that q and m share is among the first |q| - p |q| / 100 + 1 of q and the
   first |m| - 2 p |m| / (100 + p) + 1 of m; equal ones of these lead from a class
   to other groups, if the tokens behind them in both can make up ``need``. A
   group of several members stays a candidate of q if their overlap in the matrix
   can reach ``need`` for the group's smallest member that fits.
4. Open. Only members of those groups that meet q in such a token, at places
   that leave enough common tokens behind them, are compared on whole sets.

This loses no link between different groups, whatever the groups are; links
inside a group change no component.

Sets of more than ``SMALL`` tokens, most of a corpus, are thinned first: they
enter with the tokens whose hash is below a fixed fraction (at least as many as
the places above need), in an order that puts these first, which is as good as
any other. Those that have none of their first tokens in common with another
group have no link to one. The rest, and all small sets, go through steps 2 to 4
with all tokens: edited copies of one text share most tokens, but each has
enough of its own to keep the shared ones out of its first places. Two bands of
sizes overlap by one whole similarity range, so each pair that can be linked is
thinned as a pair or not at all.

All intermediate tables are stored under the shared checkpoint folder. Joins on
tokens, the possibly hot keys, are between stored tables, which lets adaptive
execution split them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medialake.llm import rows as R
from medialake.llm import shingles as S
from medialake.llm.components import connected_components
from medialake.session import materialize

#: Smallest tokens whose runs make groups, and the length of a run.
LOWEST, RUN = 10, 3
#: Bytes of a list of classes that is sent to all tasks.
SENT = 1 << 25
#: Texts whose sets a worker holds at once.
TEXTS = 256
#: Sets up to this size take part with all tokens, larger ones with 1 / PART of the hash range.
SMALL, PART = 128, 4
_CUT = np.uint64((1 << 64) // PART)


def _ceil_div(a, b: int):
    return -((-a) // b)


def _runs(s: np.ndarray) -> np.ndarray:
    """Hashes of the runs of adjacent values among the smallest tokens; a set
    with fewer tokens than a run is a run of its own."""
    v = s[:LOWEST]
    r = min(RUN, len(v))
    h = np.full(len(v) - r + 1, r, np.uint64)
    for i in range(r):
        h = S.mix(h * np.uint64(0x9E3779B97F4A7C15) + v[i:len(v) - r + 1 + i])
    return np.unique(h)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([x.view(np.int64) for x in arrays])))


def _with_sets(df: DataFrame, words: int, columns: str, make) -> DataFrame:
    """The columns of ``df`` but ``text``, and those that ``make`` derives from a
    list of token sets. Texts are taken ``TEXTS`` at a time, so a worker holds the
    sets of so many texts only, however many rows Spark hands over at once."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                made = make([S.shingle_set(t, words) for t in part.column("text").to_pylist()])
                kept = {c: part.column(c) for c in part.schema.names if c != "text"}
                yield pa.RecordBatch.from_pydict({**kept, **made})

    carried = T.StructType([f for f in df.schema.fields if f.name != "text"])
    return df.mapInArrow(run, T.StructType(carried.fields + T.StructType.fromDDL(columns).fields))


def _digests(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([S.set_digest(s) if len(s) else None for s in sets], pa.binary())


def _class_tokens(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Class digest, number of tokens, runs, the tokens of the two bands (empty
    where a set has no part in one), and how many of the large band's are below
    the cut."""
    none = np.empty(0, np.uint64)

    def make(sets):
        small, large, low = [], [], []
        for s in sets:
            n = len(s)
            small.append(s if n <= _ceil_div(SMALL * 100, percent) else none)
            low.append(int(np.searchsorted(s, _CUT)))
            most = n - _ceil_div(n * percent, 100) + 1  # places of a query
            large.append(s[:max(low[-1], most)] if n > SMALL else none)
        return {"cls": _digests(sets), "n": pa.array([len(s) for s in sets], pa.int64()), "runs": _lists([_runs(s) if len(s) else none for s in sets]),
                "small": _lists(small), "large": _lists(large), "low": pa.array(low, pa.int64())}

    return _with_sets(docs, words, "cls binary, n long, runs array<long>, small array<long>, large array<long>, low long", make)


def _up(a: Column, b: int) -> Column:
    """a / b, rounded up."""
    return F.floor((a + (b - 1)) / b)


def _need(a: Column, b: Column, percent: int) -> Column:
    """Least number of common tokens of linked sets of sizes a and b."""
    return _up((a + b) * percent, 100 + percent)


def _fits(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _whole_sets(wanted: DataFrame, classes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(k, tokens) of the classes ``wanted`` (k), stored. The sets are made again,
    from one text of each of these classes; the texts are not shuffled if the
    list of classes is small enough to be sent to them."""
    heads = materialize(wanted.distinct().join(classes.select("k", "cls", "head"), "k")
                        .select("k", F.col("cls").alias("want"), F.col("head").alias("id0")))
    held = heads.agg((F.count(F.lit(1)) * 64 + F.coalesce(F.sum(F.length(F.col("id0").cast("string"))), F.lit(0))).alias("b")).first()["b"]
    texts = docs.join(F.broadcast(heads) if held <= SENT else heads, F.col("id").eqNullSafe(F.col("id0")))
    made = _with_sets(texts.select("k", "want", "text"), words, "cls binary, tokens array<long>",
                      lambda sets: {"cls": _digests(sets), "tokens": _lists(sets)})
    return materialize(made.filter(F.col("want") == F.col("cls")).select("k", "tokens").dropDuplicates(["k"]))


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of class numbers whose whole sets reach the threshold, stored."""
    one, two = sets.select(F.col("k").alias("a"), F.col("tokens").alias("ta")), sets.select(F.col("k").alias("b"), F.col("tokens").alias("tb"))
    done = pairs.join(one, "a").join(two, "b").select("a", "b", (F.size("ta") + F.size("tb")).alias("size"),
                                                      F.size(F.array_intersect("ta", "tb")).alias("common"))
    return materialize(done.filter(F.col("common") * 100 >= (F.col("size") - F.col("common")) * percent).select("a", "b"))


def _to_centres(classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of each class with the centres of its runs' lists, stored."""
    posts = classes.select("k", "n", "copies", F.explode("runs").alias("run"))
    lists = materialize(posts.groupBy("run").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"))
    posts = materialize(posts.join(lists, "run"))
    common = posts.groupBy("k").agg(F.sum("m").alias("common"))
    posts = materialize(posts.join(common, "k").select("run", "k", "n", F.struct("common", "copies", F.negative("k").alias("k")).alias("rank")))
    top = materialize(posts.groupBy("run").agg(F.max(F.struct("rank", "n")).alias("top")).select(
        "run", F.negative(F.col("top.rank.k")).alias("c"), F.col("top.n").alias("nc")))
    near = posts.join(top, "run").filter((F.col("k") != F.col("c")) & _fits(F.col("n"), F.col("nc"), percent))
    return materialize(near.select(F.least("k", "c").alias("a"), F.greatest("k", "c").alias("b")).distinct())


def _placed_tokens(sets: DataFrame, band: DataFrame, cut: bool = False) -> DataFrame:
    """(q, g, n, t, place): the tokens of a band (k, tokens, low) that another
    class has too, with their place in the class's order. Tokens of one class
    only come first and are just counted. Tokens above the cut come last, by
    hash: they matter only where a set has too few below it, and shares none of
    these."""
    t = F.col("t")
    first = (t >= 0) & (t < F.lit(int(_CUT))) if cut else F.lit(True)
    one = band.select("k", F.explode("tokens").alias("t"))
    often = materialize(one.groupBy("t").agg(F.count(F.lit(1)).alias("often")).filter("often > 1"))
    about = sets.join(band.select("k", "low"), "k")
    mine = Window.partitionBy("k")
    order = mine.orderBy((~first).alias("late"), F.when(first, F.col("often")).otherwise(0), "t")
    place = F.col("low") - F.count_if(first).over(mine) + F.row_number().over(order)
    shared = materialize(one.join(often, "t")).join(about, "k")
    return materialize(shared.select(F.col("k").alias("q"), "g", "n", "t", place.alias("place")))


def _first_tokens(tokens: DataFrame, percent: int) -> DataFrame:
    """The tokens among the first of a class as a query, with ``indexed``: also
    among the first as a member."""
    n, place = F.col("n"), F.col("place")
    return tokens.filter(place <= n - _up(n * percent, 100) + 1).withColumn("indexed", place <= n - _need(n, n, percent) + 1)


def _may_meet(sets: DataFrame, band: DataFrame, percent: int) -> DataFrame:
    """(k): the large classes that have one of their first tokens in common with
    another group, as far as the tokens below the cut tell. All others have no
    link to another group."""
    first = _first_tokens(_placed_tokens(sets, band, cut=True), percent)
    met = materialize(first.groupBy("t").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.max("indexed").alias("any"))
                      .filter("lo <> hi AND any").select("t"))
    return materialize(first.join(met, "t").select(F.col("q").alias("k")).distinct())


def _across(sets: DataFrame, band: DataFrame, percent: int) -> DataFrame:
    """Pairs of linked classes of different groups, stored. ``band``: (k, tokens,
    low) with all tokens of every class that may have such a link."""
    tokens = _placed_tokens(sets, band)
    n, place = F.col("n"), F.col("place")
    least = _up(n * percent, 100)  # tokens of the smallest partner, and common ones with it
    first = _first_tokens(tokens, percent)
    index = first.filter("indexed")
    # the groups that have a token among the first of some member, and the most tokens that such a member has behind it
    listed = materialize(index.groupBy("t", F.col("g").alias("h")).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(n - place).alias("rest")))
    met = first.join(listed, "t").filter((F.col("g") != F.col("h")) & (F.col("low") <= n) & (F.col("high") >= least)
                                         & (F.least(n - place, F.col("rest")) + 1 >= _need(n, F.greatest("low", least), percent)))
    about = materialize(index.groupBy(F.col("g").alias("h")).agg(F.min("n").alias("low"), (F.min("q") == F.max("q")).alias("alone")))
    met = materialize(met.select("q", "h", "n").distinct().join(about, "h"))

    # a group of one member is its own best bound: it is compared at once
    several = met.filter(~F.col("alone"))
    matrix = materialize(tokens.select(F.col("g").alias("h"), "t").join(several.select("h").distinct(), "h", "left_semi").distinct())
    both = several.select("q", "h").join(tokens.select("q", "t"), "q").join(matrix, ["h", "t"])
    found = materialize(both.groupBy("q", "h").agg(F.count(F.lit(1)).alias("found")).join(several, ["q", "h"]))
    opened = found.filter(F.col("found") >= _need(n, F.greatest("low", least), percent)).select("q", "h")
    opened = materialize(opened.union(met.filter("alone").select("q", "h")))

    asked = opened.join(first.drop("g", "indexed"), "q")
    members = index.select("t", F.col("g").alias("h"), F.col("q").alias("m"), F.col("n").alias("nm"), F.col("place").alias("place_m"))
    need = _need(n, F.col("nm"), percent)
    pairs = asked.join(members, ["h", "t"]).filter(
        (F.col("nm") <= n) & (F.col("nm") >= least) & (place <= n - need + 1) & (F.col("place_m") <= F.col("nm") - need + 1))
    pairs = materialize(pairs.select(F.least("q", "m").alias("a"), F.greatest("q", "m").alias("b")).distinct())
    return _linked(pairs, band, percent)


def jaccard_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``df``: ``id_col``, ``n_shingles`` (size of the set) and
    ``component_id``, the smallest id that links reach. Two documents are linked
    if 100 * common shingles >= ``percent`` * shingles of either.

    Defined cases: NULL, empty and word-less texts have no shingles and are
    components of their own; a text with fewer words than a shingle is one
    shingle; equal sets are always linked; a NULL id is no smallest id unless
    its component has no other; rows that repeat an id are rows of their own; an
    empty table gives no rows. Texts of any length count whole. Other columns
    are ignored."""
    docs = df.select(R.quoted(id_col).alias("id"), R.quoted(text_col).cast("string").alias("text"))
    base = materialize(_class_tokens(docs, words, percent))
    members = base.select("id", "cls", "n")
    classes = materialize(base.filter("n > 0").groupBy("cls").agg(
        F.min("id").alias("head"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("n", "runs", "small", "large", "low")])
        .withColumn("k", F.monotonically_increasing_id()))
    near = _to_centres(classes, percent)
    links = _linked(near, _whole_sets(near.select(F.col("a").alias("k")).union(near.select("b")), classes, docs, words), percent)
    roots = connected_components(links)
    sets = materialize(classes.select("k", "n").join(roots.withColumnRenamed("node", "k"), "k", "left")
                       .select("k", "n", F.coalesce("root", "k").alias("g")))
    small = classes.filter("size(small) > 0").select("k", F.col("small").alias("tokens"), F.col("n").alias("low"))
    large = classes.filter("size(large) > 0").select("k", F.col("large").alias("tokens"), "low")
    whole = _whole_sets(_may_meet(sets, large, percent).join(small, "k", "left_anti"), classes, docs, words)
    late = _across(sets, small.union(whole.select("k", "tokens", F.size("tokens").cast("long"))), percent)
    if not late.isEmpty():
        roots = connected_components(links.union(late))

    # a class of its own is a component of its own
    named = classes.select("cls", "head", "copies", "k").join(roots.withColumnRenamed("node", "k"), "k", "left").filter(
        F.col("root").isNotNull() | (F.col("copies") > 1)).select("cls", "head", F.coalesce("root", "k").alias("root"))
    named = materialize(named)
    least = named.groupBy("root").agg(F.min("head").alias("least"))
    known = materialize(named.join(least, "root").select("cls", F.col("least"), F.lit(True).alias("known")))
    out = members.join(known, "cls", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.when(F.col("known"), F.col("least")).otherwise(F.col("id")).alias("component_id"))

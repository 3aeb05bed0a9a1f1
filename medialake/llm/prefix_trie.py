"""Conversation prefix trie (operator 12): truncation peeling.

A node is a distinct sequence of first turns. Each conversation carries its path,
one piece per turn: a 128-bit hash of the whole prefix up to that turn and the
length of the turn's text. Equal paths become one row with its members. From the
deepest level up, the conversations that end at a level are merged with the rows
that came up from the level below, grouped by path: these are the level's nodes,
with all counts of their subtrees. Then the last piece is cut off and the rows
are grouped again one level higher.

Rows are combined before each shuffle, so a first turn shared by any number of
conversations is no hot key. Levels that only few conversations reach
(``DEEP_ROWS`` rows and ``DEEP_TURNS`` turns at most) are peeled in one job
instead of one each: dealt by their prefix at the last common level, tasks peel
them in memory by the same rule. A level above these is one Spark job, however
many rows it has.

The members that end at a node are hashed in order without gathering them: ids
are range-partitioned by (node, id), joined to short texts where they lie, and a
node's texts are streamed through SHA-256 in ascending order.
"""

from __future__ import annotations

import hashlib
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake.llm import rows as R
from medialake.session import materialize

#: Bytes of a path piece: prefix hash and text length.
HASH, PIECE = 16, 20
#: Rows and turns that are peeled in one job, below the last level with more.
DEEP_ROWS, DEEP_TURNS = 1024, 2_000_000
#: Ids per text on the way to a node's hash of members.
IDS = 256
_NODE = "key binary, parent binary, depth int, path binary, first long, n long, children long, leaves long, saved long"


def turns_by_conversation(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                          text_col: str = "text") -> DataFrame:
    """(id, turns): a conversation's turns in order, each with the hash of its
    role and text and the length of its text. NULL turns come first; NULL roles
    and texts are empty; equal turn numbers are ordered by role, then hash."""
    role = F.coalesce(R.quoted(role_col).cast("string"), F.lit(""))
    text = F.coalesce(R.quoted(text_col).cast("string"), F.lit(""))
    # the role's length keeps (role, text) apart from every other split of the same characters
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turn = F.struct(R.quoted(turn_col).alias("turn"), role.alias("role"), digest.alias("h"), F.length(text).alias("chars"))
    got = df.select(R.quoted(id_col).alias("id"), turn.alias("t")).groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return got.select("id", F.transform("t", lambda t: F.struct(t["h"].alias("h"), t["chars"].alias("chars"))).alias("turns"))


def with_shared_starts(convs: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Conversation c gets the first ``h`` turns of conversation c - c % every in
    place of its own first ``h``, h = crc32(decimal c) % most. All of them if
    that one has fewer, none if it does not exist. A NULL id keeps its turns."""
    h = F.coalesce((F.crc32(F.col("id").cast("string").cast("binary")) % most).cast("int"), F.lit(0))
    base = F.col("id") - F.col("id") % every
    starts = convs.filter(F.col("id") % every == 0).select(F.col("id").alias("base"), F.slice("turns", 1, most).alias("start"))
    own = convs.select("id", "turns", h.alias("h"), base.alias("base"))
    joined = own.join(starts, "base", "left")
    first = F.slice(F.coalesce("start", F.array().cast(convs.schema["turns"].dataType)), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return joined.select("id", F.concat(first, rest).alias("turns"))


def _path_udf():
    """The pieces of all prefixes of a conversation, one after another."""
    @F.pandas_udf("binary")
    def paths(hashes: pd.Series, chars: pd.Series) -> pd.Series:
        out = []
        for hs, ns in zip(hashes, chars):
            at, path = b"", bytearray()
            for h, n in zip(hs, ns):
                at = hashlib.md5(at + h).digest()
                path += at + struct.pack(">I", n)
            out.append(bytes(path))
        return pd.Series(out, dtype=object)
    return paths


def _piece(path: Column, depth) -> Column:
    """The piece of a depth (1 ...) of a path; empty at depth 0."""
    d = F.lit(depth) if isinstance(depth, int) else depth
    return F.when(d <= 0, F.lit(b"")).otherwise(F.substring(path, (d - 1) * PIECE + 1, F.lit(PIECE)))


def _chars(piece: Column) -> Column:
    """The text length in a piece; 0 for the root's."""
    return F.coalesce(F.conv(F.hex(F.substring(piece, HASH + 1, 4)), 16, 10).cast("long"), F.lit(0).cast("long"))


def _deep_nodes(rows: DataFrame, above: int) -> DataFrame:
    """Nodes deeper than ``above`` of the few paths that reach there. ``rows``:
    (path, first, n). Only nodes of depth ``above + 1`` keep their path."""
    def peel(pdf: pd.DataFrame) -> pd.DataFrame:
        ended: dict = {}
        for path, first, n in zip(pdf["path"], pdf["first"], pdf["n"]):
            ended.setdefault(len(path) // PIECE, []).append((path, first, n))
        out, up = [], {}
        for d in range(max(ended), above, -1):
            level = up
            for path, first, n in ended.get(d, ()):
                node = level.setdefault(path[(d - 1) * PIECE:d * PIECE], [path, None, 0, 0, 0, 0])
                node[1], node[2] = _least(node[1], first), node[2] + n
            up = {}
            for key, (path, first, n, children, leaves, saved) in level.items():
                leaves, saved = max(leaves, 1), saved + (n - 1) * struct.unpack(">I", key[HASH:])[0]
                parent = path[(d - 2) * PIECE:(d - 1) * PIECE] if d > 1 else b""
                out.append((key, parent, d, path[:d * PIECE] if d == above + 1 else b"", first, n, children, leaves, saved))
                node = up.setdefault(parent, [path, None, 0, 0, 0, 0])
                node[1] = _least(node[1], first)
                for i, v in ((2, n), (3, 1), (4, leaves), (5, saved)):
                    node[i] += v
        names = [c.split()[0] for c in _NODE.split(", ")]
        return pd.DataFrame(out, columns=names).astype({"first": "Int64"})

    return rows.groupBy(_piece(F.col("path"), above)).applyInPandas(peel, _NODE)


def _least(a, b):
    if b is None or b != b or b is pd.NA:
        return a
    return int(b) if a is None else min(a, int(b))


def _peel(ended: DataFrame, depth: int, below: DataFrame | None) -> DataFrame:
    """The nodes of a level: conversations that end there, and the nodes one
    level deeper without their last turn."""
    zero = F.lit(0).cast("long")
    rows = ended.filter(F.col("depth") == depth).select("path", "first", "n", *[zero.alias(c) for c in ("children", "leaves", "saved")])
    if below is not None:
        up = below.select(F.substring("path", 1, depth * PIECE).alias("path"), "first", "n", F.lit(1).cast("long").alias("children"), "leaves", "saved")
        rows = rows.unionAll(up)
    merged = rows.groupBy("path").agg(F.min("first").alias("first"), *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")])
    key = _piece(F.col("path"), depth)
    return merged.select(key.alias("key"), _piece(F.col("path"), depth - 1).alias("parent"), F.lit(depth).alias("depth"), "path", "first", "n",
                         "children", F.greatest("leaves", F.lit(1)).alias("leaves"),
                         (F.col("saved") + (F.col("n") - 1) * _chars(key)).alias("saved"))


def _nodes(ended: DataFrame) -> list[DataFrame]:
    """All nodes, stored level by level. ``ended``: (path, depth, first, n)."""
    lengths = {r["depth"]: r["rows"] for r in ended.groupBy("depth").agg(F.count(F.lit(1)).alias("rows")).collect()}  # a row per length
    if not lengths:
        return []
    top = deep = max(lengths)
    rows = turns = 0
    while deep > 1 and rows + lengths.get(deep, 0) <= DEEP_ROWS and turns + deep * lengths.get(deep, 0) <= DEEP_TURNS:
        rows, turns, deep = rows + lengths.get(deep, 0), turns + deep * lengths.get(deep, 0), deep - 1
    done, below = [], None
    if deep < top:
        done.append(materialize(_deep_nodes(ended.filter(F.col("depth") > deep).select("path", "first", "n"), deep)))
        below = done[0].filter(F.col("depth") == deep + 1)
    for d in range(deep, -1, -1):
        below = materialize(_peel(ended, d, below))
        done.append(below)
    return done


def _member_hashes(members: DataFrame) -> DataFrame:
    """(key, ends): SHA-256 of the ascending decimal ids of each key, joined by
    commas. ``members``: (key, id), stored."""
    def texts(batches):
        key, low, ids = None, None, []
        for pdf in batches:
            out = []
            for k, i in zip(pdf["key"], pdf["id"]):
                if k != key or len(ids) == IDS:
                    if ids:
                        out.append((key, low, ",".join(ids)))
                    key, low, ids = k, i, []
                ids.append("" if i is None else i)
            if out:
                yield pd.DataFrame(out, columns=["key", "low", "text"])
        if ids:
            yield pd.DataFrame([(key, low, ",".join(ids))], columns=["key", "low", "text"])

    def digests(batches):
        key, state = None, None
        for pdf in batches:
            out = []
            for k, text in zip(pdf["key"], pdf["text"]):
                if k != key:
                    if state is not None:
                        out.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.encode())
            if out:
                yield pd.DataFrame(out, columns=["key", "ends"])
        if state is not None:
            yield pd.DataFrame([(key, state.hexdigest())], columns=["key", "ends"])

    spread = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_order = members.repartitionByRange(spread, "key", "id").sortWithinPartitions("key", "id")
    # ids travel as text: a nullable whole number would become a float
    parts = in_order.select("key", F.col("id").cast("string").alias("id")).mapInPandas(texts, "key binary, low string, text string")
    streams = parts.repartition(spread, "key").sortWithinPartitions("key", F.col("low").cast("long"))
    return streams.select("key", "text").mapInPandas(digests, "key binary, ends string")


def prefix_trie(convs: DataFrame) -> DataFrame:
    """One row per node: ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id`` (the parent's ``conv_id``, NULL for the root), ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``; see
    :func:`conversation_trie`. ``convs``: (id, turns), one row a conversation."""
    paths = materialize(convs.select("id", _path_udf()("turns.h", "turns.chars").alias("path")))
    depth = (F.length("path") / PIECE).cast("int")
    ended = materialize(paths.groupBy("path").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).withColumn("depth", depth))
    levels = _nodes(ended)
    key = _piece(F.col("path"), depth)
    ends = materialize(_member_hashes(paths.select(key.alias("key"), "id")))
    if not levels:
        return ended.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
                                                      "n_leaves long, saved_tokens long, ends_sha256 string")
    columns = ["key", "parent", "depth", "first", "n", "children", "leaves", "saved"]
    nodes = levels[0].select(*columns)
    for level in levels[1:]:
        nodes = nodes.unionAll(level.select(*columns))
    nodes = materialize(nodes.join(ends, "key", "left"))
    above = nodes.filter("children > 0").select(F.col("key").alias("parent"), (F.col("depth") + 1).alias("depth"), F.col("first").alias("up"))
    nodes = nodes.join(above, ["parent", "depth"], "left")
    none = F.lit(hashlib.sha256().hexdigest())
    return nodes.select(F.col("first").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("up").alias("parent_conv_id"),
                        F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
                        F.col("saved").alias("saved_tokens"), F.coalesce("ends", none).alias("ends_sha256"))


def conversation_trie(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                      text_col: str = "text", every: int = 100, most: int = 6) -> DataFrame:
    """The prefix trie of all conversations, rebuilt with shared starts.

    ``n_convs`` counts the members of a node (conversations that start with it),
    ``n_children`` its child nodes, ``n_leaves`` the childless nodes of its
    subtree, ``saved_tokens`` sums (members - 1) * code points of the last text
    over its subtree, and ``ends_sha256`` hashes the ascending ids of the
    conversations that end there (the empty text's hash if none does).

    Defined cases: NULL roles and texts are empty, NULL turns come first, equal
    turn numbers are ordered by role and hash, a repeated row is a turn of its
    own. Rows without an id are one conversation, which keeps its turns and is no
    smallest member of a node that has another; its id is hashed as an empty
    text. An empty table has no nodes, not even a root. A conversation must fit
    one task (about 60 bytes a turn). Other columns are ignored."""
    convs = materialize(turns_by_conversation(df, id_col, turn_col, role_col, text_col))
    return prefix_trie(with_shared_starts(convs, every, most))

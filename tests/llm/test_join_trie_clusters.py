"""N-gram Jaccard join, conversation prefix trie, centroid clustering: against
brute force, with NULLs, ties, empty tables, long texts and clashing names."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from medialake.llm import clustering, ngram_join, prefix_trie
from tests.llm.test_near_dup import DOC, family, shingle_model

VEC = "vec_id bigint, embedding array<float>"
TURN = "conv_id bigint, turn bigint, role string, text string"


# ---- n-gram Jaccard join ----

def components_model(rows, n, percent):
    sets = [shingle_model(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def joined(spark, rows, n=3, percent=90):
    got = ngram_join.jaccard_groups(spark.createDataFrame(rows, DOC), words=n, percent=percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.mark.parametrize("percent", [80, 90])
def test_join_matches_brute_force(spark, percent):
    """Families around the threshold, in both size bands and across their border."""
    rnd = random.Random(percent)
    rows, passage = [], " ".join(f"p{i}" for i in range(40))
    for size, words, edits in ((12, 30, 1), (12, 130, 3), (10, 150, 4), (8, 400, 8), (6, 900, 20)):
        base = [f"v{rnd.randint(0, 3000)}" for _ in range(words)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rnd.randint(0, edits)):
                copy[rnd.randrange(len(copy))] = f"e{rnd.randint(0, 10 ** 6)}"
            copy = copy[:len(copy) - rnd.randint(0, words // 15)]
            rows.append((len(rows), " ".join(copy)))
    for i in range(20):  # a passage that many texts share
        rows.append((len(rows), passage + " " + " ".join(f"w{rnd.randint(0, 10 ** 6)}" for _ in range(rnd.randint(2, 60)))))
    rnd.shuffle(rows)
    assert joined(spark, rows, percent=percent) == components_model(rows, 3, percent)


def test_join_sites_with_shared_boilerplate(spark):
    """Families of one site share their boilerplate; only families are linked, and
    the pairs compared grow with the pages, not with their square."""
    compared = {}
    for m in (30, 120):
        rows = []
        for f in range(4):
            for p in range(m):
                words = [f"b{i}" for i in range(100)] + [f"f{f}_{i}" for i in range(60)] + [f"x{f}_{p}_{i}" for i in range(2)]
                rows.append((len(rows), " ".join(words)))
        got = joined(spark, rows)
        assert [len({c for d, _, c in got if d // m == f}) for f in range(4)] == [1] * 4
        assert len({c for _, _, c in got}) == 4
        docs = spark.createDataFrame(rows, DOC).withColumnRenamed("doc_id", "id")
        classes = ngram_join._class_tokens(docs, 3, 90).withColumn("copies", F.lit(1)).withColumnRenamed("id", "k")
        compared[m] = ngram_join._to_centres(classes, 90).count()
    assert compared[120] <= 5 * compared[30]


def test_join_edges(spark):
    long = " ".join(f"z{i % 9973}" for i in range(60_000))
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "One"), (9, "one"), (10, "one two"), (11, "ONE\x0btwo"), (12, "one two three"),
            (None, "one two three"), (None, "lonely text here now"), (13, "same id"), (13, "same id"), (13, "other text"),
            (3, long), (2, long + " end"), (14, "é É ß"), (15, "é É ß")]
    assert joined(spark, rows) == components_model(rows, 3, 90)
    assert joined(spark, []) == []
    named = spark.createDataFrame([(1, "a b c d", 7, 8), (2, "a b c d", 7, 8)], "doc_id int, text string, k int, `t.n` int")
    assert sorted(tuple(r) for r in ngram_join.jaccard_groups(named).collect()) == [(1, 1, 1), (2, 1, 1)]


def test_join_many_edited_copies(spark):
    """Copies that drift away from their origin form chains; none is lost."""
    rnd = random.Random(3)
    rows = family(rnd, 60, 160, 6, 0)
    assert joined(spark, rows, percent=85) == components_model(rows, 3, 85)


# ---- conversation prefix trie ----

def trie_model(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    convs = {c: [(r, t) for _, r, t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 6
        built[c] = (convs.get(c - c % 100, [])[:h] if h else []) + own[h:]
    nodes = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[:len(p)] == p]
        leaves = [q for q in below if not any(len(r) == len(q) + 1 and r[:len(q)] == q for r in nodes)]
        ids = [m for m in members if m is not None]
        up = [m for m in nodes[p[:-1]] if m is not None] if p else []
        ends = sorted((c for c in members if len(built[c]) == len(p)), key=lambda c: (c is not None, c or 0))
        out.append((min(ids, default=None), len(p), min(up, default=None), len(members),
                    sum(len(q) == len(p) + 1 for q in below), len(leaves), sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q),
                    hashlib.sha256(",".join("" if c is None else str(c) for c in ends).encode()).hexdigest()))
    return sorted(out, key=repr)


def trie(spark, rows):
    return sorted((tuple(r) for r in prefix_trie.conversation_trie(spark.createDataFrame(rows, TURN)).collect()), key=repr)


def chats(rnd, n, deep=7):
    rows = []
    for c in range(n):
        for t in range(rnd.randint(1, deep)):
            rows.append((c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["hi", "yes", "no", "", None, "ünï 🙂"])))
    return rows


def test_trie_matches_brute_force(spark):
    rnd = random.Random(12)
    rows = chats(rnd, 240) + [(c, t, "u", f"deep {t}") for c in (300, 301, 401) for t in range(25)]
    rnd.shuffle(rows)
    assert trie(spark, rows) == trie_model(rows)


def test_trie_level_jobs_and_one_job_agree(spark, monkeypatch):
    rnd = random.Random(13)
    rows = chats(rnd, 130, 5)
    whole = trie_model(rows)
    assert trie(spark, rows) == whole  # few: peeled in one job
    monkeypatch.setattr(prefix_trie, "DEEP_ROWS", 0)  # every level a job
    assert trie(spark, rows) == whole


def test_trie_edges(spark):
    rows = [(None, 1, "u", "x"), (None, None, "u", "y"), (7, None, None, None), (7, 0, "u", "b"), (7, 0, "u", "b"), (8, 3, "u", "same"),
            (9, 1, "us", "ersame"), (250, 5, "u", "z" * 100_000), (250, 6, "u", "q"), (-3, 0, "u", "x")]
    got = trie(spark, rows)
    model = trie_model([r for r in rows if r[0] != -3])
    assert trie(spark, [r for r in rows if r[0] != -3]) == model
    assert sum(r[1] == 0 for r in got) == 1 and max(r[3] for r in got) == 6
    assert trie(spark, []) == []
    # equal turn numbers: an order that does not depend on the order of rows
    tie = [(1, 0, "u", "a"), (1, 0, "u", "b"), (1, 0, "u", "c")]
    assert trie(spark, tie) == trie(spark, tie[::-1])
    clash = spark.createDataFrame([(1, 0, "u", "a", "k", 9)], TURN + ", path string, n int")
    assert prefix_trie.conversation_trie(clash).count() == 1 + max(0, 1 - zlib.crc32(b"1") % 6)


def test_member_hashes_of_large_groups(spark):
    """A node with more members than fit one text, over many partitions."""
    ids = list(range(-500, 1500))
    members = spark.createDataFrame([(b"a" if i % 3 else b"b", i) for i in ids], "key binary, id bigint").repartition(7)
    got = {bytes(r["key"]): r["ends"] for r in prefix_trie._member_hashes(members).collect()}
    for key, part in ((b"a", [i for i in ids if i % 3]), (b"b", [i for i in ids if not i % 3])):
        assert got[key] == hashlib.sha256(",".join(map(str, part)).encode()).hexdigest()


# ---- centroid clustering ----

def cluster_model(rows, dims, k, rounds, scale):
    def ok(x):
        return x is not None and x == x and abs(x) != float("inf")

    vecs = [(i, [int(x * scale // 1) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(map(ok, v))]
    first = sorted(vecs, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in first[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(cents))

    for _ in range(rounds):
        of = {}
        for _, v in vecs:
            of.setdefault(near(v)[1], []).append(v)
        cents = [[sum(x) // len(of[i]) for x in zip(*of[i])] if i in of else c for i, c in enumerate(cents)]
    done = [(i, *near(v)[::-1]) for i, v in vecs]
    sums = {}
    for _, c, d in done:
        sums[c] = sums.get(c, 0) + d
    return sorted(((i, c, d, sums[c], sum(sums.values()), cents[c]) for i, c, d in done), key=repr)


def clustered(spark, rows, dims=4, k=3, rounds=3, scale=64):
    got = clustering.cluster_vectors(spark.createDataFrame(rows, VEC), dims=dims, k=k, rounds=rounds, scale=scale)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_clusters_match_brute_force(spark):
    rnd = random.Random(11)
    # multiples of 1/128 are exact floats; half of them lie between whole numbers
    rows = [(i, [rnd.randint(-300, 300) / 128 for _ in range(4)]) for i in range(300)]
    assert clustered(spark, rows, k=16) == cluster_model(rows, 4, 16, 3, 64)


def test_clusters_edges(spark):
    bad = [(1, None), (2, []), (3, [1.0, 2.0, 3.0]), (4, [1.0, None, 0.0, 0.0]), (5, [1.0, float("nan"), 0.0, 0.0]),
           (6, [float("inf"), 0.0, 0.0, 0.0]), (7, [0.0, 0.0, 0.0, float("-inf")]), (8, [0.0] * 5)]
    good = [(10, [0.5, -0.5, 1.0, 0.0]), (10, [0.5, -0.5, 1.0, 0.0]), (10, [0.25, 0.0, 0.0, 0.0]), (None, [3.0, 3.0, 3.0, 3.0])]
    assert clustered(spark, bad) == [] == clustered(spark, [])
    assert clustered(spark, bad + good, k=16) == cluster_model(bad + good, 4, 16, 3, 64)  # fewer vectors than clusters
    same = [(i, [0.125, 0.125, 0.125, 0.125]) for i in range(20)]  # equal distances: the smaller number; other clusters stay empty
    assert {r[1] for r in clustered(spark, same)} == {0} and clustered(spark, same) == cluster_model(same, 4, 3, 3, 64)
    clash = spark.createDataFrame([(1, [1.0, 1.0], "a", 2)], "vec_id int, embedding array<double>, v string, cluster int")
    assert clustering.cluster_vectors(clash, dims=2, k=2).select("cluster", "distance").first() == (0, 0)


def test_centroid_digest(spark):
    got = spark.createDataFrame([([1, -2, 3],)], "c array<bigint>").select(clustering.centroid_digest(F.col("c"))).first()[0]
    assert got == hashlib.sha256(b"1,-2,3").hexdigest()


def test_join_compares_single_members_without_a_matrix(spark, monkeypatch):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.sample([f"w{k}" for k in range(300)], 60))) for i in range(40)]
    stored, real = [], ngram_join.materialize

    def spy(df):
        out = real(df)
        if set(out.columns) == {"h", "t"}:
            stored.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "materialize", spy)
    got = ngram_join.jaccard_groups(spark.createDataFrame(rows, DOC), words=1, percent=90)
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [(i, i) for i, _ in rows]
    assert stored == [0]

"""Near-dedup against brute force, and its parts."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from medialake.llm import near_dup, shingles
from medialake.llm.components import connected_components

DOC = "doc_id bigint, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_model(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return set() if not w else {tuple(w)} if len(w) < n else {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


def brute(rows, n, percent):
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
    return sorted(((d, len(sets[i]), least.get(find(i)), d == least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def run(spark, rows, n=3, percent=85):
    return sorted((tuple(r) for r in near_dup.near_duplicates(spark.createDataFrame(rows, DOC), words=n, percent=percent).collect()), key=repr)


def family(rnd, size, words, edits, start, vocab=4000):
    base = [f"v{rnd.randint(0, vocab)}" for _ in range(words)]
    out = []
    for i in range(size):
        w = list(base)
        for _ in range(rnd.randint(0, edits)):
            w[rnd.randrange(len(w))] = f"e{rnd.randint(0, 10 ** 6)}"
        out.append((start + i, " ".join(w)))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    rows, at = [], 0
    for words, edits, size in ((200, 8, 12), (60, 3, 10), (12, 1, 8), (8, 1, 8), (30, 2, 40), (400, 15, 10)):
        for _ in range(3):
            rows += family(rnd, size, words, edits, at)
            at += size
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(at + i, passage + " " + " ".join(f"o{rnd.randint(0, 10 ** 6)}" for _ in range(rnd.choice([3, 8, 12, 200]))))
             for i in range(60)]
    at += 60
    rows += [(at + i, " ".join(rnd.choice("abc") for _ in range(rnd.randint(1, 9)))) for i in range(60)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_equals_brute_force(spark, n, percent):
    rows = corpus(n)
    assert run(spark, rows, n, percent) == brute(rows, n, percent)


def test_long_lists_equal_brute_force(spark, monkeypatch):
    """With a tiny bound nearly every list takes the long-list way."""
    monkeypatch.setattr(near_dup, "LIST", 2)
    rows = corpus(11)
    assert run(spark, rows) == brute(rows, 3, 85)


def test_edge_rows(spark):
    rows = [(5, None), (6, ""), (7, " \t\n"), (9, "One two"), (8, "one TWO"), (10, "x"), (10, "x"), (None, "one two"), (None, "zz"),
            (11, "É a b"), (12, "é a b"), (13, "a\x0bb\x0cc\rd"), (14, "a b c d"), (15, "w " * 30_000), (16, "w w w")]
    got = run(spark, rows)
    assert got == brute(rows, 3, 85)
    assert run(spark, []) == []


def test_drop_keeps_one_row_of_each_group(spark):
    rows = corpus(3) + [(0, "dup dup dup dup")] * 3 + [(None, "no id"), (None, "no id"), (2000, None), (2001, "")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id bigint, text string, id string, `root.key` string")
    kept = near_dup.drop_near_duplicates(df)
    assert kept.columns == df.columns
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    groups = near_dup.near_duplicate_groups(df).collect()
    assert sum(got.values()) == len({r["root"] for r in groups if r["root"] is not None}) + 2
    assert got[(None, "no id")] == 1 and got[(0, "dup dup dup dup")] == 1 and got[(2000, None)] == 1


def test_word_hashes_in_pieces(monkeypatch):
    rnd = random.Random(2)
    text = "".join(rnd.choice("ab \n\tcé") for _ in range(5000)).encode()
    whole = shingles.word_hashes(text)
    assert len(whole) == len(WORD.findall(text.decode()))
    for piece in (1, 2, 7, 64):
        monkeypatch.setattr(shingles, "_PIECE", piece)
        assert np.array_equal(shingles.word_hashes(text), whole)


def test_components(spark):
    rnd = random.Random(8)
    links = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert got == {n: find(n) for a, b in links if a != b for n in (a, b)}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_site_families_with_boilerplate(spark, monkeypatch):
    """Families of one site that share its boilerplate: the pairs that are
    verified grow with the pages, not with their square."""
    verified = {}
    real = near_dup._links
    for m in (100, 400):
        rows = []
        for f in range(4):
            for p in range(m):
                words = [f"b{i}" for i in range(102)] + [f"f{f}_{i}" for i in range(30)] + [f"x{f}_{p}_{i}" for i in range(8)]
                rows.append((len(rows), " ".join(words)))
        seen = []

        def counted(pairs, sets, percent):
            seen.append(pairs.count())
            return real(pairs, sets, percent)

        monkeypatch.setattr(near_dup, "_links", counted)
        got = run(spark, rows, percent=80)
        assert [len({c for d, _, c, _ in got if d // m == f}) for f in range(4)] == [1] * 4 and len({r[2] for r in got}) == 4
        verified[m] = sum(seen)
    assert verified[400] <= 6 * verified[100]


def test_partner_that_shares_only_frequent_runs(spark):
    """A class with many runs of its own still meets a partner that shares only
    the runs of a large group."""
    rnd = random.Random(7)
    base = [f"v{i}" for i in range(240)]
    rows = [(i, " ".join(base[:200] + [f"o{i}_{j}" for j in range(40)])) for i in range(60)]
    for n in range(30):  # pairs 0.83 alike, each about 0.7 like the others
        own = [f"p{n}_{j}" for j in range(20)]
        for twin in range(2):
            words = base[:200] + own + [f"q{n}_{twin}_{j}" for j in range(16)]
            rows.append((len(rows), " ".join(words)))
    rnd.shuffle(rows)
    assert run(spark, rows, percent=80) == brute(rows, 3, 80)


def test_differences_leave_out_what_no_place_needs(spark, monkeypatch):
    # classes that share little with their centre, each linked with one other
    rng = np.random.default_rng(7)
    pool = rng.permutation(np.unique(rng.integers(0, 1 << 63, 6000, dtype=np.uint64) * np.uint64(2)))
    centre, at = pool[:100], 100
    sets, star = [(b"c", centre)], []
    for i in range(6):
        own, at = pool[at:at + 200], at + 200
        for j in range(2):
            edited, at = np.concatenate((own[:195], pool[at:at + 5])), at + 5
            name = f"x{i}{j}".encode()
            sets.append((name, np.concatenate((centre[:20], edited))))
            star.append((b"c", name, name, True))
    sets = spark.createDataFrame([(n, np.sort(s).tobytes()) for n, s in sets], "cls binary, hashes binary")
    stored, real = [], near_dup.materialize

    def spy(df):
        out = real(df)
        if "d" in out.columns:
            stored.append(out.selectExpr("sum(size(d))", "sum(size)").first())
        return out

    monkeypatch.setattr(near_dup, "materialize", spy)
    got = near_dup._by_differences(spark.createDataFrame(star, "c binary, x binary, root binary, far boolean"), sets, 85)
    assert {(bytes(r.a), bytes(r.b)) for r in got.collect()} >= {(f"x{i}0".encode(), f"x{i}1".encode()) for i in range(6)}
    assert [tuple(r) for r in stored] == [(12 * 200, 12 * 280)]

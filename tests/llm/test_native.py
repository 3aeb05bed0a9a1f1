"""Line dedup, fingerprints, sharding and mixing on hand-made cases."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from medialake.llm import fingerprints, line_dedup, mixing, sharding

DOC = "doc_id bigint, text string"
#: extra columns whose names clash with the operators' own
CLASH = "doc_id bigint, text string, source string, lines string, key string, id string, shard string, n string, `a.b` string"


def clashing(spark, rows):
    return spark.createDataFrame([(*r, "l", "k", "i", "s", "n", "x") for r in rows], CLASH)


# ---- line dedup ----

def lines_model(rows):
    """Sequential twin: rows in (id, text digest) order."""
    order = sorted({(d is not None, d, hashlib.md5((t or "").encode()).hexdigest(), t) for d, t in rows},
                   key=lambda r: (r[0], r[1] or 0, r[2]))
    first, gone = {}, {}
    for _, d, h, t in order:
        lines = (t or "").split("\n")
        for p in range(len(lines) - 2):
            w = tuple(lines[p:p + 3])
            if not "".join(w).strip("\t\r "):
                continue
            if w in first:
                gone.setdefault((d, t), set()).update((p, p + 1, p + 2))
            else:
                first[w] = (d, t, p)
    out = []
    for d, t in rows:
        g = gone.get((d, t), set())
        lines = [] if t is None else t.split("\n")
        text = t if not g else "\n".join(x for i, x in enumerate(lines) if i not in g)
        out.append((d, text, len(lines), len(g)))
    return out


def run_lines(spark, rows):
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, DOC)).collect()
    return sorted((tuple(r) for r in got), key=repr)


def test_line_dedup_cases(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\nd\ny"), (3, "a\nb"), (4, None), (5, ""), (6, "q\nq\nq\nq\nq"), (7, "\n\n\n\n"),
            (8, "\n\n\n\n"), (1, "a\nb\nc\nd"), (None, "b\nc\nd"), (9, "b\nc\nd\n"), (9, "z\nb\nc\nd")]
    got = run_lines(spark, rows)
    assert got == sorted(lines_model(rows), key=repr)
    by = {(r[0], r[2]): r for r in got}
    assert by[(2, 6)][1] == "x\ny" and by[(4, 0)][1] is None and by[(5, 1)][1] == "" and by[(6, 5)][1] == "q"
    assert run_lines(spark, []) == []


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_random(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice([None, *range(8)]), "\n".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 9)))) for _ in range(25)]
    assert run_lines(spark, rows) == sorted(lines_model(rows), key=repr)


def test_line_dedup_hot_passage_and_long_text(spark):
    shared = "\n".join(f"shared {i}" for i in range(5))
    rows = [(i, f"own {i}\n{shared}\nend {i}") for i in range(300)] + [(1000, "\n".join(str(i) for i in range(60_000)))]
    got = {r[0]: r for r in run_lines(spark, rows)}
    assert got[0][3] == 0 and all(got[i][1] == f"own {i}\nend {i}" for i in range(1, 300)) and got[1000][3] == 0


def test_line_dedup_clashing_columns(spark):
    df = clashing(spark, [(1, "a\nb\nc", "s"), (2, "a\nb\nc", "s")])
    assert sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(df).collect()) == [(1, "a\nb\nc"), (2, "")]


# ---- fingerprints ----

def fp_model(text):
    words = [w for w in __import__("re").split("[ \t\n\x0b\x0c\r]+", (text or "").lower()) if w]
    sh = [] if not words else [" ".join(words[i:i + 5]) for i in range(max(len(words) - 4, 1))]
    hs = sorted({h for s in sh if (h := hashlib.md5(s.encode()).hexdigest()[:16]) < "8000000000000000"})
    return hashlib.md5(" ".join(words).encode()).hexdigest()[:8] + ":" + "".join(hs), set(hs)


def near_model(a, b):
    (fa, sa), (fb, sb) = fp_model(a), fp_model(b)
    return 1.0 if fa == fb else 0.0 if not sa or not sb else len(sa & sb) / min(len(sa), len(sb))


def edits_model(rows):
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = []
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 3
        e = t[:len(t) - k] + nxt[:k]
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), fp_model(t)[0], fp_model(e)[0],
                    round(near_model(t, e), 9), round(near_model(t, nxt), 9)))
    return sorted(out, key=repr)


def run_edits(spark, rows, parts=3):
    got = fingerprints.tail_edit_fingerprints(spark.createDataFrame(rows, DOC).repartition(parts)).collect()
    return sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in got), key=repr)


def exact_model(a, b):
    """Containment of the smaller shingle set in the larger."""
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))})
    return len(sets[0] & sets[1]) / min(map(len, sets))


def test_likeness_by_text_length(spark):
    rnd = random.Random(12)
    rows = [(i, " ".join(f"w{rnd.randrange(500)}" for _ in range(n))) for i, n in enumerate([6, 9, 20, 40, 90, 200, 900, 5000] * 3)]
    order = sorted(rows, reverse=True)
    exact = {}
    for (d, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        k = len(t) // 3
        exact[d] = exact_model(t, t[:len(t) - k] + nxt[:k]), len(t.split())
    df = spark.createDataFrame(rows, DOC)
    for fraction in (1 / 8, 1 / 2, 1):
        for r in fingerprints.tail_edit_fingerprints(df, fraction=fraction).collect():
            want, n = exact[r["doc_id"]]
            # 1/8 says little about a short text; all hashes are exact at any length
            bound = 1e-9 if fraction == 1 else 2 / math.sqrt(n * fraction)
            assert abs(r["near_edited"] - want) <= bound, (fraction, n)


def test_fingerprints_match_model(spark):
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(40)] + ["é", "日本", " x", "𝄞"]
    rows = [(i * 7, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 120)))) for i in range(60)]
    rows += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "One"), (None, "no id at all"), (1004, rows[3][1]),
             (1005, " ".join(rnd.choice(vocab) for _ in range(30_000)))]
    got = run_edits(spark, rows)
    assert got == edits_model(rows)
    by = {r[0]: r for r in got}
    assert by[1004][3] == by[21][3]  # equal texts have equal fingerprints
    assert run_edits(spark, []) == []
    assert run_edits(spark, [(5, "abc def")])[0][2] == hashlib.sha256(b"abc dab").hexdigest()


def test_fingerprints_repeated_rows_and_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "g h i"), (2, "j k l m")]
    got = run_edits(spark, rows)
    assert len(got) == 4 and [r for r in got if r[3] == fp_model("a b c d e f")[0]][0] == \
        [r for r in got if r[3] == fp_model("a b c d e f")[0]][1]


def test_fingerprint_containment_of_unequal_texts(spark):
    rnd = random.Random(9)
    big = [f"t{rnd.randint(0, 10 ** 6)}" for _ in range(20_000)]
    small = big[500:900]
    df = spark.createDataFrame([(" ".join(big), " ".join(small))], "a string, b string")
    d = fingerprints.with_fingerprint(fingerprints.with_fingerprint(df, "a", "fa"), "b", "fb").select(
        *[fingerprints.fingerprint_text(F.col(c)).alias(c) for c in ("fa", "fb")])
    near = fingerprints.likeness(F.col("fa"), F.col("fb"), fingerprints.sketch_in(F.col("fa")), fingerprints.sketch_in(F.col("fb")))
    assert d.select(near).first()[0] == 1.0


# ---- sharding ----

def sizes_by_shard(rows):
    out = Counter()
    for r in rows:
        out[r["shard"]] += len((r["text"] or "").encode())
    return out


def test_shards_fit_and_are_prefixes(spark):
    rnd = random.Random(1)
    rows = [(i, "é" * rnd.randint(0, 60)) for i in range(800)] + [(9000, "x" * 5000), (9001, None), (None, "y" * 10)]
    got = sharding.shard_rows(spark.createDataFrame(rows, DOC), limit=1000).collect()
    assert len(got) == len(rows)
    sizes = sizes_by_shard(got)
    over = {r["shard"] for r in got if r["shard_oversize"]}
    assert len(over) == 1 and all(v <= 1000 or s in over for s, v in sizes.items())
    names = sorted(sizes)
    assert not any(a != b and b.startswith(a) for a in names for b in names)
    # only oversized buckets were split: two sibling leaves never fit together
    for s in names:
        sib = s[:-1] + ("1" if s[-1] == "0" else "0")
        if sib in sizes and not {s, sib} & over:
            assert sizes[s] + sizes[sib] > 1000


def test_sharding_repeated_rows_overflow(spark):
    rows = [(1, "x" * 100)] * 57 + [(i, "y" * 90) for i in range(2, 40)]
    got = sharding.shard_rows(spark.createDataFrame(rows, DOC), limit=1000).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)
    sizes = sizes_by_shard(got)
    assert max(sizes.values()) <= 1000 and sum("+" in s for s in sizes) == 6


def test_sharding_edges(spark):
    empty = sharding.shard_rows(spark.createDataFrame([], DOC))
    assert empty.count() == 0 and empty.columns == ["doc_id", "text", "shard", "shard_depth", "shard_oversize"]
    one = sharding.shard_rows(clashing(spark, [(1, "a", "s"), (2, None, None)])).collect()
    assert {(r["shard"], r["shard_depth"], r["a.b"], r["n"]) for r in one} == {("", 0, "x", "n")}
    with pytest.raises(ValueError):
        sharding.shard_rows(spark.createDataFrame([], DOC), limit=0)


# ---- mixing ----

def test_mix_hits_target_weights(spark):
    rows = [(i, f"text {i}", "big" if i % 10 else "small") for i in range(6000)] + [(7000, "t", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = Counter(r["source"] for r in mixing.poisson_mix(df, {"big": 1.0, "small": 3.0}, total=8000).collect())
    assert got[None] == 0 and abs(got["small"] - 6000) < 4 * math.sqrt(6000) and abs(got["big"] - 2000) < 4 * math.sqrt(2000)


def test_mix_counts_are_poisson_and_repeatable(spark):
    df = spark.createDataFrame([(i, f"t{i}", "s") for i in range(4000)], "doc_id bigint, text string, source string")
    a = mixing.poisson_mix(df, total=10_000, with_copy=True)
    n = Counter(r["doc_id"] for r in a.collect())
    counts = Counter(n.get(i, 0) for i in range(4000))
    for k in range(7):
        want = 4000 * math.exp(-2.5) * 2.5 ** k / math.factorial(k)
        assert abs(counts[k] - want) < 5 * math.sqrt(want)
    again = mixing.poisson_mix(df.repartition(7), total=10_000, with_copy=True)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, again.collect()))
    other = Counter(r["doc_id"] for r in mixing.poisson_mix(df, total=10_000, seed=5).collect())
    assert other != n


def test_mix_large_mean_and_edges(spark):
    df = spark.createDataFrame([(1, "t", "s"), (2, None, "s"), (None, "", "s")], "doc_id bigint, text string, source string")
    got = Counter((r["doc_id"], r["text"]) for r in mixing.poisson_mix(df, total=3000).collect())
    assert all(abs(got[k] - 1000) < 200 for k in ((1, "t"), (2, None), (None, "")))
    assert mixing.poisson_mix(df.limit(0)).count() == 0
    df = clashing(spark, [(1, "a", "s"), (2, "b", None)])
    out = mixing.poisson_mix(df, total=200)
    assert out.columns == df.columns and {r["a.b"] for r in out.collect()} == {"x"} and {r["source"] for r in out.collect()} == {"s", None}


def test_mix_salted_join_gives_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"t{i}", f"s{i % 5}") for i in range(500)], "doc_id bigint, text string, source string")
    want = sorted(map(tuple, mixing.poisson_mix(df, with_copy=True).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 2)
    assert sorted(map(tuple, mixing.poisson_mix(df, with_copy=True).collect())) == want

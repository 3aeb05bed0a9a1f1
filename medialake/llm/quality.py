"""Quality classifier (operator 3): positive-unlabelled learning.

The classifier learns from trusted positives and unlabelled text only; known
negatives are never used. A text becomes a vector of basis functions of its
surface statistics (characters, words, repetition, lines). The score function
is linear in that vector and minimises the non-negative unbiased risk with the
squared loss

    prior * E_P[l(f, +1)] + max(0, E_U[l(f, -1)] - prior * E_P[l(f, -1)]).

With the squared loss every term is a quadratic form of the weights, given the
first and second moments of the vector under P and U. So one distributed pass
over all texts yields everything the training needs, exactly and without a
sample: a few hundred numbers squared, whatever the size of the corpus. The
minimum is then found in closed form: where the unbiased risk has a negative
second term, the multiplier of that term is lowered until it is zero.

The class prior is estimated from the same two samples (best-bin estimation):
a first score ranks texts, and the smallest ratio of the unlabelled to the
positive share among the top-ranked, with a confidence margin, bounds the
share of positives among the unlabelled.

The posterior (f + 1) / 2, clipped to 0..1, is the score.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialake.llm import rows as R
from medialake.llm import shingles as S
from medialake.session import materialize

KNOTS = 9
#: Ridge penalty: at least this, and ``RIDGE_ROWS`` / positives.
RIDGE, RIDGE_ROWS = 1e-4, 1.0
#: Score bins over -RANGE..RANGE for the class prior.
BINS, RANGE = 400, 1.5
#: A score from here on predicts label 1.
CUT = 0.3

_CLASSES = np.zeros((256, 9))
for _name, _bytes in enumerate((
        range(65, 91), range(97, 123), range(48, 58), b"!?", b"#$%&*@^~+=", b"|<>{}[]\\/_", b".,;:", b" \t\n\r\x0b\x0c",
        range(128, 256))):
    _CLASSES[list(_bytes), _name] = 1.0
#: the statistics, in order
NAMES = ("upper lower digit shout symbol table stop space beyond log_words word_len word_spread distinct top_word "
         "adjacent pairs short_words sentence line_len line_distinct blank_lines upper_initial").split()


def _share(a: float, b: float) -> float:
    return a / b if b else 0.0


def statistics(text: str | None) -> np.ndarray:
    """Surface statistics of a text, each within 0..1."""
    out = np.zeros(len(NAMES))
    data = (text or "").encode("utf-8", "surrogatepass")
    b = np.frombuffer(data, np.uint8)
    if len(b) == 0:
        return out
    counts = np.bincount(b, minlength=256)
    out[:9] = counts @ _CLASSES / len(b)
    w = S.word_hashes(data)
    n = len(w)
    solid = len(b) - counts[[9, 10, 11, 12, 13, 32]].sum()
    out[9] = min(1.0, math.log1p(n) / 12)
    out[10] = min(1.0, _share(solid, n) / 16)
    if n:
        _, c = np.unique(w, return_counts=True)
        out[12] = math.log1p(len(c)) / math.log1p(n)
        out[13] = c.max() / n
        out[14] = _share(float((w[1:] == w[:-1]).sum()), n - 1)
        out[15] = _share(len(np.unique(w[1:] * np.uint64(0x9E3779B97F4A7C15) + w[:-1])), n - 1)
        # words: gaps between white space
        ws = np.flatnonzero(S._SPACE[b])
        lens = np.diff(np.concatenate(([-1], ws, [len(b)]))) - 1
        lens = lens[lens > 0]
        out[11] = min(1.0, float(lens.std()) / 12)
        out[16] = float((lens <= 3).mean())
        out[17] = min(1.0, _share(float(counts[[46, 33, 63]].sum()), n) * 2)
        first = np.concatenate((b[:1], b[1:][S._SPACE[b[:-1]]]))
        out[21] = _share(float(((first >= 65) & (first <= 90)).sum()), n)
    lines = data.split(b"\n")
    out[18] = min(1.0, math.log1p(_share(len(b), len(lines))) / 10)
    out[19] = _share(len(set(lines)), len(lines))
    out[20] = _share(sum(1 for x in lines if not x.strip()), len(lines))
    return out


def basis(stats: np.ndarray) -> np.ndarray:
    """Rows of statistics to rows of a constant and ``KNOTS - 1`` hat functions
    of the square root of each (which spreads small shares)."""
    x = np.sqrt(np.clip(stats, 0, 1)) * (KNOTS - 1)
    hats = np.maximum(0.0, 1.0 - np.abs(x[:, :, None] - np.arange(1, KNOTS)))
    return np.concatenate([np.ones((len(stats), 1)), hats.reshape(len(stats), stats.shape[1] * (KNOTS - 1))], axis=1)


def solve(m: dict[str, np.ndarray], prior: float, ridge: float) -> np.ndarray:
    """Weights of the smallest non-negative risk, from the moments ``AP``,
    ``bP``, ``AU``, ``bU`` (means of x x^T and of x)."""
    ap, bp, au, bu = m["AP"], m["bP"], m["AU"], m["bU"]
    eye = np.eye(len(bp))

    def weights(t: float) -> np.ndarray:
        return np.linalg.solve(prior * ap + t * (au - prior * ap) + ridge * eye, prior * bp + t * (prior * bp - bu))

    def second(w: np.ndarray) -> float:
        return (w @ au @ w + 2 * w @ bu + 1 - prior * (w @ ap @ w + 2 * w @ bp + 1)) / 4

    w = weights(1.0)
    if second(w) >= 0:
        return w
    lo, hi = 0.0, 1.0
    for _ in range(40):
        mid = (lo + hi) / 2
        if second(weights(mid)) >= 0:
            lo = mid
        else:
            hi = mid
    return weights(lo)


def prior_from_bins(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """Best-bin estimate of the share of positives among the unlabelled, from
    counts of both by descending score bin."""
    p, u = np.cumsum(positive[::-1]).astype(float), np.cumsum(unlabelled[::-1]).astype(float)
    np_, nu = max(p[-1], 1.0), max(u[-1], 1.0)
    qp, qu = p / np_, u / nu
    margin = math.sqrt(math.log(4 / delta) / (2 * nu)) + math.sqrt(math.log(4 / delta) / (2 * np_))
    ok = qp > 0.05
    if not ok.any():
        return 0.5
    bound = (qu[ok] + margin) / qp[ok]
    best = int(np.argmin(bound))
    return float(np.clip(qu[ok][best] / qp[ok][best], 0.02, 0.98))


def _stats_udf():
    @F.pandas_udf("array<float>")
    def stats(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t).astype(np.float32) for t in texts], dtype=object)
    return stats


def _score(stats: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.clip((basis(stats) @ weights + 1) / 2, 0.0, 1.0)


def _rows(stats: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=float) for x in stats]) if len(stats) else np.zeros((0, len(NAMES)))


def _score_udf(weights: np.ndarray, of_text: bool):
    """Scores of texts, or of stored statistics."""
    @F.pandas_udf("double")
    def score(col: pd.Series) -> pd.Series:
        x = np.stack([statistics(t) for t in col]).astype(np.float32).astype(float) if of_text else _rows(col)
        return pd.Series(_score(x, weights))
    return score


def _moments(feats: DataFrame) -> dict[str, np.ndarray]:
    """Means of x and x x^T under the positives and under all rows, from one
    pass. Each task sums its rows; what reaches the driver are the sums per
    cell, whose number is the square of the basis size."""
    def partial(batches):
        total = None
        for pdf in batches:
            x = basis(_rows(pdf["stats"]))
            p = x[pdf["positive"].to_numpy(bool)]
            part = np.stack([x.T @ x, p.T @ p])
            total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"i": np.arange(total.shape[1]), "u": list(total[0]), "p": list(total[1])})

    rows = feats.select("stats", "positive").mapInPandas(partial, "i int, u array<double>, p array<double>")
    cells = (rows.select("i", F.posexplode(F.arrays_zip("u", "p")).alias("j", "c"))
             .groupBy("i", "j").agg(F.sum("c.u").alias("u"), F.sum("c.p").alias("p")).collect())
    d = 1 + len(NAMES) * (KNOTS - 1)
    au, ap = np.zeros((d, d)), np.zeros((d, d))
    for c in cells:
        au[c.i, c.j], ap[c.i, c.j] = c.u, c.p
    n, k = au[0, 0], ap[0, 0]
    return {"n": n, "k": k, "AU": au / max(n, 1), "AP": ap / max(k, 1), "bU": au[0] / max(n, 1), "bP": ap[0] / max(k, 1)}


def trusted_positives(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Distinct ids (``pid``) labelled 1, and never 0, outside the held-out
    fold (crc32 of the id as text, modulo 5, is 0)."""
    seen = labels.select(R.quoted(id_col).alias("pid"), R.quoted(label_col).alias("q")).filter(
        "pid IS NOT NULL AND q IS NOT NULL").filter(~held_out(F.col("pid")))
    return seen.groupBy("pid").agg(F.min("q").alias("q")).filter("q = 1").select("pid")


def held_out(id_col):
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def text_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, stats) per row, stored."""
    return materialize(df.select(R.quoted(id_col).alias("id"), _stats_udf()(R.quoted(text_col)).alias("stats")))


def fit(feats: DataFrame, positives: DataFrame) -> tuple[np.ndarray, float]:
    """Weights and class prior. Without any positive the weights are zero, so
    that every text scores 0.5."""
    marked = feats.join(positives, F.col("id") == F.col("pid"), "left").select(
        "stats", F.col("pid").isNotNull().alias("positive"))
    m = _moments(marked)
    if not m["k"]:
        return np.zeros(len(m["bU"])), 0.5
    ridge = max(RIDGE, RIDGE_ROWS / m["k"])
    first = solve(m, 0.5, ridge)

    @F.pandas_udf("int")
    def bin_of(stats: pd.Series) -> pd.Series:
        f = basis(_rows(stats)) @ first
        return pd.Series(np.clip(((f + RANGE) / (2 * RANGE) * BINS).astype(int), 0, BINS - 1))

    found = marked.select(bin_of("stats").alias("bin"), "positive").groupBy("bin").agg(
        F.count("*").alias("u"), F.sum(F.col("positive").cast("long")).alias("p")).collect()
    u, p = np.zeros(BINS), np.zeros(BINS)
    for r in found:
        u[r.bin], p[r.bin] = r.u, r.p
    prior = prior_from_bins(p, u)
    return solve(m, prior, ridge), prior


def score_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: ``id_col``, ``held_out``, ``score`` (0 to 1)
    and ``predicted`` (1 if the score is at least 0.3).

    Defined cases: a NULL text is scored as an empty one (all statistics 0); a
    NULL id is in no fold and has no label; repeated rows are scored alike and
    each counts as unlabelled text; without positives all scores are 0.5.
    """
    feats = text_statistics(df, id_col, text_col)
    weights, _ = fit(feats, trusted_positives(labels))
    score = _score_udf(weights, of_text=False)("stats")
    out = feats.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that the classifier, fitted on ``df``, predicts as 1."""
    weights, _ = fit(text_statistics(df, id_col, text_col), trusted_positives(labels))
    return df.filter(_score_udf(weights, of_text=True)(R.quoted(text_col)) >= CUT)

"""Benchmark decontamination (operator 6): pigeonhole edit matching.

A test item with error budget k is split into k + 1 pieces. A passage within
k edits of the item leaves at least one piece untouched, so every such passage
contains an exact piece at its place (give or take k). An Aho-Corasick
automaton finds all piece hits of all items in one scan of a text; hits on
neighbouring diagonals make one window, and Myers' bit-parallel algorithm
computes the smallest edit distance of the item to any part of the window.

Texts and items are compared lower-cased, with white space runs as one space.
The budget is a fixed share of the item's length. The items are the bounded
side: they are dealt with in blocks of at most ``BLOCK_CHARS`` characters, each
block against all texts, so a task holds one block (at least one whole item).
The driver holds all items, as closures of one plan with a scan of the texts
per block: it bounds the size of the benchmark.
"""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialake.llm import rows as R

#: Edits allowed per character of an item.
ERROR_RATE = 0.08
BLOCK_CHARS = 4_000_000


def normalize(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(n: int, k: int) -> list[tuple[int, int]]:
    """k + 1 adjacent ranges that cover 0..n, of nearly equal length."""
    return [(j * n // (k + 1), (j + 1) * n // (k + 1)) for j in range(k + 1)]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Smallest edit distance of ``pattern`` to any part of ``text``, and the
    end of the first such part. (Bit i of the vectors: row i of the edit
    matrix rises or falls.)"""
    m = len(pattern)
    if m == 0:
        return 0, 0
    full, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | (1 << i)
    up, down, score = full, 0, m
    best, at = m, 0
    for j, c in enumerate(text):
        eq = where.get(c, 0)
        v = eq | down
        h = (((eq & up) + up) ^ up) | eq
        rise, fall = down | (full & ~(h | up)), up & h
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise, fall = (rise << 1) & full, (fall << 1) & full
        up, down = fall | (full & ~(v | rise)), rise & v
        if score < best:
            best, at = score, j + 1
    return best, at


class Matcher:
    """The items of one block, and their piece automaton."""

    def __init__(self, items: list[tuple[object, str]], rate: float = ERROR_RATE):
        import ahocorasick

        found: dict[str, list[tuple[int, int]]] = {}
        self.items = []
        for key, text in items:
            p = normalize(text)
            if not p:
                continue
            k = int(rate * len(p))
            for a, b in pieces(len(p), k):
                found.setdefault(p[a:b], []).append((len(self.items), a))
            self.items.append((key, p, k))
        self.automaton = ahocorasick.Automaton()
        for piece, at in found.items():
            self.automaton.add_word(piece, (len(piece), at))
        if found:
            self.automaton.make_automaton()

    def hits(self, text: str | None) -> list[tuple[object, int, int]]:
        """(item key, distance, end in the normalized text) of every item that
        occurs within its budget."""
        x = normalize(text)
        if not x or not self.items:
            return []
        starts: dict[int, set[int]] = {}
        for end, (n, at) in self.automaton.iter(x):
            for item, offset in at:
                starts.setdefault(item, set()).add(end - n + 1 - offset)
        out = []
        for item, diagonals in sorted(starts.items()):
            key, p, k = self.items[item]
            best = None
            for lo, hi in _windows(sorted(diagonals), len(p), k, len(x)):
                d, end = myers(p, x[lo:hi])
                if d <= k and (best is None or d < best[0]):
                    best = (d, lo + end)
                    if d == 0:
                        break
            if best:
                out.append((key, *best))
        return out


def _windows(diagonals: list[int], m: int, k: int, n: int) -> Iterator[tuple[int, int]]:
    """Text ranges around diagonals that are at most 2 k apart."""
    first = last = diagonals[0]
    for d in [*diagonals[1:], None]:
        if d is not None and d - last <= 2 * k:
            last = d
            continue
        yield max(0, first - k), min(n, last + m + k)
        first = last = d


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, str]]]:
    block, size = [], 0
    chosen = benchmark.select(R.quoted(id_col).alias("item"), R.quoted(text_col).alias("text"))
    for item, text in chosen.filter("text IS NOT NULL").toLocalIterator():
        if block and size + len(text) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += len(text)
    if block:
        yield block


def _hits_udf(block: list[tuple[object, str]], rate: float, item_type: str):
    matcher: list[Matcher] = []  # made once per Python worker and task

    @F.pandas_udf(f"array<struct<item:{item_type},distance:int,end:int>>")
    def hits(texts: pd.Series) -> pd.Series:
        if not matcher:
            matcher.append(Matcher(block, rate))
        return pd.Series([[{"item": i, "distance": d, "end": e} for i, d, e in matcher[0].hits(t)] for t in texts],
                         dtype=object)
    return hits


def find_contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_id_col: str = "item_id", item_text_col: str = "text",
                       rate: float = ERROR_RATE) -> DataFrame:
    """One row per text and item that occurs in it within its budget:
    ``id_col``, ``item_id``, ``distance``, ``end_char`` (in the normalized text).

    Defined cases: NULL and blank texts match nothing, NULL and blank items
    are left out; an item too short for an edit must occur exactly; repeated
    rows are reported each; an empty benchmark gives no rows.
    """
    item_type = benchmark.schema[item_id_col].dataType.simpleString()
    out = None
    for block in _blocks(benchmark, item_id_col, item_text_col):
        hit = df.select(R.quoted(id_col).alias("id"),
                        F.explode(_hits_udf(block, rate, item_type)(R.quoted(text_col))).alias("hit"))
        out = hit if out is None else out.unionByName(hit)
    if out is None:
        out = df.select(R.quoted(id_col).alias("id"), F.lit(None).cast(
            f"struct<item:{item_type},distance:int,end:int>").alias("hit")).limit(0)
    return out.select(F.col("id").alias(id_col), F.col("hit.item").alias("item_id"), F.col("hit.distance").alias("distance"),
                      F.col("hit.end").alias("end_char"))


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
                      item_text_col: str = "text", rate: float = ERROR_RATE) -> DataFrame:
    """The rows of ``df`` whose text holds no item within its budget."""
    item_type = benchmark.schema[item_id_col].dataType.simpleString()
    for block in _blocks(benchmark, item_id_col, item_text_col):
        df = df.filter(F.size(_hits_udf(block, rate, item_type)(R.quoted(text_col))) == 0)
    return df

"""The most alike title of the same date, by the ratio of matching characters, with few pairs scored."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Titles of a date that are met at once, about: a date with more is dealt out in blocks of them.
BLOCK = 8192
#: Bounds that are held at once.
BOUNDS = 1 << 20


def _codes(titles: list[str]) -> np.ndarray:
    return np.frombuffer("".join(titles).encode("utf-32-le", "surrogatepass"), "<u4")


def _profiles(titles: list[str], alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Lengths and counts of the characters of `alphabet` of each profile that titles have, and its titles."""
    sizes = np.fromiter(map(len, titles), np.int64, len(titles))
    codes, rows = _codes(titles), np.repeat(np.arange(len(titles)), sizes)
    known = np.isin(codes, alphabet)
    cell = rows[known] * len(alphabet) + np.searchsorted(alphabet, codes[known])
    counts = np.bincount(cell, minlength=len(titles) * len(alphabet)).reshape(len(titles), len(alphabet))
    table = np.column_stack([sizes, counts]).astype(np.int16 if sizes.max(initial=0) < 1 << 15 else np.int64)
    found, of, n = np.unique(table, axis=0, return_inverse=True, return_counts=True)
    return found[:, 0].astype(np.int64), found[:, 1:], np.split(np.argsort(of.ravel(), kind="stable"), np.cumsum(n)[:-1])


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many characters each row of a and each of b have in common."""
    out = np.zeros((len(a), len(b)), a.dtype if a.dtype == b.dtype else np.int64)
    for x, y in zip(a.T, b.T, strict=True):
        i, j = np.flatnonzero(x), np.flatnonzero(y)
        if 4 * len(i) * len(j) < out.size:
            out[np.ix_(i, j)] += np.minimum(x[i, None], y[None, j])
        else:
            out += np.minimum(x[:, None], y[None, :])
    return out


def best_of(titles: list[str], others: list[str], order: list[int], at_least: float) -> list[tuple[float, int, int]]:
    """For each title the greatest ratio of an other one, if it is `at_least`, the least `order` of those
    that have it, and how many were scored. (-1, -1, n) if there is none.

    No more characters can match than both titles have of each, which bounds the ratio. Titles of one length
    and the same characters have one profile, for which bounds are computed once. Others are scored from the
    greatest bound down, until it is below the best ratio found; those below the greatest are put in order only
    where that has not been reached.
    """
    if not titles or not others:
        return [(-1.0, -1, 0)] * len(titles)
    alphabet = np.intersect1d(_codes(titles), _codes(others))
    sizes, counts, members = _profiles(titles, alphabet)
    other_sizes, other_counts, other_members = _profiles(others, alphabet)
    theirs = [sorted(x.tolist(), key=order.__getitem__) for x in other_members]
    matchers: dict[int, difflib.SequenceMatcher] = {}
    out: list[tuple[float, int, int]] = [(-1.0, -1, 0)] * len(titles)

    def tried(title: str, profiles: list[int], bounds: list[float], so_far: tuple[float, int, int]) -> tuple[float, int, int]:
        best, at, scored = so_far
        for profile, bound in zip(profiles, bounds, strict=True):
            if bound < best:
                break
            for i in theirs[profile]:
                if bound < best or (bound == best and order[i] > at):
                    break
                if i not in matchers:
                    matchers[i] = difflib.SequenceMatcher(None, "", others[i])
                matchers[i].set_seq1(title)
                scored += 1
                ratio = matchers[i].ratio()
                if ratio >= at_least and (ratio > best or (ratio == best and order[i] < at)):
                    best, at = ratio, order[i]
        return best, at, scored

    step = max(1, BOUNDS // len(other_sizes))
    for start in range(0, len(sizes), step):
        length = sizes[start : start + step, None] + other_sizes[None, :]
        bounds = np.where(length > 0, 2.0 * _common(counts[start : start + step], other_counts) / np.maximum(length, 1), 1.0)
        for row, top, mine in zip(bounds, bounds.max(axis=1).tolist(), members[start : start + step], strict=True):
            if top < at_least:
                continue
            first, rest = np.flatnonzero(row == top).tolist(), None
            for i in mine.tolist():
                out[i] = tried(titles[i], first, [top] * len(first), out[i])
                if out[i][0] < top:
                    if rest is None:
                        rest = np.flatnonzero((row >= at_least) & (row < top))
                        rest = rest[np.argsort(-row[rest], kind="stable")]
                    # Bounds from the best found on; what is found meanwhile ends the search.
                    able = rest[: np.searchsorted(-row[rest], -out[i][0], side="right")]
                    out[i] = tried(titles[i], able.tolist(), row[able].tolist(), out[i])
    return out


def _dealt(df: DataFrame, date: str, title: str, block: str, size: int) -> DataFrame:
    """`df` with the block of its date that each title is in: as many as keep them at about `size`."""
    count = df.groupBy(date).agg(F.count("*").alias("_n"))
    return df.join(count, date).withColumn(block, F.pmod(F.xxhash64(title), F.ceil(F.col("_n") / size)).cast("int")).drop("_n")


def best_titles(titles: DataFrame, others: DataFrame, at_least: float, block: int = BLOCK) -> DataFrame:
    """`date`, `title`, `score`, `order`, `scored` of each title that some other one of its date is alike
    enough to. titles: `date`, `title`, distinct; others: `date`, `other`, `order` (a whole number), distinct.

    Each block of a date's titles meets each block of its others in a row of its own, and the best of the
    blocks is taken: a date with very many titles is spread, and no list is longer than a few blocks. Blocks are
    as large as most dates, since a title whose best one is in another block is scored with many.
    """
    left = _dealt(titles, "date", "title", "a", block).groupBy("date", "a").agg(F.collect_list("title").alias("titles"))
    right = _dealt(others, "date", "other", "b", block).groupBy("date", "b").agg(F.collect_list(F.struct("other", "order")).alias("others"))
    met = left.join(right, "date").repartition("date", "a", "b").select("date", "titles", F.col("others.other").alias("others"), F.col("others.order").alias("orders"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                date, mine, theirs, order = (batch.column(i)[row].as_py() for i in range(4))
                found = best_of(mine, theirs, order, at_least)
                columns = [[date] * len(mine), mine, *map(list, zip(*found, strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["date", "title", "score", "order", "scored"])

    tried = met.mapInArrow(run, "date string, title string, score double, order long, scored long")
    best = F.min(F.when(F.col("score") >= 0, F.struct((-F.col("score")).alias("less"), F.col("order").alias("order")))).alias("best")
    found = tried.groupBy("date", "title").agg(best, F.sum("scored").alias("scored"))
    return found.select("date", "title", (-F.col("best.less")).alias("score"), F.col("best.order").alias("order"), "scored")

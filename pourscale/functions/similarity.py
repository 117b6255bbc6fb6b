"""Text similarity on pairs of normalised strings.

Words are sorted, compared and joined by column expressions. Spark has no longest common
subsequence and no Jaro-Winkler, so these two run over whole Arrow batches in numpy: one step
handles one character position of all pairs of a batch, with 64 positions of a text in
a machine word. No Python code runs per pair.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

# ship the batch functions by value: workers need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
#: Pairs times positions that are held at once.
ROOM = 1 << 18


def _coded(texts: list[str], codes: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Small numbers of the characters of each text, a row each, filled up with 0, and the lengths."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    seen = np.zeros(int(points.max(initial=0)) + 1, np.intp)
    seen[points] = 1
    chars = np.flatnonzero(seen)
    seen[chars] = [codes.setdefault(c, len(codes) + 1) for c in chars.tolist()]
    out = np.zeros((len(texts), max(int(sizes.max(initial=0)), 1)), np.intp)
    out[np.arange(out.shape[1]) < sizes[:, None]] = seen[points]
    return out, sizes


def _chunks(a: list[str], b: list[str]):
    """Positions of pairs of like length, few enough to be held at once, with their coded texts and number of characters."""
    longest = np.fromiter((max(len(x), len(y), 1) for x, y in zip(a, b)), np.int64, len(a))
    order = np.argsort(longest, kind="stable")
    longest, start = longest[order], 0
    while start < len(order):
        most = max(2 * int(longest[start]), 32)
        stop = min(int(np.searchsorted(longest, most, "right")), start + max(1, ROOM // most))
        at, codes = order[start:stop], {}
        left, right = (_coded([x[i] for i in at], codes) for x in (a, b))
        yield at, left, right, len(codes) + 1
        start = stop


def _places(coded: np.ndarray, kinds: int) -> np.ndarray:
    """For each text (row) and character the bits of the positions where it stands, 64 in a word."""
    n, width = coded.shape
    out = np.zeros(((width + 63) // 64, n * kinds), np.uint64)
    at = np.arange(n) * kinds
    for j in range(width):
        out[j // 64][at + coded[:, j]] |= np.uint64(1 << (j % 64))
    out[:, at] = 0
    return out


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair, by bit-parallel steps with a carry between words."""
    out = np.zeros(len(a), np.int64)
    for at, (left, _), (right, _), kinds in _chunks(a, b):
        places, base = _places(right, kinds), np.arange(len(at)) * kinds
        v = [np.full(len(at), ~np.uint64(0)) for _ in places]
        for i in range(left.shape[1]):
            own, carry = base + left[:, i], None
            for w, x in enumerate(v):
                m = places[w][own]
                total = x + (x & m)
                if len(v) > 1:
                    over = total < x
                    if carry is not None:
                        total = total + carry
                        over |= total < carry
                    carry = over.astype(np.uint64)
                v[w] = total | (x & ~m)
        out[at] = sum(np.bitwise_count(~x).astype(np.int64) for x in v)
    return out


def _below(n: np.ndarray) -> np.ndarray:
    """Words whose lowest n bits, 0 to 64, are set."""
    n = np.clip(n, 0, 64).astype(np.uint64)
    return np.where(n == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(n, np.uint64(63))) - np.uint64(1))


def _matched(left: np.ndarray, right: np.ndarray, reach: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """Which characters of each pair Jaro's rule matches: each right one with the first free equal left one in reach."""
    n, width = left.shape
    if width > 64:
        used, hit, columns, rows = np.zeros(left.shape, bool), np.zeros(right.shape, bool), np.arange(width), np.arange(n)
        for j in range(right.shape[1]):
            free = (left == right[:, j, None]) & (np.abs(columns - j) <= reach[:, None]) & ~used & (right[:, j, None] > 0)
            first = free.argmax(1)
            hit[:, j] = free[rows, first]
            used[rows[hit[:, j]], first[hit[:, j]]] = True
        return used, hit
    places, base = _places(left, kinds)[0], np.arange(n) * kinds
    used, hit = np.zeros(n, np.uint64), np.zeros(right.shape, bool)
    for j in range(right.shape[1]):
        free = places[base + right[:, j]] & _below(j + reach + 1) & ~_below(j - reach) & ~used
        first = free & (~free + np.uint64(1))
        used |= first
        hit[:, j] = first != 0
    return np.unpackbits(used.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")[:, :width].astype(bool), hit


def jaro_winklers(a: list[str], b: list[str]) -> np.ndarray:
    """Jaro-Winkler similarity of each pair."""
    out = np.zeros(len(a))
    for at, (left, la), (right, lb), kinds in _chunks(a, b):
        used, hit = _matched(left, right, np.maximum(np.maximum(la, lb) // 2 - 1, 0), kinds)
        m = used.sum(1)
        moved = np.bincount(np.nonzero(used)[0], weights=left[used] != right[hit], minlength=len(at)) // 2
        with np.errstate(divide="ignore", invalid="ignore"):
            sim = np.where(m > 0, (m / la + m / lb + (m - moved) / m) / 3, 0.0)
        width = min(4, left.shape[1], right.shape[1])
        same = (left[:, :width] == right[:, :width]) & (left[:, :width] > 0)
        prefix = np.minimum.accumulate(same, axis=1).sum(1)
        out[at] = np.where(sim > 0.7, sim + prefix * 0.1 * (1 - sim), sim)
    return np.where([x == y for x, y in zip(a, b)], 1.0, out)


def _texts(*columns: pd.Series) -> tuple[np.ndarray, list[list[str]]]:
    """Which rows have no null, and their texts."""
    known = np.logical_and.reduce([c.notna().to_numpy() for c in columns])
    return known, [c[known].tolist() for c in columns]


def _measured(function) -> object:
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        known, (a, b) = _texts(left, right)
        out = np.full(len(left), np.nan)
        out[known] = function(a, b)
        return pd.Series(out, dtype=object).where(known, None).astype("float64")

    return run


# evaluated exactly where they are written: filters on a score never repeat the scoring
_lcs = F.pandas_udf(_measured(lcs_lengths), T.DoubleType()).asNondeterministic()
_jaro = F.pandas_udf(_measured(jaro_winklers), T.DoubleType()).asNondeterministic()


_SCORES = T.StructType([T.StructField(n, T.DoubleType()) for n in ("ratio", "sort", "set", "jaro")])


@F.pandas_udf(_SCORES)
def _four(a: pd.Series, b: pd.Series, sa: pd.Series, sb: pd.Series, ja: pd.Series, jb: pd.Series) -> pd.DataFrame:
    """Common subsequences of three pairs of texts, and Jaro-Winkler of the first."""
    known, (a, b, sa, sb, ja, jb) = _texts(a, b, sa, sb, ja, jb)
    out = np.full((len(known), 4), np.nan)
    n = len(a)
    lengths = lcs_lengths(a + sa + ja, b + sb + jb)
    out[known] = np.stack([lengths[:n], lengths[n : 2 * n], lengths[2 * n :], jaro_winklers(a, b)], axis=1)
    return pd.DataFrame(out, columns=["ratio", "sort", "set", "jaro"])


_four = _four.asNondeterministic()


# ------------------------------------------------------------------ words
def word_set(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(text, " "), lambda w: w != "")))


def sorted_words(text: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(text, " "), lambda w: w != "")), " ")


def _set_text(words: Column, both: Column) -> Column:
    return F.array_join(F.concat(both, F.array_except(words, both)), " ")


def _ratio(common: Column, a: Column, b: Column) -> Column:
    """Share of two texts' characters that lie in their common subsequence; 1 for two empty texts."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(F.lit(2.0) * common / total)


def _set_ratio(common: Column, wa: Column, wb: Column, both: Column) -> Column:
    """Token-set score from the words, their common ones and the common subsequence of the texts of both."""
    a, b, shared = F.length(_set_text(wa, both)), F.length(_set_text(wb, both)), F.length(F.array_join(both, " "))
    by_words = F.greatest(F.lit(2.0) * common / (a + b), F.lit(2.0) * shared / (shared + a), F.lit(2.0) * shared / (shared + b))
    best = F.when(F.size(both) > 0, by_words).otherwise(F.lit(2.0) * common / (a + b))
    inside = (F.size(both) > 0) & ((F.size(both) == F.size(wa)) | (F.size(both) == F.size(wb)))
    return F.when((F.size(wa) == 0) | (F.size(wb) == 0), 0.0).when(inside, 1.0).otherwise(best)


# ------------------------------------------------------------------ scores
def indel_similarity(a: Column, b: Column) -> Column:
    return _ratio(_lcs(a, b), a, b)


def token_sort_similarity(a: Column, b: Column) -> Column:
    sa, sb = sorted_words(a), sorted_words(b)
    return _ratio(_lcs(sa, sb), sa, sb)


def token_set_similarity(a: Column, b: Column) -> Column:
    wa, wb = word_set(a), word_set(b)
    both = F.array_intersect(wa, wb)
    return _set_ratio(_lcs(_set_text(wa, both), _set_text(wb, both)), wa, wb, both)


def jaro_winkler(a: Column, b: Column) -> Column:
    return _jaro(a, b)


def pair_scores(pairs: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """pairs with struct ``name``: indel ratio, token-sort, token-set and Jaro-Winkler of two text columns."""
    x, y = F.col(a), F.col(b)
    staged = pairs.withColumns({"_wa": word_set(x), "_wb": word_set(y), "_sa": sorted_words(x), "_sb": sorted_words(y)})
    staged = staged.withColumn("_both", F.array_intersect("_wa", "_wb"))
    wa, wb, both = F.col("_wa"), F.col("_wb"), F.col("_both")
    staged = staged.withColumns({"_ja": _set_text(wa, both), "_jb": _set_text(wb, both)})
    staged = staged.withColumn("_f", _four(x, y, "_sa", "_sb", "_ja", "_jb"))
    f = F.col("_f")
    scores = F.struct(
        _ratio(f["ratio"], x, y).alias("ratio"), _ratio(f["sort"], F.col("_sa"), F.col("_sb")).alias("sort"),
        _set_ratio(f["set"], wa, wb, both).alias("set"), f["jaro"].alias("jaro"),
    )
    return staged.withColumn(name, scores).drop("_wa", "_wb", "_sa", "_sb", "_both", "_ja", "_jb", "_f")


def adaptive(scores: Column) -> Column:
    """Length-adaptive ratio: the plain ratio or a slightly discounted token ratio."""
    return F.greatest(scores["ratio"], scores["sort"] * 0.95, scores["set"] * 0.95)


# ------------------------------------------------------------------ bounds
def token_set_bound(a_words: Column, b_words: Column, letters: Column | None = None) -> Column:
    """Upper bound of the token-set score from word lists; 2.0 when the score is certainly 1.

    ``letters``, at least as many as the texts have in common, makes it tighter.
    """
    both = F.array_intersect(a_words, b_words)
    la, lb = F.length(F.array_join(a_words, " ")), F.length(F.array_join(b_words, " "))
    common = F.length(F.array_join(both, " "))
    certain = (F.size(both) > 0) & ((F.size(both) == F.size(a_words)) | (F.size(both) == F.size(b_words)))
    by_length = F.lit(2.0) * (F.least(la, lb) if letters is None else F.least(la, lb, letters)) / (la + lb)
    by_common = F.greatest(F.lit(2.0) * common / (common + la), F.lit(2.0) * common / (common + lb))
    bound = F.when(F.size(both) > 0, F.greatest(by_length, by_common)).otherwise(by_length)
    return F.when(certain, 2.0).when((la == 0) | (lb == 0), 0.0).otherwise(bound)

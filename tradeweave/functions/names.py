"""Name comparison: Jaro-Winkler similarity and fuzzy token matching."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the Winkler adjustment.
PREFIX_SCALE, PREFIX_MAX, BOOST_ABOVE = 0.1, 4, 0.7
_CHUNK_CELLS = 4_000_000


def _codes(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points as a zero-padded matrix, and the string lengths."""
    text = strings.astype(np.str_)
    width = max(text.dtype.itemsize // 4, 1)
    matrix = np.ascontiguousarray(text.astype(f"<U{width}")).view(np.uint32).reshape(len(text), width)
    return matrix, np.char.str_len(text)


def _jaro_chunk(first: np.ndarray, second: np.ndarray, prefix_scale: str) -> np.ndarray:
    left, n_left = _codes(first)
    right, n_right = _codes(second)
    rows = np.arange(len(left))
    reach = np.maximum(np.maximum(n_left, n_right) // 2 - 1, 0)
    widest = int(reach.max(initial=0))
    used_left = np.zeros(left.shape, dtype=bool)
    used_right = np.zeros(right.shape, dtype=bool)
    for j in range(right.shape[1]):
        low, high = max(0, j - widest), min(left.shape[1], j + widest + 1)
        if low >= high:
            break
        place = np.arange(low, high)
        free = (
            (left[:, low:high] == right[:, j, None])
            & ~used_left[:, low:high]
            & (np.abs(place - j)[None, :] <= reach[:, None])
            & (right[:, j, None] != 0)
        )
        hit = free.any(axis=1)
        used_left[rows[hit], low + free[hit].argmax(axis=1)] = True
        used_right[hit, j] = True
    matches = used_right.sum(axis=1)
    # Matched characters of either side, in order, line up by their rank.
    rank_left = np.argsort(~used_left, axis=1, kind="stable")
    rank_right = np.argsort(~used_right, axis=1, kind="stable")
    depth = min(left.shape[1], right.shape[1])
    ordered_left = np.take_along_axis(left, rank_left, axis=1)[:, :depth]
    ordered_right = np.take_along_axis(right, rank_right, axis=1)[:, :depth]
    counted = np.arange(depth)[None, :] < matches[:, None]
    swaps = ((ordered_left != ordered_right) & counted).sum(axis=1) // 2

    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = (matches / n_left + matches / n_right + (matches - swaps) / matches) / 3.0
    jaro = np.where(matches > 0, jaro, np.where((n_left == 0) & (n_right == 0), 1.0, 0.0))
    if prefix_scale == "none":
        return jaro
    head = min(PREFIX_MAX, depth)
    same = (left[:, :head] == right[:, :head]) & (left[:, :head] != 0)
    prefix = np.cumprod(same, axis=1).sum(axis=1)
    scale = np.full(len(left), PREFIX_SCALE)
    if prefix_scale == "capped":
        scale = np.minimum(scale, 1.0 / np.maximum(np.maximum(n_left, n_right), 1))
    return np.where(jaro > BOOST_ABOVE, jaro + prefix * scale * (1.0 - jaro), jaro)


def jaro_winkler_arrays(first, second, prefix_scale: str = "standard") -> np.ndarray:
    """Similarity in [0, 1] of two equally long sequences of strings.

    Rows are handled in order of length, so one long name does not widen the
    matrix of all the others.
    """
    first = np.asarray(first, dtype=object)
    second = np.asarray(second, dtype=object)
    lengths = np.array([max(len(a), len(b), 1) for a, b in zip(first, second)], dtype=np.int64)
    order = np.argsort(lengths, kind="stable")
    out = np.empty(len(first), dtype=np.float64)
    start = 0
    while start < len(order):
        stop = min(start + max(_CHUNK_CELLS // int(lengths[order[start]]), 1), len(order))
        while stop > start + 1 and (stop - start) * lengths[order[stop - 1]] > _CHUNK_CELLS:
            stop = start + (stop - start + 1) // 2
        rows = order[start:stop]
        out[rows] = _jaro_chunk(first[rows], second[rows], prefix_scale)
        start = stop
    return out


def jaro_winkler(first: Column, second: Column, prefix_scale: str = "standard") -> Column:
    """Column form; NULL when either side is NULL.

    ``prefix_scale`` is "standard", "capped" (at one over the longer length) or
    "none" (plain Jaro).
    """
    if prefix_scale not in ("standard", "capped", "none"):
        raise ValueError(f"unknown prefix scale: {prefix_scale}")

    @F.pandas_udf("double")
    def compare(a: pd.Series, b: pd.Series) -> pd.Series:
        known = (a.notna() & b.notna()).to_numpy()
        result = np.full(len(a), np.nan)
        if known.any():
            result[known] = jaro_winkler_arrays(a[known], b[known], prefix_scale)
        return pd.Series(result).where(known, None)

    return compare(first, second)


def fuzzy_vocabulary(left: DataFrame, right: DataFrame, max_edits: int = 2) -> DataFrame:
    """Pairs of distinct tokens within an edit distance, as (left_token, right_token, edits).

    A right token is cut into max_edits + 1 pieces.  Fewer edits than pieces
    leave one piece intact, shifted by at most max_edits places, so an equi-join
    on (length, piece number, piece text) finds every pair without comparing
    whole vocabularies.
    """
    pieces = max_edits + 1
    indexed = right.select(F.col("token").alias("right_token")).distinct().selectExpr(
        "right_token", "length(right_token) AS n", f"explode(sequence(0, {pieces - 1})) AS piece"
    ).selectExpr(
        "right_token",
        "n",
        "piece",
        f"substring(right_token, cast(floor(piece * n / {pieces}) AS int) + 1,"
        f" cast(floor((piece + 1) * n / {pieces}) AS int) - cast(floor(piece * n / {pieces}) AS int)) AS part",
    )
    probes = (
        left.select(F.col("token").alias("left_token")).distinct()
        .selectExpr(
            "left_token",
            "length(left_token) AS m",
            f"explode(sequence(greatest(length(left_token) - {max_edits}, 1), length(left_token) + {max_edits})) AS n",
        )
        .selectExpr("*", f"explode(sequence(0, {pieces - 1})) AS piece")
        .selectExpr(
            "*",
            f"cast(floor(piece * n / {pieces}) AS int) AS piece_start",
            f"cast(floor((piece + 1) * n / {pieces}) AS int) - cast(floor(piece * n / {pieces}) AS int) AS piece_length",
            f"explode(sequence({-max_edits}, {max_edits})) AS shift",
        )
        .where("piece_start + shift >= 0 AND piece_start + shift + piece_length <= m")
        .selectExpr(
            "left_token", "n", "piece",
            "substring(left_token, piece_start + shift + 1, piece_length) AS part",
        )
        .distinct()
    )
    return (
        probes.join(indexed, ["n", "piece", "part"])
        .select("left_token", "right_token")
        .distinct()
        .withColumn("edits", F.levenshtein("left_token", "right_token", max_edits).cast("long"))
        .where(F.col("edits") >= 0)
    )

"""Boosted stumps for groups of any size: splits are chosen from a table of bins, leaves from histograms of residuals."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quandrel.operators.blockfit import added, stepped
from quandrel.operators.ordered import written
from quandrel.operators.selection import exact_quantiles

#: Bins of a histogram of residuals; two of them, one inside a bin of the other, place a leaf's quantile.
LEAF_BINS = 1_024


def boosted(x: np.ndarray, base: list[float], stumps: list[list[list[float]]]) -> np.ndarray:
    """Predictions [levels, rows]."""
    out = np.repeat(np.asarray(base, dtype=float)[:, None], len(x), axis=1)
    for now, trees in zip(out, stumps):
        for j, cut, low, high in trees:
            now += np.where(x[:, int(j)] <= cut, low, high)
    return out


def boosted_stumps(blocks: DataFrame, keys: Sequence[str], levels: Sequence[float], rounds: int = 50, rate: float = 0.1, bins: int = 16) -> DataFrame:
    """(keys..., base array<double>, stumps array<array<array<double>>>) as calibrate.BoostedCalibration has them.

    A round is three sums over blocks: slopes of the loss by level, column and bin, from which the best split follows; then
    residuals of both leaves by bin, and by finer bins inside the one that holds the leaf's quantile.  A leaf is the value at
    the lower of the two ranks beside its level, without interpolation (in groups this large, neighbours hardly differ), up
    to the range of y by LEAF_BINS squared.
    """
    keys, levels = list(keys), [float(a) for a in levels]
    first = blocks.select(F.size(F.col("x")[0]).alias("p")).limit(1).collect()
    blank, lists = F.array().cast("array<array<array<double>>>"), "array<array<double>>"
    if not first:
        return blocks.select(*keys).distinct().select(*keys, F.lit(None).cast("array<double>").alias("base"), blank.alias("stumps"))
    p, shares, n_levels = first[0].p, [k / bins for k in range(1, bins)], len(levels)
    rows = blocks.select(*keys, F.inline(F.arrays_zip("x", "y")))
    wanted = [(F.col("x")[j], a) for j in range(p) for a in shares] + [(F.col("y"), a) for a in [*levels, 0.0, 1.0]]
    found = exact_quantiles(rows, keys, [v for v, _ in wanted], [a for _, a in wanted])
    at = len(shares) * p
    cuts = F.array(*(F.array_distinct(F.slice("q", j * len(shares) + 1, len(shares))) for j in range(p)))
    start = found.select(*keys, F.slice("q", at + 1, n_levels).alias("base"), F.array_repeat(F.array().cast(lists), n_levels).alias("stumps"), cuts.alias("cuts"), (F.col("q")[at + n_levels + 1] - F.col("q")[at + n_levels]).alias("reach"), F.array().cast(lists).alias("split"))
    now = written(start, "params")
    width = bins + 1

    def slopes(x: np.ndarray, y: np.ndarray, params: dict) -> np.ndarray:
        slope = np.where(y - boosted(x, params["base"], params["stumps"]) >= 0, np.array(levels)[:, None], np.array(levels)[:, None] - 1)
        out = np.zeros((n_levels + 1, p, width))
        for j, cut in enumerate(params["cuts"]):
            bin_of = np.searchsorted(cut, x[:, j], "left")
            out[-1, j] = np.bincount(bin_of, minlength=width)
            for i in range(n_levels):
                out[i, j] = np.bincount(bin_of, slope[i], width)
        return out.ravel()

    def choose(sums: np.ndarray, params: dict) -> dict:
        table = sums.reshape(n_levels + 1, p, width).cumsum(2)
        n, split = table[-1], []
        for i in range(n_levels):
            best = None
            for j, cut in enumerate(params["cuts"]):
                for k, c in enumerate(cut):
                    left, total = n[j, k], n[j, -1]
                    if 0 < left < total:
                        gain = table[i, j, k] ** 2 / left + (table[i, j, -1] - table[i, j, k]) ** 2 / (total - left)
                        if best is None or gain > best[0] * (1 + 1e-12):
                            best = (gain, float(j), float(c), float(left), float(total - left))
            split.append(list(best[1:]) if best else [])
        return {**plain(params), "split": split}

    def residuals(x: np.ndarray, params: dict):
        """Of each level with a split: its number, residuals' predictions, and the rows of the left leaf."""
        predicted = boosted(x, params["base"], params["stumps"])
        for i, s in enumerate(params["split"]):
            if len(s):
                yield i, predicted[i], x[:, int(s[0])] <= s[1]

    def coarse(x: np.ndarray, y: np.ndarray, params: dict) -> np.ndarray:
        out, reach = np.zeros((n_levels, 2, LEAF_BINS)), max(params["reach"], 1e-300)
        for i, p_i, left in residuals(x, params):
            place = np.clip(((y - p_i) / reach + 1) / 2 * LEAF_BINS, 0, LEAF_BINS - 1).astype(int)
            for leaf, rows_of in enumerate((left, ~left)):
                out[i, leaf] = np.bincount(place[rows_of], minlength=LEAF_BINS)
        return out.ravel()

    def narrow(sums: np.ndarray, params: dict) -> dict:
        split = []
        for i, s in enumerate(params["split"]):
            if len(s):
                for leaf in (0, 1):
                    upto = sums.reshape(n_levels, 2, LEAF_BINS)[i, leaf].cumsum()
                    rank = (s[2 + leaf] - 1) * levels[i]
                    b = int(np.searchsorted(upto, rank, "right"))
                    s = [*s, float(b), float(rank - (upto[b - 1] if b else 0))]
            split.append(list(s))
        return {**plain(params), "split": split}

    def fine(x: np.ndarray, y: np.ndarray, params: dict) -> np.ndarray:
        out, reach = np.zeros((n_levels, 2, LEAF_BINS)), max(params["reach"], 1e-300)
        for i, p_i, left in residuals(x, params):
            place = ((y - p_i) / reach + 1) / 2 * LEAF_BINS
            for leaf, rows_of in enumerate((left, ~left)):
                b = params["split"][i][4 + 2 * leaf]
                inside = rows_of & (np.clip(place, 0, LEAF_BINS - 1).astype(int) == int(b))
                out[i, leaf] = np.bincount(np.clip((place[inside] - b) * LEAF_BINS, 0, LEAF_BINS - 1).astype(int), minlength=LEAF_BINS)
        return out.ravel()

    def grow(sums: np.ndarray, params: dict) -> dict:
        stumps = [[list(t) for t in trees] for trees in params["stumps"]]
        for i, s in enumerate(params["split"]):
            if len(s):
                leaves = []
                for leaf in (0, 1):
                    upto = sums.reshape(n_levels, 2, LEAF_BINS)[i, leaf].cumsum()
                    b, rank = s[4 + 2 * leaf], s[5 + 2 * leaf]
                    k = int(np.searchsorted(upto, rank, "right"))
                    leaves.append(rate * ((b + (k + 0.5) / LEAF_BINS) / LEAF_BINS * 2 - 1) * params["reach"])
                stumps[i].append([float(s[0]), float(s[1]), *map(float, leaves)])
        return {**plain(params), "stumps": stumps, "split": []}

    def plain(params: dict) -> dict:
        return {"base": list(params["base"]), "stumps": [[list(t) for t in trees] for trees in params["stumps"]], "cuts": [list(c) for c in params["cuts"]], "reach": params["reach"]}

    for _ in range(rounds):
        for of_block, step in ((slopes, choose), (coarse, narrow), (fine, grow)):
            now = stepped(added(blocks, now, keys, of_block), now, keys, step)
    return now.select(*keys, "base", "stumps")

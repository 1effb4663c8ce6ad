"""Fits of groups of any size by sums: rows lie packed in blocks, each step adds one vector a group, parameters are a table.

A step joins the parameters to blocks, not to rows; a task adds what its blocks give before anything is shuffled; what is
added per group is salted once.  So a group with a third of all rows is as many tasks' work as it has blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quandrel.operators.ordered import written
from quandrel.operators.regression import quantile_regression

#: Rows of a block: 2^12.  Tasks' sums of a group are added in so many parts first.
PACK_BITS, PARTS = 12, 64
#: Groups of more rows are fitted by sums; smaller ones by one pandas frame each.
GROUP_ROWS = 1_000_000
#: Rounds of reweighting, share of the residuals' scale at which weights are cut off (first, last), and what it shrinks by.
ROUNDS, FLOORS, SHRINK = 24, (0.1, 1e-4), 0.7
#: Rows about a line that one frame solves exactly, with all others as two sums; halvings of the scale that are tried for them.
BAND_ROWS, HALVINGS, POLISH = 200_000, 40, 2


def packed(rows: DataFrame, keys: Sequence[str], x: Column, y: Column) -> DataFrame:
    """(keys..., x array<array<double>>, y array<double>): rows of finite values, as written blocks of 2^PACK_BITS at most."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    good = rows.select(*keys, x.alias("x"), y.cast("double").alias("y")).filter(finite(F.col("y")) & F.forall("x", finite))
    dealt = good.withColumn("_block", F.shiftright(F.monotonically_increasing_id(), PACK_BITS))
    blocks = dealt.groupBy(*keys, "_block").agg(F.collect_list(F.struct("x", "y")).alias("r"))
    return written(blocks.select(*keys, F.col("r.x").alias("x"), F.col("r.y").alias("y")), "blocks")


def added(blocks: DataFrame, params: DataFrame, keys: Sequence[str], of_block: Callable[[np.ndarray, np.ndarray, dict], np.ndarray]) -> DataFrame:
    """(keys..., sums array<double>): ``of_block`` (x, y, the group's parameters) added over all blocks of a group."""
    keys = list(keys)
    joined = blocks.join(params, keys)
    names = [c for c in params.columns if c not in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for i in range(len(batch)):
                key = tuple(batch.column(c)[i].as_py() for c in keys)
                xs, ys = batch.column("x")[i].values, batch.column("y")[i].values
                x = xs.flatten().to_numpy(zero_copy_only=False).reshape(len(xs), -1)
                got = of_block(x, ys.to_numpy(zero_copy_only=False), {n: batch.column(n)[i].as_py() for n in names})
                sums[key] = sums[key] + got if key in sums else got
        if sums:
            columns = [pa.array([k[i] for k in sums], batch.schema.field(c).type) for i, c in enumerate(keys)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(sums.values()), pa.list_(pa.float64()))], [*keys, "sums"])

    schema = T.StructType([blocks.schema[c] for c in keys] + [T.StructField("sums", T.ArrayType(T.DoubleType()))])
    partial = joined.mapInArrow(run, schema).withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))

    def total(frame: pd.DataFrame) -> pd.DataFrame:
        return frame[keys].iloc[:1].assign(sums=[np.sum(np.stack(frame["sums"].to_list()), axis=0)])

    return partial.groupBy(*keys, "_part").applyInPandas(total, schema).groupBy(*keys).applyInPandas(total, schema)


def stepped(sums: DataFrame, params: DataFrame, keys: Sequence[str], step: Callable[[np.ndarray, dict], dict]) -> DataFrame:
    """The parameters after ``step`` (sums, parameters of the group), as a written table."""
    names = [c for c in params.columns if c not in keys]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [step(np.asarray(s, dtype=float), dict(zip(names, p))) for s, *p in zip(frame["sums"], *(frame[n] for n in names))]
            yield frame[list(keys)].assign(**{n: [o[n] for o in out] for n in names})

    return written(params.join(sums, list(keys)).select(*params.columns, "sums").mapInPandas(run, params.schema), "params")


# quantile regression ----------------------------------------------------------------------------------------------------
def quantile_lines(blocks: DataFrame, keys: Sequence[str], levels: Sequence[float], columns: Sequence[Sequence[int]] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(keys..., beta array<array<double>>, loss array<double>): coefficients of each level, and their mean pinball loss.

    A level uses all of x, or its ``columns`` of x, as many as any other.

    First reweighted least squares: weights are the pinball slopes over residuals, cut off at a share of the residuals' scale
    that shrinks.  Every round adds normal equations by group; the coefficients of the least loss so far are kept.  Then the
    rows nearest to a line, up to BAND_ROWS, are solved in one frame; the others are added up to one row above and one below
    it, which have the same loss while they stay there (Portnoy and Koenker, 1997).  The loss over all rows decides whether
    the new line is better, and gives the next band.  Collinear columns are allowed: solutions have the least norm.
    """
    levels = [float(x) for x in levels]
    width = blocks.select(F.size(F.col("x")[0]).alias("p")).limit(1).collect()
    params = blocks.select(*keys).distinct()
    if not width:
        return params.select(*keys, F.lit(None).cast("array<array<double>>").alias("beta"), F.lit(None).cast("array<double>").alias("loss"))
    full, n_levels = width[0].p, len(levels)
    columns = [list(range(full))] * n_levels if columns is None else [list(c) for c in columns]
    p = len(columns[0])
    each = p * p + p + 1 + HALVINGS

    def squares(x: np.ndarray, y: np.ndarray, _: dict) -> np.ndarray:
        return np.concatenate([(x.T @ x).ravel(), x.T @ y, [float(y @ y), float(y.sum()), len(y)]])

    def begin(sums: np.ndarray, _: dict) -> dict:
        xx, xy = sums[: full * full].reshape(full, full), sums[full * full : full * full + full]
        many = [np.linalg.lstsq(xx[np.ix_(c, c)], xy[c], rcond=None)[0].tolist() for c in columns]
        yy, total, n = sums[-3:]
        scale = max(float(np.sqrt(max(yy / n - (total / n) ** 2, 0.0))), 1e-12)
        return {"now": many, "beta": many, "loss": [float("inf")] * n_levels, "band": [0.0] * n_levels, "scale": scale, "floor": FLOORS[0]}

    def weighted(x: np.ndarray, y: np.ndarray, params: dict) -> np.ndarray:
        out, floor = [], params["floor"] * params["scale"]
        for level, beta, c in zip(levels, params["now"], columns):
            z = x[:, c]
            r = y - z @ np.asarray(beta)
            w = np.where(r >= 0, level, 1 - level)
            out += [w @ np.abs(r), *np.searchsorted(np.sort(np.abs(r)), params["scale"] * 4.0 / 2.0 ** np.arange(HALVINGS), "right")]
            w = w / np.maximum(np.abs(r), floor)
            zw = z * w[:, None]
            out += [*(zw.T @ z).ravel(), *(zw.T @ y)]
        return np.array([*out, len(y)])

    def next_lines(sums: np.ndarray, params: dict) -> dict:
        now, best, loss, band = [], [], [], []
        for i in range(n_levels):
            part = sums[i * each : (i + 1) * each]
            value, known, better = float(part[0] / sums[-1]), params["loss"][i], False
            better = value < known
            best.append(list(params["now"][i]) if better else list(params["beta"][i]))
            loss.append(min(value, known))
            fits = np.flatnonzero(part[1 : 1 + HALVINGS] <= BAND_ROWS)
            reach = params["scale"] * 4.0 / 2.0 ** (fits[0] if len(fits) else HALVINGS)
            band.append(float("inf") if sums[-1] <= BAND_ROWS else float(reach) if better else params["band"][i] / 2)
            xx = part[1 + HALVINGS : 1 + HALVINGS + p * p].reshape(p, p)
            now.append(np.linalg.lstsq(xx, part[1 + HALVINGS + p * p :], rcond=None)[0].tolist())
        return {"now": now, "beta": best, "loss": loss, "band": band, "scale": params["scale"], "floor": max(params["floor"] * SHRINK, FLOORS[1])}

    blank = "array<array<double>>"
    nulls = {"now": blank, "beta": blank, "loss": "array<double>", "band": "array<double>", "scale": "double", "floor": "double"}
    now = stepped(added(blocks, params, keys, squares), params.select(*keys, *(F.lit(None).cast(t).alias(c) for c, t in nulls.items())), keys, begin)
    for _ in range(rounds):
        now = stepped(added(blocks, now.select(*keys, "now", "scale", "floor"), keys, weighted), now, keys, next_lines)
    for _ in range(POLISH):
        solved = near_lines(blocks, now.select(*keys, "beta", "band"), keys, levels, columns)
        tried = written(now.drop("now").join(solved, list(keys)).select(*now.columns), "params")
        now = stepped(added(blocks, tried.select(*keys, "now", "scale", "floor"), keys, weighted), tried, keys, next_lines)
    return now.select(*keys, "beta", "loss")


def near_lines(blocks: DataFrame, params: DataFrame, keys: Sequence[str], levels: Sequence[float], columns: Sequence[Sequence[int]]) -> DataFrame:
    """(keys..., now): each level's line, solved from the rows within ``band`` of ``beta`` and the sums of those above and below."""
    keys = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            kept: dict[tuple, list] = {}
            for i in range(len(batch)):
                key = tuple(batch.column(c)[i].as_py() for c in keys)
                xs, y = batch.column("x")[i].values, batch.column("y")[i].values.to_numpy(zero_copy_only=False)
                x = xs.flatten().to_numpy(zero_copy_only=False).reshape(len(xs), -1)
                for j, (c, beta, band) in enumerate(zip(columns, batch.column("beta")[i].as_py(), batch.column("band")[i].as_py())):
                    rows = np.column_stack([x[:, c], y])
                    r = y - x[:, c] @ np.asarray(beta)
                    far = np.stack([rows[r > band].sum(0), rows[r < -band].sum(0)])
                    sums[*key, j] = sums.get((*key, j), 0) + far
                    kept.setdefault((*key, j), []).append(rows[np.abs(r) <= band])
            yield sent(batch.schema, {k: np.concatenate(v) for k, v in kept.items()})
        if sums:
            yield sent(batch.schema, {k: v[np.any(v != 0, axis=1)] for k, v in sums.items()})

    def sent(schema: pa.Schema, parts: dict[tuple, np.ndarray]) -> pa.RecordBatch:
        names = [pa.array([k[i] for k in parts], schema.field(c).type) for i, c in enumerate(keys)]
        return pa.RecordBatch.from_arrays([*names, pa.array([k[-1] for k in parts], pa.int32()), pa.array([v.ravel() for v in parts.values()], pa.list_(pa.float64()))], [*keys, "level", "rows"])

    width, at = len(columns[0]) + 1, list(levels)

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        rows = np.concatenate(frame["rows"].to_list()).reshape(-1, width)
        beta = quantile_regression(rows[:, :-1], rows[:, -1], at[int(frame["level"].iloc[0])])
        return frame[[*keys, "level"]].iloc[:1].assign(line=[beta.tolist()])

    fields = [blocks.schema[c] for c in keys] + [T.StructField("level", T.IntegerType())]
    near = blocks.join(params, keys).mapInArrow(run, T.StructType([*fields, T.StructField("rows", T.ArrayType(T.DoubleType()))]))
    lines = near.groupBy(*keys, "level").applyInPandas(solve, T.StructType([*fields, T.StructField("line", T.ArrayType(T.DoubleType()))]))
    return lines.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "line"))), lambda v: v["line"]).alias("now"))


# normal likelihood ------------------------------------------------------------------------------------------------------
def normal_lines(blocks: DataFrame, keys: Sequence[str], start: DataFrame, rounds: int = 60) -> DataFrame:
    """(keys..., a, b, c, d, nll): y is normal about a + b m with deviation c + d s, by damped Newton steps on (a, b, ln c, ln d).

    Blocks hold x = [m, s]; ``start`` has a, b, c, d by group, c and d positive.  Every round adds the likelihood, its
    gradient and its Hessian by group.  A step that makes the likelihood worse is taken back and damped more.  A group whose
    deviation isn't positive somewhere at the start keeps the start, and has a null nll.
    """

    def terms(x: np.ndarray, y: np.ndarray, params: dict) -> np.ndarray:
        a, b, lc, ld = params["at"]
        c, d = np.exp(lc), np.exp(ld)
        m, s = x[:, 0], x[:, 1]
        sigma = c + d * s
        if (sigma <= 0).any():
            return np.full(21, np.inf)
        z, inv = (y - a - b * m) / sigma, 1 / sigma
        parts = np.stack([-inv, -inv * m])  # dz by a, b
        slopes = np.stack([np.full(len(s), c), d * s])  # d sigma by ln c, ln d
        of_sigma = inv * (1 - z * z)
        grad = [*(parts @ z), *(slopes @ of_sigma)]
        hess = np.zeros((4, 4))
        hess[:2, :2] = parts @ parts.T
        curve = inv * inv * (3 * z * z - 1)
        hess[2:, 2:] = (slopes * curve) @ slopes.T + np.diag(slopes @ of_sigma)
        cross = (parts * (-2 * z * inv)) @ slopes.T
        hess[:2, 2:], hess[2:, :2] = cross, cross.T
        return np.array([float(np.sum(np.log(sigma) + 0.5 * z * z)), *grad, *hess.ravel()])

    def step(sums: np.ndarray, params: dict) -> dict:
        value, old = float(sums[0]), params["nll"]
        at, damping, best = np.asarray(params["at"], dtype=float), params["damping"], list(params["best"])
        grad, hess = sums[1:5], sums[5:21].reshape(4, 4)
        gain = old - value
        if np.isfinite(value) and (np.isinf(old) or gain >= 0):
            best, old, damping = at.tolist(), value, max(damping / 4, 1e-9)
            state = [*grad.tolist(), *hess.ravel().tolist()]
        else:
            damping, state = damping * 8, list(params["state"])
            if np.isinf(old):
                return {**params, "still": 9}
        grad, hess = np.array(state[:4]), np.array(state[4:]).reshape(4, 4)
        spread = np.maximum(np.abs(np.diag(hess)), 1e-8)
        values, vectors = np.linalg.eigh(hess / np.sqrt(np.outer(spread, spread)))
        bent = vectors @ np.diag(1 / (np.maximum(np.abs(values), 1e-10) + damping)) @ vectors.T
        move = -(bent @ (grad / np.sqrt(spread))) / np.sqrt(spread)
        move[2:] = np.clip(move[2:], -2, 2)
        decrement = float(-(grad @ move))
        still = params["still"] + 1 if decrement < 1e-9 * max(1.0, abs(old)) else 0
        return {"at": (np.array(best) + move).tolist(), "best": best, "nll": old, "damping": damping, "state": state, "still": still}

    first = F.array("a", "b", F.ln("c"), F.ln("d"))
    now = written(blocks.select(*keys).distinct().join(start, list(keys)).select(*keys, first.alias("at"), first.alias("best"), F.lit(float("inf")).alias("nll"), F.lit(1e-3).alias("damping"), F.array_repeat(F.lit(0.0), 20).alias("state"), F.lit(0).alias("still")), "params")
    for _ in range(rounds):
        now = stepped(added(blocks, now.select(*keys, "at"), keys, terms), now, keys, step)
        if not now.filter("still < 2").limit(1).collect():
            break
    best = F.col("best")
    return now.select(*keys, best[0].alias("a"), best[1].alias("b"), F.exp(best[2]).alias("c"), F.exp(best[3]).alias("d"), F.when(~F.col("nll").isin(float("inf")), F.col("nll")).alias("nll"))


def by_size(blocks: DataFrame, keys: Sequence[str], group_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """(blocks of groups of up to ``group_rows`` rows, blocks of larger ones or None), after a job that counts."""
    sizes = blocks.groupBy(*keys).agg(F.sum(F.size("y")).alias("_n")).filter(F.col("_n") > group_rows).select(*keys)
    if not sizes.limit(1).collect():
        return blocks, None
    large = written(sizes, "large")
    return blocks.join(large, list(keys), "left_anti"), blocks.join(large, list(keys), "left_semi")


def together(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) of one group's blocks."""
    return np.concatenate([np.stack(b) for b in frame["x"]]).astype(float), np.concatenate(frame["y"].to_list()).astype(float)

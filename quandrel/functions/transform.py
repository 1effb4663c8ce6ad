"""Target transforms with inverses, as column expressions; fitted ones take their parameters from a grouped table."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Transform:
    """``name`` is none, log, arcsinh, yeo-johnson or box-cox; ``epsilon`` is added before log.

    forward() and inverse() take the fitted parameters lmbda, mean and std as columns, null or absent for the first three.
    """

    name: str = "none"
    epsilon: float = 1e-8
    standardize: bool = True

    def __post_init__(self) -> None:
        if self.name not in ("none", "log", "arcsinh", "yeo-johnson", "box-cox"):
            raise ValueError(f"unknown transform {self.name!r}")

    @property
    def fitted(self) -> bool:
        return self.name in ("yeo-johnson", "box-cox")

    def forward(self, y: Column, lmbda: Column | None = None, mean: Column | None = None, std: Column | None = None) -> Column:
        if self.name == "none":
            return y
        if self.name == "log":
            return F.ln(y + self.epsilon)
        if self.name == "arcsinh":
            return F.asinh(y)
        z = yeo_johnson(y, lmbda) if self.name == "yeo-johnson" else box_cox(y, lmbda)
        return (z - mean) / std if self.standardize and mean is not None else z

    def inverse(self, z: Column, lmbda: Column | None = None, mean: Column | None = None, std: Column | None = None) -> Column:
        if self.name == "none":
            return z
        if self.name == "log":
            return F.exp(z) - self.epsilon
        if self.name == "arcsinh":
            return F.sinh(z)
        z = z * std + mean if self.standardize and mean is not None else z
        return yeo_johnson_inverse(z, lmbda) if self.name == "yeo-johnson" else box_cox_inverse(z, lmbda)

    def fit(self, rows: DataFrame, by: list[str], target: str = "target", lo: float = -2.0, hi: float = 3.0, rounds: int = 4, points: int = 21) -> DataFrame:
        """(by..., lmbda, mean, std): the power that maximises the profile log-likelihood in each group.

        Each round is one grouped pass over a grid of ``points`` powers; the next grid is about the best of the last.
        """
        if not self.fitted:
            return rows.select(*by).distinct().withColumns({c: F.lit(None).cast("double") for c in ("lmbda", "mean", "std")})
        power = yeo_johnson if self.name == "yeo-johnson" else box_cox
        some = rows.filter(F.col(target).isNotNull() if self.name == "yeo-johnson" else F.col(target) > 0)
        y = F.col(target)
        jacobian = F.signum(y) * F.log1p(F.abs(y)) if self.name == "yeo-johnson" else F.ln(y)
        best = some.select(*by).distinct().withColumns({"mid": F.lit((lo + hi) / 2), "half": F.lit((hi - lo) / 2)})
        for _ in range(rounds):
            grid = some.join(best, by)
            scores = []
            for i in range(points):
                at = F.col("mid") + F.col("half") * (2 * i / (points - 1) - 1)
                likelihood = -F.count(y) / 2 * F.ln(F.var_pop(power(y, at))) + (F.first("mid") + F.first("half") * (2 * i / (points - 1) - 1) - 1) * F.sum(jacobian)
                scores.append(F.struct(F.coalesce(likelihood, F.lit(-math.inf)).alias("l"), F.lit(-i).alias("i")))
            found = grid.groupBy(*by).agg(F.array_max(F.array(*scores)).alias("top"), F.first("mid").alias("mid"), F.first("half").alias("half"))
            step = 2 / (points - 1)
            best = found.select(*by, (F.col("mid") + F.col("half") * (-F.col("top.i") * step - 1)).alias("mid"), (F.col("half") * step).alias("half"))
        powers = best.select(*by, F.col("mid").alias("lmbda"))
        moments = some.join(powers, by).groupBy(*by, "lmbda").agg(F.avg(power(y, F.col("lmbda"))).alias("mean"), F.stddev_pop(power(y, F.col("lmbda"))).alias("std"))
        return moments.withColumn("std", F.when(F.col("std") > 0, F.col("std")).otherwise(1.0))


def yeo_johnson(y: Column, lmbda: Column) -> Column:
    pos = F.when(F.abs(lmbda) < 1e-12, F.log1p(y)).otherwise((F.pow(y + 1, lmbda) - 1) / F.nullif(lmbda, F.lit(0.0)))
    neg = F.when(F.abs(lmbda - 2) < 1e-12, -F.log1p(-y)).otherwise(-(F.pow(1 - y, 2 - lmbda) - 1) / F.nullif(2 - lmbda, F.lit(0.0)))
    return F.when(y >= 0, pos).when(y < 0, neg)


def yeo_johnson_inverse(z: Column, lmbda: Column) -> Column:
    pos = F.when(F.abs(lmbda) < 1e-12, F.expm1(z)).otherwise(F.pow(z * lmbda + 1, 1 / F.nullif(lmbda, F.lit(0.0))) - 1)
    neg = F.when(F.abs(lmbda - 2) < 1e-12, -F.expm1(-z)).otherwise(1 - F.pow(1 - z * (2 - lmbda), 1 / F.nullif(2 - lmbda, F.lit(0.0))))
    return F.when(z >= 0, pos).when(z < 0, neg)


def box_cox(y: Column, lmbda: Column) -> Column:
    return F.when(y > 0, F.when(F.abs(lmbda) < 1e-12, F.ln(y)).otherwise((F.pow(y, lmbda) - 1) / F.nullif(lmbda, F.lit(0.0))))


def box_cox_inverse(z: Column, lmbda: Column) -> Column:
    return F.when(F.abs(lmbda) < 1e-12, F.exp(z)).otherwise(F.pow(z * lmbda + 1, 1 / F.nullif(lmbda, F.lit(0.0))))

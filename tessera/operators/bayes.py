"""Bayesian linear models, Metropolis chains and their diagnostics, polynomial fits."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.inference import _moments, linear_regression


def bayesian_linear(df: DataFrame, y: str, xs: list[str], prior_sd: float = 1e3) -> DataFrame:
    """(term, mean, sd, low, high, log_evidence): conjugate normal prior, noise variance from least squares, 95% intervals."""
    m, means = _moments(df, [*xs, y])
    shift = np.eye(len(m))
    shift[1:, 0] = means
    m = shift @ m @ shift.T  # of the columns themselves, which the prior is about
    a, b, yy, n = m[:-1, :-1], m[:-1, -1], m[-1, -1], m[0, 0]
    beta = np.linalg.lstsq(a, b, rcond=None)[0]
    noise = max((yy - 2 * beta @ b + beta @ a @ beta) / max(1.0, n - len(b)), 1e-12)
    precision = a / noise + np.eye(len(b)) / prior_sd**2
    cov = np.linalg.inv(precision)
    mean = cov @ b / noise
    evidence = 0.5 * (-n * np.log(2 * np.pi * noise) - len(b) * np.log(prior_sd**2) - np.linalg.slogdet(precision)[1] - yy / noise + mean @ precision @ mean)
    sd = np.sqrt(np.diag(cov))
    rows = [(t, float(u), float(s), float(u - 1.96 * s), float(u + 1.96 * s), float(evidence)) for t, u, s in zip(["intercept", *xs], mean, sd, strict=True)]
    return df.sparkSession.createDataFrame(rows, "term string, mean double, sd double, low double, high double, log_evidence double")


def metropolis(spark: SparkSession, log_posterior: Callable[[np.ndarray], float], start: list[float], step: list[float], samples: int, chains: int = 4, burn_in: int = 500, seed: int = 0) -> DataFrame:
    """(chain, sample, accepted, x): random-walk chains, one task each."""

    def run(batches):
        for pdf in batches:
            for chain in pdf["id"]:
                rng = np.random.default_rng([seed, int(chain)])
                x, rows = np.array(start, dtype=float), []
                p = log_posterior(x)
                for i in range(burn_in + samples):
                    new = x + rng.normal(size=len(x)) * step
                    q = log_posterior(new)
                    took = np.log(rng.random()) < q - p
                    if took:
                        x, p = new, q
                    if i >= burn_in:
                        rows.append((int(chain), i - burn_in, bool(took), x.tolist()))
                yield pd.DataFrame(rows, columns=["chain", "sample", "accepted", "x"])

    return spark.range(0, chains, 1, chains).mapInPandas(run, "chain int, sample int, accepted boolean, x array<double>")


def gelman_rubin(samples: DataFrame) -> DataFrame:
    """(dim, r_hat, mean, acceptance) of every dimension of metropolis chains."""
    long = samples.select("chain", F.col("accepted").cast("double").alias("a"), F.posexplode("x").alias("dim", "v"))
    per = long.groupBy("dim", "chain").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.var_samp("v").alias("s"), F.avg("a").alias("a"))
    n, w = F.max("n"), F.avg("s")
    return per.groupBy("dim").agg(F.sqrt(((n - 1) / n * w + F.var_samp("m")) / F.nullif(w, F.lit(0.0))).alias("r_hat"), F.avg("m").alias("mean"), F.avg("a").alias("acceptance"))


def thinned(samples: DataFrame, every: int) -> DataFrame:
    """Each ``every``-th sample of each chain."""
    return samples.where(F.col("sample") % every == 0)


def effective_sizes(samples: DataFrame) -> DataFrame:
    """(chain, dim, n, autocorrelation_time, effective_size) of metropolis chains, one task each chain and dimension.

    The time is the sum of the autocorrelations up to a quarter of the length or
    the first that is not positive; the size is n / (1 + 2 time), at least 1.
    """
    long = samples.select("chain", "sample", F.posexplode("x").alias("dim", "v"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("sample")["v"].to_numpy()
        n, d = len(v), v - v.mean()
        base, time = float(d @ d), 0.0
        for lag in range(1, n // 4):
            r = float(d[:-lag] @ d[lag:]) / base if base > 0 else 0.0
            if r <= 0:
                break
            time += r
        return pd.DataFrame({"chain": [pdf["chain"].iloc[0]], "dim": [pdf["dim"].iloc[0]], "n": [n], "autocorrelation_time": [time], "effective_size": [max(1.0, n / (1 + 2 * time))]})

    return long.groupBy("chain", "dim").applyInPandas(run, "chain int, dim int, n long, autocorrelation_time double, effective_size double")


def polynomial_fit(df: DataFrame, x: str, y: str, degree: int) -> DataFrame:
    """(power, coefficient) by least squares."""
    powers = df.select(F.col(y).cast("double").alias("__y"), *[F.pow(F.col(x).cast("double"), F.lit(float(d))).alias(f"p{d}") for d in range(1, degree + 1)])
    fit = linear_regression(powers, "__y", [f"p{d}" for d in range(1, degree + 1)])
    return fit.select(F.when(F.col("term") == "intercept", 0).otherwise(F.substring("term", 2, 5).try_cast("int")).alias("power"), "coefficient")


def polynomial_roots(coefficients: list[float]) -> list[complex]:
    """All complex roots, lowest coefficient first."""
    return np.roots(coefficients[::-1]).tolist()

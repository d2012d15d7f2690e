"""Kernel novelty detector standing in for the one-class SVM (M3).

An exact one-class SVM is an O(n^2) solver on one machine.  Its RBF
kernel is approximated with random Fourier features (Rahimi & Recht,
2007): phi(x) = sqrt(2 / D) cos(W x + b), W ~ N(0, 2 gamma), b ~ U(0, 2 pi),
gamma = 1 / (features x variance) ("scale").  The mean embedding mu is one
aggregate over the training rows; the novelty score is -phi(x) . mu (the
Parzen limit of the one-class SVM), and the top ``nu`` share is flagged.
All of it is Catalyst arithmetic: one aggregate, one projection.
"""

from __future__ import annotations

import math
from typing import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.knn import top_share
from ..schema import SAMPLE

N_COMPONENTS = 256  # 64 is too noisy to rank far points reliably
RFF_SEED = 7


def rff_constants(dim: int, n_components: int = N_COMPONENTS, seed: int = RFF_SEED):
    """Unit-variance directions and phases drawn once from a fixed seed."""
    rng = np.random.RandomState(seed)
    return rng.standard_normal((n_components, dim)), rng.uniform(0.0, 2.0 * math.pi, n_components)


def gamma_scale(df: DataFrame, features: Sequence[str]) -> float:
    """1 / (d x population variance of all feature values).  One aggregate;
    the result is a model parameter (a number), not data."""
    d = len(features)
    means = df.agg(*[F.avg(c).alias(c) for c in features]).first()
    mean = sum((means[c] for c in features), 0.0) / d
    sq = df.agg(*[F.avg((F.col(c) - F.lit(mean)) * (F.col(c) - F.lit(mean))).alias(c)
                  for c in features]).first()
    var = sum((sq[c] for c in features), 0.0) / d
    return 1.0 / (d * var) if var > 0 else 1.0


def embedding(features: Sequence[str], gamma: float, n_components: int = N_COMPONENTS,
              seed: int = RFF_SEED) -> list[Column]:
    w0, b = rff_constants(len(features), n_components, seed)
    scale = math.sqrt(2.0 * gamma)
    amp = math.sqrt(2.0 / n_components)
    out = []
    for k in range(n_components):
        z = sum((F.col(c) * F.lit(float(w0[k, j])) for j, c in enumerate(features)), F.lit(0.0))
        out.append((F.lit(amp) * F.cos(z * F.lit(scale) + F.lit(float(b[k])))).alias(f"_phi{k}"))
    return out


def fit(train: DataFrame, features: Sequence[str], n_components: int = N_COMPONENTS,
        seed: int = RFF_SEED) -> dict:
    """Model = gamma and the mean embedding of the training rows (two
    aggregates over ``train``; n_components numbers)."""
    feats = list(features)
    g = gamma_scale(train, feats)
    mu_row = train.select(*embedding(feats, g, n_components, seed)).agg(
        *[F.avg(f"_phi{k}").alias(f"m{k}") for k in range(n_components)]).first()
    return {"features": feats, "gamma": g, "mu": [mu_row[f"m{k}"] for k in range(n_components)],
            "n_components": n_components, "seed": seed}


def score(model: dict, df: DataFrame, nu: float | None = 0.01, id_col: str = SAMPLE) -> DataFrame:
    feats, mu = model["features"], model["mu"]
    emb = df.select("*", *embedding(feats, model["gamma"], model["n_components"], model["seed"]))
    s = sum((F.col(f"_phi{k}") * F.lit(float(mu[k])) for k in range(len(mu))), F.lit(0.0))
    scored = emb.select(*df.columns, (-s).alias("novelty_score"))
    return scored if nu is None else top_share(scored, "novelty_score", nu, "is_novel", id_col)


def kernel_novelty(train: DataFrame, df: DataFrame, features: Sequence[str], nu: float = 0.01,
                   n_components: int = N_COMPONENTS, seed: int = RFF_SEED, id_col: str = SAMPLE) -> DataFrame:
    """Novelty score of every row of ``df`` against ``train``; top ``nu`` flagged."""
    return score(fit(train, features, n_components, seed), df, nu, id_col)

"""Sufficient statistics of correspondences, closed-form errors, normal equations, fits."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.session import ship

AXES = "xyz"


def sums(pairs: DataFrame, keys: Sequence[str], p: Sequence[str], q: Sequence[str], w: str) -> DataFrame:
    """28 independent sums by key: weight, weighted points and outer products (pq 9; pp and qq 6 each, symmetric)."""
    p_, q_, w_ = [F.col(c) for c in p], [F.col(c) for c in q], F.col(w)
    out = [F.sum(w_).alias("w")]
    out += [F.sum(w_ * p_[i]).alias(f"p{AXES[i]}") for i in range(3)] + [F.sum(w_ * q_[i]).alias(f"q{AXES[i]}") for i in range(3)]
    out += [F.sum(w_ * p_[i] * q_[j]).alias(f"pq{AXES[i]}{AXES[j]}") for i in range(3) for j in range(3)]
    for n, v in (("pp", p_), ("qq", q_)):
        out += [F.sum(w_ * v[i] * v[j]).alias(f"{n}{AXES[i]}{AXES[j]}") for i in range(3) for j in range(i, 3)]
    return pairs.groupBy(*keys).agg(*out)


def squared_error(r: Sequence[float], t: Sequence[float]) -> Column:
    """Sum of w |R p + t - q|^2 from the sums alone."""
    c = F.col
    e = sum((c(f"{n}{a}{a}") for n in ("pp", "qq") for a in AXES), F.lit(0.0)) + c("w") * float(np.dot(t, t))
    for i in range(3):
        rp = sum((c(f"p{AXES[j]}") * float(r[3 * i + j]) for j in range(3)), F.lit(0.0))
        e = e + 2 * float(t[i]) * (rp - c(f"q{AXES[i]}"))
        for j in range(3):
            e = e - 2 * float(r[3 * i + j]) * c(f"pq{AXES[j]}{AXES[i]}")
    return e


def error(r: Sequence[float], t: Sequence[float]) -> Column:
    """sqrt(E) / w; a negative E, by rounding, stays as it is; 0 without weight."""
    e = squared_error(r, t)
    return F.when(F.col("w") == 0, F.lit(0.0)).otherwise(F.when(e >= 0, F.sqrt(F.abs(e)) / F.col("w")).otherwise(e))


def by_frame(edges: DataFrame, a: str, b: str, value: str, weight: str) -> DataFrame:
    """Weighted error, weight and degree of both ends; too little weight is marked by 1e8."""
    ends = edges.select(F.explode(F.array(a, b)).alias("frame"), value, weight)
    s = ends.groupBy("frame").agg(F.sum(F.col(value) * F.col(weight)).alias("e"), F.sum(weight).alias("weight"), F.count(F.lit(1)).alias("degree"))
    return s.select("frame", F.when(F.col("weight") < 1, F.lit(1e8)).otherwise(F.col("e") / F.col("weight")).alias("error"), "weight", "degree")


def kabsch(spq: np.ndarray, sp: np.ndarray, sq: np.ndarray, w: float) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and translation that take p to q, from the sums; a reflection is turned into a rotation."""
    cov = spq - np.outer(sp, sq) / w
    u, _, vt = np.linalg.svd(cov)
    d = np.sign(np.linalg.det(vt.T @ u.T)) or 1.0
    r = vt.T @ np.diag([1, 1, d]) @ u.T
    return r, sq / w - r @ sp / w


def fitted(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, r array(9), t array(3)) by the sums of each key: one small row each."""
    ship(stats.sparkSession)
    kinds = ", ".join(f"{k} {stats.schema[k].dataType.simpleString()}" for k in keys)

    def fit(it):
        for pdf in it:
            rows = []
            for row in pdf.to_dict("records"):
                spq = np.array([[row[f"pq{a}{b}"] for b in AXES] for a in AXES])
                r, t = kabsch(spq, np.array([row[f"p{a}"] for a in AXES]), np.array([row[f"q{a}"] for a in AXES]), row["w"])
                rows.append({**{k: row[k] for k in keys}, "r": r.ravel().tolist(), "t": t.tolist()})
            yield pd.DataFrame(rows, columns=[*keys, "r", "t"])

    return stats.where("w > 0").mapInPandas(fit, f"{kinds}, r array<double>, t array<double>")


def covariance(points: DataFrame, keys: Sequence[str], axes: Sequence[str]) -> DataFrame:
    """Means and population covariances by key."""
    out = [F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(f"m{i}") for i, a in enumerate(axes)]]
    out += [F.covar_pop(axes[i], axes[j]).alias(f"c{i}{j}") for i in range(len(axes)) for j in range(i, len(axes))]
    return points.groupBy(*keys).agg(*out)


def planes(points: DataFrame, keys: Sequence[str], axes: Sequence[str]) -> DataFrame:
    """(keys, n, normal, offset, flatness) by key from the covariances: the direction of least variance; for two axes a line."""
    ship(points.sparkSession)
    cov = covariance(points, keys, axes)
    kinds = ", ".join(f"{k} {cov.schema[k].dataType.simpleString()}" for k in keys)
    d = len(axes)

    def fit(it):
        for pdf in it:
            rows = []
            for row in pdf.to_dict("records"):
                c = np.array([[row[f"c{min(i, j)}{max(i, j)}"] for j in range(d)] for i in range(d)])
                values, vectors = np.linalg.eigh(c)
                normal = vectors[:, 0]
                normal = normal * (np.sign(normal[np.abs(normal).argmax()]) or 1.0)
                mean = np.array([row[f"m{i}"] for i in range(d)])
                flat = float(np.sqrt(max(values[0], 0)) / max(np.sqrt(max(values[1], 0)), 1e-12))
                rows.append({**{k: row[k] for k in keys}, "n": row["n"], "normal": normal.tolist(), "offset": float(-normal @ mean), "flatness": flat})
            yield pd.DataFrame(rows, columns=[*keys, "n", "normal", "offset", "flatness"])

    return cov.where("n >= 3").mapInPandas(fit, f"{kinds}, n long, normal array<double>, offset double, flatness double")


def triplets(edges: DataFrame, i: str, j: str, blocks: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """Entries (row, col, v) of blocks at the ends named by 'i' and 'j', summed by place."""
    ends = {"i": F.col(i), "j": F.col(j)}
    parts = F.array(*[F.struct(ends[a].cast("long").alias("row"), ends[b].cast("long").alias("col"), v.cast("double").alias("v")) for a, b, v in blocks])
    return edges.select(F.inline(parts)).groupBy("row", "col").agg(F.sum("v").alias("v"))

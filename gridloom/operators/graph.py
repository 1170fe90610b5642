"""Graph operators: components, merging of groups, pose graphs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import cut


def components(edges: DataFrame, u: str = "u", v: str = "v", rounds: int = 60) -> DataFrame:
    """(node, root) for all nodes of edges: the least label reachable, by alternating stars written to the shared checkpoint folder."""
    now, seen = cut(edges.where(F.col(u) != F.col(v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()), None
    for _ in range(rounds):
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        seen = state
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        now = cut(large.join(low, "u").where("v <> m").select("v", "m").union(low).distinct().toDF("u", "v"))
    raise RuntimeError(f"components did not settle within {rounds} rounds")


def merged_groups(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """Every node with its group: the least of its component, alone itself."""
    found = components(edges)
    return nodes.join(found.withColumnRenamed("node", node), node, "left").withColumn("root", F.coalesce("root", node))


def exp_se3(d: np.ndarray) -> np.ndarray:
    """4x4 pose of a 6-vector, translation first."""
    t, w = d[:3], d[3:]
    angle = np.linalg.norm(w)
    k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]])
    if angle < 1e-12:
        r, v = np.eye(3) + k, np.eye(3) + k / 2
    else:
        a, b, c = np.sin(angle) / angle, (1 - np.cos(angle)) / angle**2, (angle - np.sin(angle)) / angle**3
        r, v = np.eye(3) + a * k + b * k @ k, np.eye(3) + b * k + c * k @ k
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = r, v @ t
    return out


def log_so3(r: np.ndarray) -> np.ndarray:
    angle = np.arccos(np.clip((np.trace(r) - 1) / 2, -1, 1))
    if angle < 1e-9:
        return np.zeros(3)
    return angle / (2 * np.sin(angle)) * np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]])


def _skew(v: np.ndarray) -> np.ndarray:
    return np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])


def solve_poses(poses: list[np.ndarray], edges: Sequence[dict], rounds: int = 10, stop: float = 1e-6, extra=None) -> tuple[list[np.ndarray], list[float]]:
    """Gauss-Newton over poses with edges given by sufficient statistics; the first pose is fixed.

    An edge (i, j, w, p, q, pq, pp, qq) stands for point pairs of which T_i p should equal
    T_j q. The normal equations need the sums only, so their size is that of the graph,
    not of the data. extra(poses) may add (H, g). Returns poses and the error by round.
    """
    poses, errors = [p.copy() for p in poses], []
    n = len(poses)
    for _ in range(rounds):
        h, g, cost, weight = np.zeros((6 * n, 6 * n)), np.zeros(6 * n), 0.0, 0.0
        for e in edges:
            i, j = e["i"], e["j"]
            (ri, ti), (rj, tj) = ((poses[k][:3, :3], poses[k][:3, 3]) for k in (i, j))
            w, p, q = e["w"], ri @ e["p"] + e["w"] * ti, rj @ e["q"] + e["w"] * tj
            pp = ri @ e["pp"] @ ri.T + np.outer(ri @ e["p"], ti) + np.outer(ti, ri @ e["p"]) + w * np.outer(ti, ti)
            qq = rj @ e["qq"] @ rj.T + np.outer(rj @ e["q"], tj) + np.outer(tj, rj @ e["q"]) + w * np.outer(tj, tj)
            pq = ri @ e["pq"] @ rj.T + np.outer(ri @ e["p"], tj) + np.outer(ti, rj @ e["q"]) + w * np.outer(ti, tj)
            cost += np.trace(pp) + np.trace(qq) - 2 * np.trace(pq)
            weight += w
            # Derivative of T p by a step from the left: [I, -[Tp]x].
            square = lambda m: np.trace(m) * np.eye(3) - m
            a, b = slice(6 * i, 6 * i + 6), slice(6 * j, 6 * j + 6)
            h[a, a] += np.block([[w * np.eye(3), -_skew(p)], [_skew(p), square(pp)]])
            h[b, b] += np.block([[w * np.eye(3), -_skew(q)], [_skew(q), square(qq)]])
            mixed = np.block([[w * np.eye(3), -_skew(q)], [_skew(p), np.trace(pq) * np.eye(3) - pq.T]])
            h[a, b] -= mixed
            h[b, a] -= mixed.T
            turn = np.array([pq[1, 2] - pq[2, 1], pq[2, 0] - pq[0, 2], pq[0, 1] - pq[1, 0]])
            g[a] += np.concatenate([p - q, -turn])
            g[b] -= np.concatenate([p - q, -turn])
        if extra is not None:
            more = extra(poses)
            h, g = h + more[0], g + more[1]
        errors.append(float(np.sqrt(max(cost, 0)) / max(weight, 1e-12)))
        step = np.zeros(6 * n)
        step[6:] = np.linalg.lstsq(h[6:, 6:] + 1e-9 * np.eye(6 * n - 6), -g[6:], rcond=None)[0]
        if not np.isfinite(step).all():
            break
        poses = [exp_se3(step[6 * k : 6 * k + 6]) @ p for k, p in enumerate(poses)]
        if len(errors) > 1 and abs(errors[-2] - errors[-1]) < stop:
            break
    return poses, errors


def gate(errors_now: float, errors_before: float, grown: float = 1.1) -> bool:
    """Whether the newest edges are kept: the error did not grow by more than a tenth."""
    return errors_before <= 0 or errors_now <= grown * errors_before


def gravity_terms(normals: Sequence[tuple[int, np.ndarray, np.ndarray, float]], n: int):
    """Extra normal equations that turn each pose's floor normal towards a direction, for solve_poses."""

    def extra(poses):
        h, g = np.zeros((6 * n, 6 * n)), np.zeros(6 * n)
        for i, normal, aim, weight in normals:
            v = poses[i][:3, :3] @ normal
            j = -_skew(v)
            s = slice(6 * i + 3, 6 * i + 6)
            h[s, s] += weight * j.T @ j
            g[s] += weight * j.T @ (v - aim)
        return h, g

    return extra

"""Robust estimation: hypothesise and verify, registration, graph matching, instance clustering."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

import numpy as np

from gridloom.operators.graph import exp_se3
from gridloom.operators.statistics import kabsch


class Model(Protocol):
    """What a user's model for ransac() has: a sample size, a fit (None if degenerate) and errors of all rows."""

    size: int

    def fit(self, sample: np.ndarray): ...
    def errors(self, model, data: np.ndarray) -> np.ndarray: ...


def ransac(model: Model, data: np.ndarray, tolerance: float | np.ndarray, rounds: int, seed: int) -> tuple[object, np.ndarray]:
    """The model of the most inliers (strictly more wins) and its inliers; samples are seeded."""
    rng = np.random.default_rng(seed)
    best, kept = None, np.zeros(len(data), bool)
    if len(data) < model.size:
        return best, kept
    for _ in range(rounds):
        found = model.fit(data[rng.choice(len(data), model.size, replace=False)])
        if found is None:
            continue
        inliers = model.errors(found, data) < tolerance
        if inliers.sum() > kept.sum():
            best, kept = found, inliers
    return best, kept


def rigid_fit(p: np.ndarray, q: np.ndarray, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    w = np.ones(len(p)) if w is None else w
    return kabsch((p * w[:, None]).T @ q, w @ p, w @ q, float(w.sum()))


class Rigid:
    """Rows are p and q, six numbers; models that tilt gravity too much are refused."""

    def __init__(self, size: int = 5, gravity: float | None = 0.2):
        self.size, self.gravity = size, gravity

    def fit(self, sample):
        r, t = rigid_fit(sample[:, :3], sample[:, 3:])
        return None if self.gravity is not None and r[2, 2] < self.gravity else (r, t)

    def errors(self, model, data):
        return np.linalg.norm(data[:, :3] @ model[0].T + model[1] - data[:, 3:], axis=1)


class Plane:
    size = 8

    def fit(self, sample):
        c = sample.mean(axis=0)
        _, s, vt = np.linalg.svd(sample - c)
        return None if s[1] < 1e-9 else (vt[2], float(-vt[2] @ c))

    def errors(self, model, data):
        return np.abs(data @ model[0] + model[1])


def keeps_distance(p: np.ndarray, q: np.ndarray, peers: int, share: float, seed: int) -> np.ndarray:
    """Matches of which one of some random others keeps its distance, within a share of the depth."""
    rng = np.random.default_rng(seed)
    n = len(p)
    if n < 2:
        return np.ones(n, bool)
    other = rng.integers(0, n - 1, (n, peers))
    other += other >= np.arange(n)[:, None]
    gap = np.abs(np.linalg.norm(p[:, None] - p[other], axis=2) - np.linalg.norm(q[:, None] - q[other], axis=2))
    return (gap < share * np.maximum(np.abs(p[:, 2:3]), 1e-9)).any(axis=1)


def huber_refine(p: np.ndarray, q: np.ndarray, r: np.ndarray, t: np.ndarray, at: float = 0.008, rounds: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Reweighted rigid fits: weight 1 up to an error, then falling with it. Returns rotation, translation and weights."""
    w = np.ones(len(p))
    for _ in range(rounds):
        e = np.linalg.norm(p @ r.T + t - q, axis=1)
        w = np.where(e < at, 1.0, at / np.maximum(e, 1e-12))
        r, t = rigid_fit(p, q, w)
    return r, t, w


def icp(p: np.ndarray, q: np.ndarray, normals: np.ndarray, reach: float, rounds: int = 30, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Point-to-plane registration of p to q and the share of p with a partner within reach."""
    pose = np.eye(4) if start is None else start.copy()
    cells: dict[tuple[int, ...], list[int]] = {}
    for i, k in enumerate(map(tuple, np.floor(q / reach).astype(int))):
        cells.setdefault(k, []).append(i)
    steps = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]

    def partners(x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), -1)
        for i, k in enumerate(np.floor(x / reach).astype(int)):
            near = [j for s in steps for j in cells.get((k[0] + s[0], k[1] + s[1], k[2] + s[2]), ())]
            if near:
                d = ((q[near] - x[i]) ** 2).sum(axis=1)
                if d.min() <= reach * reach:
                    out[i] = near[int(d.argmin())]
        return out

    ratio = 0.0
    for _ in range(rounds):
        x = p @ pose[:3, :3].T + pose[:3, 3]
        mate = partners(x)
        ok = mate >= 0
        ratio = float(ok.mean()) if len(ok) else 0.0
        if ok.sum() < 6:
            break
        a, b, n = x[ok], q[mate[ok]], normals[mate[ok]]
        j = np.hstack([n, np.cross(a, n)])
        step = np.linalg.lstsq(j.T @ j + 1e-9 * np.eye(6), -j.T @ ((a - b) * n).sum(axis=1), rcond=None)[0]
        pose = exp_se3(step) @ pose
        if np.abs(step).max() < 1e-9:
            break
    return pose, ratio


def graph_match(xyz1: np.ndarray, labels1: Sequence, xyz2: np.ndarray, labels2: Sequence, rounds: int = 100) -> np.ndarray:
    """Best partner of each node of the first graph by power iteration over compatible pairs of edges; -1 if none of its label exists."""
    n1, n2 = len(xyz1), len(xyz2)
    if not n1 or not n2:
        return np.full(n1, -1)
    d1 = np.linalg.norm(xyz1[:, None] - xyz1[None], axis=2)
    d2 = np.linalg.norm(xyz2[:, None] - xyz2[None], axis=2)
    same = np.array([[a == b for b in labels2] for a in labels1])
    gap = np.abs(d1[:, None, :, None] - d2[None, :, None, :])
    mean = gap.mean() or 1.0
    fit = np.exp(-gap / mean) * (same[:, :, None, None] & same[None, None])
    x0 = np.full((n1, n2), 1.0 / n2)
    x = x0.copy()
    for _ in range(rounds):
        x = x0 + x * np.einsum("iajb,jb->ia", fit, x)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = np.where(same, x, -1).argmax(axis=1)
    return np.where(same.any(axis=1), out, -1)


def triangle_features(xyz: np.ndarray, triples: np.ndarray) -> np.ndarray:
    """Sines of the three angles of node triples, for matching of third order."""
    out = []
    for i, j, k in triples:
        a, b, c = xyz[i], xyz[j], xyz[k]
        pairs = ((b - a, c - a), (a - b, c - b), (a - c, b - c))
        out.append([np.linalg.norm(np.cross(u, v)) / max(1e-12, np.linalg.norm(u) * np.linalg.norm(v)) for u, v in pairs])
    return np.array(out).reshape(-1, 3)


def match_rooms(xyz1, labels1, xyz2, labels2, tolerance: float = 0.2, rounds: int = 2000, seed: int = 1, share: float = 0.2, least: int = 3):
    """Pairs from graph_match, verified by ransac(); the other direction is tried if the first fails. (pose parts, pairs) or None."""
    for turned in (False, True):
        a, la, b, lb = (xyz2, labels2, xyz1, labels1) if turned else (xyz1, labels1, xyz2, labels2)
        mate = graph_match(a, la, b, lb)
        pairs = [(i, int(m)) for i, m in enumerate(mate) if m >= 0]
        if len(pairs) <= 5:
            continue
        data = np.hstack([a[[i for i, _ in pairs]], b[[m for _, m in pairs]]])
        model, inliers = ransac(Rigid(), data, tolerance, rounds, seed)
        if model is not None and inliers.mean() > share and inliers.sum() >= least:
            kept = [p for p, ok in zip(pairs, inliers, strict=True) if ok]
            r, t = rigid_fit(data[inliers, :3], data[inliers, 3:])
            return ((r.T, -r.T @ t), [(m, i) for i, m in kept]) if turned else ((r, t), kept)
    return None


def instance_clusters(xyz: np.ndarray, embedding: np.ndarray, objectness: np.ndarray, bandwidth: np.ndarray, most: int = 50, rounds: int = 30, least: int = 50) -> np.ndarray:
    """Instance of each point, -1 without one: greedily the best remaining seed, Gaussian membership above a half, refined by five weighted means."""
    label, left, number = np.full(len(xyz), -1), np.ones(len(xyz), bool), 0
    for _ in range(rounds):
        if number >= most or left.sum() < least:
            break
        seed = int(np.where(left, objectness, -np.inf).argmax())
        c1, c2 = xyz[seed], embedding[seed]
        for _ in range(5):
            m = np.exp(-((xyz - c1) ** 2).sum(axis=1) / (2 * bandwidth[seed, 0] ** 2) - ((embedding - c2) ** 2).sum(axis=1) / (2 * bandwidth[seed, 1] ** 2))
            w = m * left
            c1, c2 = w @ xyz / w.sum(), w @ embedding / w.sum()
        members = (m > 0.5) & left
        members[seed] = True
        if members.sum() >= least:
            label[members] = number
            number += 1
        left &= ~members
    return label


def dense_odometry(grey1: np.ndarray, depth1: np.ndarray, grey2: np.ndarray, fx: float, fy: float, cx: float, cy: float, levels: int = 3, rounds: int = 15) -> np.ndarray:
    """Pose that warps the first picture on to the second by photometric Gauss-Newton over a pyramid."""
    pose = np.eye(4)
    for level in reversed(range(levels)):
        s = 1 << level
        h, w = (grey1.shape[0] // s) * s, (grey1.shape[1] // s) * s
        shrink = lambda g: g[:h, :w].reshape(h // s, s, w // s, s).mean(axis=(1, 3))
        a, b, z = shrink(grey1), shrink(grey2), depth1[:h:s, :w:s]
        k = (fx / s, fy / s, (cx + 0.5) / s - 0.5, (cy + 0.5) / s - 0.5)
        gy, gx = np.gradient(b)
        v, u = np.mgrid[: a.shape[0], : a.shape[1]]
        ok = z > 0
        p = np.stack([(u[ok] - k[2]) * z[ok] / k[0], (v[ok] - k[3]) * z[ok] / k[1], z[ok]], axis=1)
        for _ in range(rounds):
            x = p @ pose[:3, :3].T + pose[:3, 3]
            px, py = x[:, 0] / x[:, 2] * k[0] + k[2], x[:, 1] / x[:, 2] * k[1] + k[3]
            x0, y0 = np.floor(px).astype(int), np.floor(py).astype(int)
            inside = (x0 >= 0) & (y0 >= 0) & (x0 < a.shape[1] - 1) & (y0 < a.shape[0] - 1) & (x[:, 2] > 0)
            if inside.sum() < 12:
                break
            x, px, py, x0, y0 = x[inside], px[inside], py[inside], x0[inside], y0[inside]
            tx, ty = px - x0, py - y0
            at = lambda g: (g[y0, x0] * (1 - tx) + g[y0, x0 + 1] * tx) * (1 - ty) + (g[y0 + 1, x0] * (1 - tx) + g[y0 + 1, x0 + 1] * tx) * ty
            e = at(b) - a[ok][inside]
            dx, dy = at(gx) * k[0], at(gy) * k[1]
            jp = np.stack([dx / x[:, 2], dy / x[:, 2], -(dx * x[:, 0] + dy * x[:, 1]) / x[:, 2] ** 2], axis=1)
            j = np.hstack([jp, np.cross(x, jp)])
            step = np.linalg.lstsq(j.T @ j + 1e-6 * np.eye(6), -j.T @ e, rcond=None)[0]
            pose = exp_se3(step) @ pose
            if np.abs(step).max() < 1e-7:
                break
    return pose


def apply_model(segment: Callable[[np.ndarray], np.ndarray] | None, features: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Class of each row by a user's segmentation; without one the given labels pass through."""
    return labels if segment is None else segment(features).argmax(axis=1)

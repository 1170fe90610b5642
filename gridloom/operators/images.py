"""Image operators on numpy rasters, for use in Arrow functions over binary columns."""

from __future__ import annotations

import numpy as np


def _shifted(a: np.ndarray, dy: int, dx: int, fill: float = 0.0) -> np.ndarray:
    out = np.full_like(a, fill)
    h, w = a.shape[:2]
    out[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = a[max(0, dy) : h - max(0, -dy), max(0, dx) : w - max(0, -dx)]
    return out


def clip_range(depth: np.ndarray, far: float) -> np.ndarray:
    """Depths that are negative, not a number or beyond far become 0."""
    return np.where(np.isfinite(depth) & (depth > 0) & (depth <= far), depth, 0.0)


def bilateral(depth: np.ndarray, radius: int = 4, sigma_value: float = 0.03, sigma_place: float = 4.5) -> np.ndarray:
    total, weight = np.zeros(depth.shape), np.zeros(depth.shape)
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            other = _shifted(depth, dy, dx)
            w = np.exp(-(dx * dx + dy * dy) / (2 * sigma_place**2) - (other - depth) ** 2 / (2 * sigma_value**2)) * (other > 0)
            total += w * other
            weight += w
    return np.where((depth > 0) & (weight > 0), total / np.maximum(weight, 1e-12), 0.0)


def vertex_map(depth: np.ndarray, fx: float, fy: float, cx: float, cy: float) -> np.ndarray:
    v, u = np.mgrid[: depth.shape[0], : depth.shape[1]]
    return np.stack([(u - cx) * depth / fx, (v - cy) * depth / fy, depth], axis=2)


def normal_map(depth: np.ndarray, fx: float, fy: float, cx: float, cy: float) -> np.ndarray:
    """Unit normals by central differences, facing the camera; zero where a neighbour is missing."""
    p = vertex_map(depth, fx, fy, cx, cy)
    n = np.cross(_shifted(p, 0, 1) - _shifted(p, 0, -1), _shifted(p, 1, 0) - _shifted(p, -1, 0))
    n = np.where((n[..., 2:] > 0), -n, n)
    size = np.linalg.norm(n, axis=2, keepdims=True)
    known = depth > 0
    for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0)):
        known &= _shifted(depth, dy, dx) > 0
    return np.where(known[..., None] & (size > 0), n / np.maximum(size, 1e-12), 0.0)


def without_edges(depth: np.ndarray, gap: float = 0.1) -> np.ndarray:
    """Depth without the pixels of which a neighbour in the 3x3 is farther off than gap."""
    bad = np.zeros(depth.shape, bool)
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            bad |= np.abs(_shifted(depth, dy, dx, np.nan) - depth) > gap
    return np.where(bad, 0.0, depth)


def without_grazing(depth: np.ndarray, normals: np.ndarray, fx: float, fy: float, cx: float, cy: float, least: float = 0.1) -> np.ndarray:
    """Depth without the pixels seen at too flat an angle."""
    p = vertex_map(depth, fx, fy, cx, cy)
    view = p / np.maximum(np.linalg.norm(p, axis=2, keepdims=True), 1e-12)
    return np.where(np.abs((view * normals).sum(axis=2)) >= least, depth, 0.0)


def reprojected(depth: np.ndarray, pose: np.ndarray, fx: float, fy: float, cx: float, cy: float, shape: tuple[int, int]) -> np.ndarray:
    """The depth seen from another pose; the nearest of colliding points wins."""
    p = vertex_map(depth, fx, fy, cx, cy).reshape(-1, 3)
    p = p[p[:, 2] > 0] @ pose[:3, :3].T + pose[:3, 3]
    p = p[p[:, 2] > 0]
    u, v = np.floor(p[:, 0] / p[:, 2] * fx + cx + 0.5).astype(int), np.floor(p[:, 1] / p[:, 2] * fy + cy + 0.5).astype(int)
    ok = (u >= 0) & (v >= 0) & (u < shape[1]) & (v < shape[0])
    out = np.full(shape, np.inf)
    np.minimum.at(out, (v[ok], u[ok]), p[ok, 2])
    return np.where(np.isfinite(out), out, 0.0)


def consistent(depth: np.ndarray, other: np.ndarray, pose: np.ndarray, fx: float, fy: float, cx: float, cy: float, share: float = 0.03) -> np.ndarray:
    """Depth without the pixels that another frame sees at another depth."""
    seen = reprojected(other, pose, fx, fy, cx, cy, depth.shape)
    return np.where((seen > 0) & (depth > 0) & (np.abs(seen - depth) >= share * depth), 0.0, depth)


def fused(depth: np.ndarray, weight: np.ndarray, other: np.ndarray, pose: np.ndarray, fx: float, fy: float, cx: float, cy: float, share: float = 0.03) -> tuple[np.ndarray, np.ndarray]:
    """A keyframe refined by another frame: the weighted mean where both agree."""
    seen = reprojected(other, pose, fx, fy, cx, cy, depth.shape)
    agree = (seen > 0) & ((depth == 0) | (np.abs(seen - depth) < share * np.maximum(depth, 1e-9)))
    w = np.where(depth > 0, weight, 0.0)
    return np.where(agree, (depth * w + seen) / (w + 1), depth), np.where(agree, w + 1, weight)


def convolve(a: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Correlation with the border repeated."""
    ry, rx = kernel.shape[0] // 2, kernel.shape[1] // 2
    p = np.pad(a.astype(float), ((ry, ry), (rx, rx)), mode="edge")
    out = np.zeros(a.shape)
    for y in range(kernel.shape[0]):
        for x in range(kernel.shape[1]):
            out += kernel[y, x] * p[y : y + a.shape[0], x : x + a.shape[1]]
    return out


def sobel(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = np.outer([1, 2, 1], [-1, 0, 1])
    return convolve(a, k), convolve(a, k.T)


def gaussian(a: np.ndarray, sigma: float) -> np.ndarray:
    r = max(1, int(np.ceil(3 * sigma)))
    k = np.exp(-np.arange(-r, r + 1) ** 2 / (2 * sigma**2))
    k /= k.sum()
    return convolve(convolve(a, k[None]), k[:, None])


def pyramid(a: np.ndarray, levels: int) -> list[np.ndarray]:
    out = [a]
    for _ in range(levels - 1):
        b = gaussian(out[-1], 0.8)
        out.append(b[::2, ::2])
    return out


def normalise(a: np.ndarray, mean: float = 0.5) -> np.ndarray:
    """Scaled to a mean intensity."""
    return a * (mean / max(float(a.mean()), 1e-12))


def sharpness(a: np.ndarray) -> float:
    return float(np.abs(convolve(a, np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]]))).max())


def circle() -> list[tuple[int, int]]:
    """The 16 pixels at distance 3, in order: the discrete circle."""
    ring = {(round(3 * np.sin(t)), round(3 * np.cos(t))) for t in np.linspace(0, 2 * np.pi, 720)}
    ring = {(y, x) for y, x in ring if 7 < y * y + x * x < 11 or (abs(y), abs(x)) in ((3, 0), (0, 3))}
    return sorted(ring, key=lambda p: np.arctan2(p[0], p[1]))


def corners(a: np.ndarray, threshold: float, run: int = 9) -> np.ndarray:
    """Response of each pixel with a run of circle pixels all lighter or all darker by a threshold; 0 elsewhere. Only local maxima stay."""
    ring = np.stack([_shifted(a, dy, dx, np.nan) for dy, dx in circle()])
    gap = ring - a
    gap[~np.isfinite(gap)] = 0.0
    response = np.zeros(a.shape)
    for sign in (1, -1):
        hit = sign * gap > threshold
        double = np.concatenate([hit, hit[: run - 1]])
        any_run = np.zeros(a.shape, bool)
        for i in range(len(ring)):
            any_run |= double[i : i + run].all(axis=0)
        response = np.maximum(response, np.where(any_run, np.where(hit, sign * gap - threshold, 0).sum(axis=0), 0))
    peak = response.copy()
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            peak = np.maximum(peak, _shifted(response, dy, dx))
    return np.where((response > 0) & (response >= peak), response, 0.0)


def spread(points: np.ndarray, response: np.ndarray, want: int, box: tuple[float, float, float, float]) -> np.ndarray:
    """Indices of about `want` points spread over a box: cells with several points are quartered until there are enough; each keeps its best."""
    cells = [(box, np.arange(len(points)))]
    while len(cells) < want:
        big = max(range(len(cells)), key=lambda i: len(cells[i][1]), default=None)
        if big is None or len(cells[big][1]) <= 1:
            break
        (x0, y0, x1, y1), idx = cells.pop(big)
        mx, my = (x0 + x1) / 2, (y0 + y1) / 2
        if x1 - x0 < 1e-6:
            cells.append(((x0, y0, x1, y1), idx[:1]))
            continue
        for ax, ay, bx, by in ((x0, y0, mx, my), (mx, y0, x1, my), (x0, my, mx, y1), (mx, my, x1, y1)):
            inside = idx[((points[idx, 0] >= mx) == (ax == mx)) & ((points[idx, 1] >= my) == (ay == my))]
            if len(inside):
                cells.append(((ax, ay, bx, by), inside))
    return np.array([idx[response[idx].argmax()] for _, idx in cells], int)


def orientation(a: np.ndarray, y: int, x: int, radius: int = 7) -> float:
    """Angle of the intensity centroid around a pixel."""
    p = np.pad(a, radius)[y : y + 2 * radius + 1, x : x + 2 * radius + 1]
    r = np.arange(-radius, radius + 1)
    m = np.where(r[:, None] ** 2 + r[None] ** 2 <= radius * radius, p, 0)
    return float(np.arctan2((m * r[:, None]).sum(), (m * r[None]).sum()))


def tests(bits: int = 256, radius: int = 13, seed: int = 0) -> np.ndarray:
    """Pairs of places to compare, drawn from a normal law by a fixed seed."""
    return np.clip(np.random.default_rng(seed).normal(0, radius / 2.5, (bits, 4)), -radius, radius)


def descriptor(a: np.ndarray, y: int, x: int, angle: float, pairs: np.ndarray) -> bytes:
    """Bits of brightness comparisons, turned by the angle."""
    c, s = np.cos(angle), np.sin(angle)
    spot = lambda px, py: a[np.clip(np.round(y + s * px + c * py).astype(int), 0, a.shape[0] - 1), np.clip(np.round(x + c * px - s * py).astype(int), 0, a.shape[1] - 1)]
    return np.packbits(spot(pairs[:, 0], pairs[:, 1]) < spot(pairs[:, 2], pairs[:, 3])).tobytes()


def features(grey: np.ndarray, want: int = 1000, levels: int = 3, threshold: float = 20.0) -> list[tuple[float, float, float, int, float, bytes]]:
    """(x, y, angle, octave, response, descriptor) of corners over a pyramid, spread over the picture."""
    out, pairs = [], tests()
    for octave, a in enumerate(pyramid(grey.astype(float), levels)):
        r = corners(a, threshold)
        ys, xs = np.nonzero(r)
        if not len(xs):
            continue
        points = np.stack([xs, ys], axis=1).astype(float)
        smooth = gaussian(a, 2.0)
        for i in spread(points, r[ys, xs], max(1, want >> octave), (0.0, 0.0, float(a.shape[1]), float(a.shape[0]))):
            angle = orientation(a, ys[i], xs[i])
            out.append((float(xs[i] << octave), float(ys[i] << octave), angle, octave, float(r[ys[i], xs[i]]), descriptor(smooth, ys[i], xs[i], angle, pairs)))
    return out

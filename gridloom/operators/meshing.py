"""Surfaces: marching cubes by a generated table, ray walks, quadric simplification."""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.voxels import full_cells

#: Corner n of a cell lies at bit 0, 1, 2 of n along x, y, z. Edges join corners that differ in one bit.
EDGES = [(a, a | 1 << d) for d in range(3) for a in range(8) if not a >> d & 1]
#: The corners of each face in a ring, seen from outside counter-clockwise.
RINGS = [[0, 4, 6, 2], [1, 3, 7, 5], [0, 1, 5, 4], [2, 6, 7, 3], [0, 2, 3, 1], [4, 5, 7, 6]]


@lru_cache(maxsize=1)
def cases() -> list[list[tuple[int, int, int]]]:
    """Triangles, as edge numbers, of each of the 256 sets of corners below zero.

    Derived rather than listed: on each face the crossed sides are joined so that corners
    below zero are cut off one by one, the joins make closed loops, and loops are fanned.
    """
    number = {frozenset(e): i for i, e in enumerate(EDGES)}
    out = []
    for code in range(256):
        after: dict[int, int] = {}
        for ring in RINGS:
            low = [bool(code >> c & 1) for c in ring]
            sides = [number[frozenset((ring[i], ring[(i + 1) % 4]))] for i in range(4)]
            # Going round, a run of corners below zero begins behind one crossing and ends before the next.
            for i in range(4):
                if not low[i - 1] and low[i]:
                    j = i
                    while low[(j + 1) % 4]:
                        j += 1
                    after[sides[j % 4]] = sides[i - 1]
        triangles, left = [], dict(after)
        while left:
            start = min(left)
            loop, at = [], start
            while at in left:
                loop.append(at)
                at = left.pop(at)
            triangles += [(loop[0], loop[k], loop[k + 1]) for k in range(1, len(loop) - 1)]
        out.append(triangles)
    return out


def surface(cells: DataFrame, keys: Sequence[str], value: str, unknown: float = 1.0) -> DataFrame:
    """(keys, triangle, x0..z2) of the zero surface within every cell whose eight corners are known; corners above `unknown` are not.

    The table of cases is small and fixed; a cell's corner values give the crossings.
    """
    full = full_cells(cells, keys, value).where(F.expr(f"forall(values, v -> v <= {unknown})"))
    code = F.expr("aggregate(transform(values, (v, i) -> if(v < 0D, shiftleft(1, i), 0)), 0, (s, x) -> s + x)")
    table = F.array(*[F.array(*[F.array(*[F.lit(e) for e in t]) for t in case]).cast("array<array<int>>") if case else F.array().cast("array<array<int>>") for case in cases()])
    # Codes 0 and 255 have no surface and go before the table is looked at.
    some = full.withColumn("code", code).where("code NOT IN (0, 255)")
    tri = some.select(*keys, "values", F.posexplode(F.element_at(table, F.col("code") + 1)).alias("triangle", "edges"))
    ends = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in EDGES])
    out = tri
    for i in range(3):
        out = out.withColumn(f"__e{i}", F.element_at(ends, F.col("edges")[i] + 1))
        va, vb = F.col("values")[F.col(f"__e{i}.a")], F.col("values")[F.col(f"__e{i}.b")]
        out = out.withColumn(f"__t{i}", va / (va - vb))
    columns = []
    for i in range(3):
        for d, (k, name) in enumerate(zip(keys, "xyz", strict=True)):
            bit = lambda c, d=d: F.shiftright(c, d).bitwiseAND(F.lit(1))
            a, b = bit(F.col(f"__e{i}.a")), bit(F.col(f"__e{i}.b"))
            columns.append((F.col(k) + a + (b - a) * F.col(f"__t{i}")).alias(f"{name}{i}"))
    return out.select(*keys, "triangle", *columns)


def march(values: np.ndarray) -> np.ndarray:
    """The same for a dense grid: triangles (n, 3, 3)."""
    out, table = [], cases()
    for x, y, z in np.ndindex(*(n - 1 for n in values.shape)):
        v = [values[x + (c & 1), y + (c >> 1 & 1), z + (c >> 2 & 1)] for c in range(8)]
        for tri in table[sum(1 << c for c in range(8) if v[c] < 0)]:
            points = []
            for e in tri:
                a, b = EDGES[e]
                t = v[a] / (v[a] - v[b])
                points.append([o + (a >> d & 1) + ((b >> d & 1) - (a >> d & 1)) * t for d, o in enumerate((x, y, z))])
            out.append(points)
    return np.array(out).reshape(-1, 3, 3)


def traversed(start: Sequence[float], end: Sequence[float], size: float) -> list[tuple[int, ...]]:
    """Cells along a segment, in order."""
    cell = [math.floor(s / size) for s in start]
    last = [math.floor(e / size) for e in end]
    way = [e - s for s, e in zip(start, end, strict=True)]
    step = [1 if w > 0 else -1 for w in way]
    reach = [((c + (s > 0)) * size - p) / w if w else math.inf for c, s, p, w in zip(cell, step, start, way, strict=True)]
    gap = [abs(size / w) if w else math.inf for w in way]
    out = [tuple(cell)]
    for _ in range(sum(abs(a - b) for a, b in zip(cell, last, strict=True))):
        d = min(range(len(cell)), key=lambda i: (cell[i] == last[i], reach[i]))
        cell[d] += step[d]
        reach[d] += gap[d]
        out.append(tuple(cell))
    return out


def height_field(u: np.ndarray, v: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Vertices and triangles over the squares whose four corners are known."""
    at = {(int(a), int(b)): i for i, (a, b) in enumerate(zip(u, v, strict=True))}
    faces = []
    for (a, b), i in sorted(at.items()):
        j, k, m = at.get((a + 1, b)), at.get((a, b + 1)), at.get((a + 1, b + 1))
        if None not in (j, k, m):
            faces += [(i, j, m), (i, m, k)]
    return np.stack([u, v, h], axis=1).astype(float), faces


def collapse(vertices: np.ndarray, faces: list[tuple[int, int, int]], target: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Edge collapses of least quadric error until at most target triangles are left; borders stay and no triangle flips."""
    v = vertices.copy()
    tris: dict[int, list[int]] = {i: list(f) for i, f in enumerate(faces)}
    around: dict[int, set[int]] = {}
    sides: dict[frozenset, int] = {}
    for i, f in tris.items():
        for k in range(3):
            around.setdefault(f[k], set()).add(i)
            side = frozenset((f[k], f[(k + 1) % 3]))
            sides[side] = sides.get(side, 0) + 1
    border = {x for s, n in sides.items() if n == 1 for x in s}

    def normal(f):
        return np.cross(v[f[1]] - v[f[0]], v[f[2]] - v[f[0]])

    q = {i: np.zeros((4, 4)) for i in around}
    for f in tris.values():
        n = normal(f)
        size = np.linalg.norm(n)
        if size > 0:
            p = np.append(n / size, -(n / size) @ v[f[0]])
            for x in f:
                q[x] += np.outer(p, p) * size

    def cost(a, b):
        m = q[a] + q[b]
        spots = [v[a]] if a in border else [v[b]] if b in border else [v[a], v[b], (v[a] + v[b]) / 2]
        errors = [float(np.append(s, 1) @ m @ np.append(s, 1)) for s in spots]
        i = int(np.argmin(errors))
        return errors[i], spots[i]

    age = dict.fromkeys(around, 0)
    heap = []

    def push(a, b):
        if not (a in border and b in border):
            heapq.heappush(heap, (cost(a, b)[0], min(a, b), max(a, b), age[a] + age[b]))

    for s in sides:
        push(*s)
    while len(tris) > target and heap:
        _, a, b, old = heapq.heappop(heap)
        if a not in around or b not in around or age[a] + age[b] != old or not (around[a] & around[b]):
            continue
        if b in border:
            a, b = b, a
        _, spot = cost(a, b)
        # b goes; a takes its place. Refuse what would turn a triangle over.
        rest = [t for t in around[a] ^ around[b]]
        if any(np.dot(normal(tris[t]), np.cross(*[(spot if y in (a, b) else v[y]) - (spot if tris[t][0] in (a, b) else v[tris[t][0]]) for y in tris[t][1:]])) <= 0 for t in rest):
            continue
        for t in around[a] & around[b]:
            for x in tris[t]:
                if x not in (a, b):
                    around[x].discard(t)
            around[a].discard(t)
            around[b].discard(t)
            del tris[t]
        for t in around[b]:
            tris[t] = [a if x == b else x for x in tris[t]]
            around[a].add(t)
        del around[b]
        v[a], q[a] = spot, q[a] + q[b]
        age[a] += 1
        for x in {x for t in around[a] for x in tris[t]} - {a}:
            push(a, x)
    used = sorted({x for f in tris.values() for x in f})
    place = {x: i for i, x in enumerate(used)}
    return v[used], [tuple(place[x] for x in f) for f in tris.values()]

import numpy as np

from gridloom.operators import meshing as M
from gridloom.operators import sparse as SP


def closed(tris):
    key = lambda p: tuple(np.round(p, 7))
    sides = {}
    for t in tris:
        k = [key(p) for p in t]
        for a, b in ((0, 1), (1, 2), (2, 0)):
            if k[a] != k[b]:
                sides[k[a], k[b]] = sides.get((k[a], k[b]), 0) + 1
    return all(sides.get((b, a), 0) == n for (a, b), n in sides.items())


def area(tris):
    return np.linalg.norm(np.cross(tris[:, 1] - tris[:, 0], tris[:, 2] - tris[:, 0]), axis=1).sum() / 2


def sphere(n=24, r=8.0):
    g = np.mgrid[:n, :n, :n].astype(float)
    return np.sqrt(((g - (n - 1) / 2) ** 2).sum(axis=0)) - r


def test_sphere_is_closed_with_its_area():
    tris = M.march(sphere())
    assert closed(tris) and abs(area(tris) / (4 * np.pi * 64) - 1) < 0.02


def test_any_field_is_closed():
    rng = np.random.default_rng(0)
    v = np.full((7, 7, 7), 1.0)
    v[1:-1, 1:-1, 1:-1] = rng.normal(0, 1, (5, 5, 5))
    assert closed(M.march(v))
    assert M.cases()[0] == M.cases()[255] == [] and len(M.cases()[1]) == 1 and len(M.cases()) == 256


def test_surface_of_a_table_is_that_of_the_grid(spark):
    v = sphere(10, 3.3) / 10
    df = spark.createDataFrame([(int(a), int(b), int(c), float(v[a, b, c])) for a, b, c in np.ndindex(v.shape)], "cx long, cy long, cz long, v double")
    got = M.surface(df, ["cx", "cy", "cz"], "v").collect()
    points = np.array([[[r[f"{a}{i}"] for a in "xyz"] for i in range(3)] for r in got])
    want = M.march(v)
    assert len(points) == len(want) and closed(points) and abs(area(points) - area(want)) < 1e-6


def test_ray_cells():
    cells = M.traversed((0.5, 0.5, 0.5), (3.5, 1.5, 0.5), 1.0)
    assert cells[0] == (0, 0, 0) and cells[-1] == (3, 1, 0) and len(cells) == 5
    assert all(sum(abs(a - b) for a, b in zip(x, y, strict=True)) == 1 for x, y in zip(cells, cells[1:], strict=False))
    assert M.traversed((0, 0, 0), (0, 0, 0), 1.0) == [(0, 0, 0)] and M.traversed((0.5,) * 3, (-1.5, 0.5, 0.5), 1.0)[-1] == (-2, 0, 0)


def test_flat_field_collapses_without_changing():
    u, v = (x.ravel() for x in np.mgrid[:9, :9])
    vertices, faces = M.height_field(u, v, np.zeros(81))
    assert len(faces) == 128
    v2, f2 = M.collapse(vertices, faces, 40)
    tris = np.array([[v2[i] for i in f] for f in f2])
    assert len(f2) <= 60 and abs(area(tris) - 64) < 1e-9 and np.abs(v2[:, 2]).max() == 0


def test_sparse_convolution_is_that_of_the_dense_grid(spark):
    rng = np.random.default_rng(2)
    grid = np.where(rng.random((8, 8)) < 0.6, rng.normal(0, 1, (8, 8)), 0.0)
    sites = [(int(a), int(b), float(grid[a, b])) for a, b in np.argwhere(grid != 0)]
    df = spark.createDataFrame(sites, "x long, y long, a double")
    w = rng.normal(0, 1, 9)
    got = {(r.x, r.y): r.y0 for r in SP.submanifold(df, ["x", "y"], ["a"], [3, 3], [[[float(v)]] for v in w], [0.5]).collect()}
    p = np.pad(grid, 1)
    assert set(got) == {(a, b) for a, b, _ in sites}
    for (a, b), y in got.items():
        assert abs(y - (0.5 + (p[a : a + 3, b : b + 3] * w.reshape(3, 3)).sum())) < 1e-9
    strided = {(r.x, r.y): r.y0 for r in SP.strided(df, ["x", "y"], ["a"], 2, 2, 8, [[[float(v)]] for v in w[:4]], [0.0]).collect()}
    for (a, b), y in strided.items():
        assert abs(y - (grid[2 * a : 2 * a + 2, 2 * b : 2 * b + 2] * w[:4].reshape(2, 2)).sum()) < 1e-9

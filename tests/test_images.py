import numpy as np

from gridloom.operators import images as I


def test_planes_have_their_normal():
    v, u = np.mgrid[:24, :32]
    # z = 2 + x / 2 seen by a pinhole: depth = 2 / (1 - (u - cx) / (2 fx)).
    depth = 2 / (1 - (u - 16) / (2 * 30.0))
    n = I.normal_map(depth, 30, 30, 16, 12)[2:-2, 2:-2]
    want = np.array([0.5, 0, -1]) / np.sqrt(1.25)
    assert np.abs(n - want).max() < 1e-9
    assert (I.without_grazing(depth, I.normal_map(depth, 30, 30, 16, 12), 30, 30, 16, 12)[3:-3, 3:-3] > 0).all()


def test_depth_clean_up():
    depth = np.full((10, 10), 2.0)
    depth[4, 4] = 9.0
    depth[0, 0], depth[9, 9] = np.nan, -1
    clean = I.clip_range(depth, 8)
    assert clean[4, 4] == clean[0, 0] == clean[9, 9] == 0 and clean[5, 5] == 2
    assert np.abs(I.bilateral(np.full((9, 9), 3.0)) - 3).max() < 1e-12
    step = np.where(np.arange(10)[None] < 5, 1.0, 2.0) * np.ones((10, 1))
    kept = I.without_edges(step)
    assert (kept[:, 4:6] == 0).all() and (kept[:, :3] == 1).all()


def test_consistency_between_frames():
    depth = np.full((20, 20), 2.0)
    other = depth.copy()
    other[5:10, 5:10] = 1.0
    kept = I.consistent(depth, other, np.eye(4), 20, 20, 10, 10)
    assert (kept[5:10, 5:10] == 0).all() and kept[15, 15] == 2
    merged, weight = I.fused(depth, np.ones((20, 20)), np.full((20, 20), 2.02), np.eye(4), 20, 20, 10, 10)
    assert np.abs(merged - 2.01).max() < 1e-9 and (weight == 2).all()


def test_filters():
    ramp = np.mgrid[:8, :8][1].astype(float)
    gx, gy = I.sobel(ramp)
    assert (gx[1:-1, 1:-1] == 8).all() and (gy[1:-1, 1:-1] == 0).all()
    assert np.abs(I.gaussian(np.ones((9, 9)), 1.5) - 1).max() < 1e-12
    assert [a.shape for a in I.pyramid(np.ones((16, 12)), 3)] == [(16, 12), (8, 6), (4, 3)]
    assert abs(I.normalise(ramp).mean() - 0.5) < 1e-12 and I.sharpness(np.ones((5, 5))) == 0 < I.sharpness(np.eye(5))


def test_features_are_found_again_after_a_shift():
    rng = np.random.default_rng(0)
    a = np.kron(rng.integers(0, 2, (12, 12)) * 200.0, np.ones((8, 8)))
    b = np.roll(a, (3, 5), axis=(0, 1))
    assert len(I.circle()) == 16
    fa, fb = I.features(a, 150, 1), I.features(b, 150, 1)
    assert 20 < len(fa) <= 160
    bits = lambda x: np.unpackbits(np.frombuffer(x, np.uint8))
    right = 0
    inner = [f for f in fa if 20 < f[0] < 70 and 20 < f[1] < 70]
    for f in inner:
        near = min(fb, key=lambda g, f=f: int((bits(f[5]) != bits(g[5])).sum()))
        right += abs(near[0] - f[0] - 5) < 0.5 and abs(near[1] - f[1] - 3) < 0.5
    assert right > 0.7 * len(inner) > 5

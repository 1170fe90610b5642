import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import estimation as ES
from gridloom.operators import graph as GR
from gridloom.operators import rooms as RM
from gridloom.operators import sequences as SQ
from gridloom.operators import statistics as ST


def turn(a):
    return np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1.0]])


@pytest.fixture
def cloud():
    return np.random.default_rng(1).uniform(-2, 2, (200, 3))


def test_ransac_finds_a_motion_among_outliers(cloud):
    r, t = turn(0.7), np.array([1.0, -2, 0.5])
    q = cloud @ r.T + t
    wrong = np.arange(len(cloud)) % 10 < 3
    q[wrong] += np.random.default_rng(2).uniform(1, 3, (wrong.sum(), 3))
    model, ok = ES.ransac(ES.Rigid(4, None), np.hstack([cloud, q]), 0.01, 400, 5)
    assert (ok == ~wrong).all()
    r2, t2, w = ES.huber_refine(cloud, q, *model)
    assert np.abs(ES.rigid_fit(cloud[ok], q[ok])[0] - r).max() < 1e-9 and w[wrong].max() < w[~wrong].min()
    assert ES.ransac(ES.Rigid(4), np.zeros((2, 6)), 1, 5, 1)[0] is None
    keep = ES.keeps_distance(cloud + [0, 0, 10], q, 8, 0.0015, 1)
    assert keep[~wrong].mean() > 0.9


def test_plane_model():
    rng = np.random.default_rng(3)
    xy = rng.uniform(-1, 1, (300, 2))
    pts = np.column_stack([xy, 0.5 * xy[:, 0] + 1])
    pts[::5, 2] += 2
    _, ok = ES.ransac(ES.Plane(), pts, 0.01, 300, 1)
    assert ok.sum() == 240


def test_icp(cloud):
    pts = np.vstack([np.column_stack([cloud[:, :2], np.zeros(len(cloud))]), np.column_stack([cloud[:, 0], np.full(len(cloud), 2.0), cloud[:, 2]]), np.column_stack([np.full(len(cloud), 2.0), cloud[:, 1:]])])
    n = np.repeat(np.eye(3)[[2, 1, 0]], len(cloud), axis=0)
    moved = (pts - [0.02, 0.01, -0.015]) @ turn(0.01)
    pose, ratio = ES.icp(moved, pts, n, 0.2)
    assert ratio > 0.98 and np.abs(moved @ pose[:3, :3].T + pose[:3, 3] - pts).max() < 5e-3


def test_graph_matching_and_rooms(cloud):
    xyz = cloud[:12]
    labels = [i % 3 for i in range(12)]
    r, t = turn(1.1), np.array([3.0, 1, 0])
    order = np.random.default_rng(4).permutation(12)
    found = ES.match_rooms(xyz, labels, (xyz @ r.T + t)[order], [labels[i] for i in order], rounds=500)
    (r2, t2), pairs = found
    assert len(pairs) >= 6 and all(order[b] == a for a, b in pairs) and np.abs(r2 - r).max() < 1e-6
    assert (ES.graph_match(xyz[:2], ["a", "b"], xyz[:1], ["b"]) == [-1, 0]).all()
    assert ES.match_rooms(xyz[:3], [0, 1, 2], xyz[:3], [0, 1, 2]) is None
    f = ES.triangle_features(np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0.0]]), np.array([[0, 1, 2]]))
    assert np.allclose(f, [[1, math.sqrt(0.5), math.sqrt(0.5)]])


def test_instance_clusters():
    rng = np.random.default_rng(0)
    xyz = np.vstack([rng.normal(c, 0.05, (80, 3)) for c in (0, 3)])
    label = ES.instance_clusters(xyz, np.zeros((160, 2)), rng.random(160), np.full((160, 2), 0.5))
    assert len(set(label[:80])) == 1 and len(set(label[80:])) == 1 and label[0] != label[-1]


def test_dense_odometry_reduces_the_shift():
    y, x = np.mgrid[:64, :80]
    picture = lambda dx: np.sin((x + dx) / 6) + np.cos(y / 7 + (x + dx) / 15)
    pose = ES.dense_odometry(picture(0), np.full((64, 80), 2.0), picture(-1.5), 80, 80, 40, 32)
    assert abs(pose[0, 3] - 1.5 * 2 / 80) < 5e-3


def edge(i, j, p, q):
    return {"i": i, "j": j, "w": float(len(p)), "p": p.sum(0), "q": q.sum(0), "pq": p.T @ q, "pp": p.T @ p, "qq": q.T @ q}


def test_pose_graph_of_a_ring(cloud):
    poses = []
    for k in range(12):
        t = np.eye(4)
        t[:3, :3], t[:3, 3] = turn(k * math.pi / 6), [math.cos(k), math.sin(k), 0.1 * k]
        poses.append(np.linalg.inv(poses[0]) @ t if poses else t)
    poses[0] = np.eye(4) if not np.allclose(poses[0][:3, 3], 0) else poses[0]
    local = lambda k: (cloud[:50] - poses[k][:3, 3]) @ poses[k][:3, :3]
    edges = [edge(k, (k + 1) % 12, local(k), local((k + 1) % 12)) for k in range(12)]
    rng = np.random.default_rng(7)
    start = [poses[0]] + [GR.exp_se3(rng.normal(0, 0.05, 6)) @ p for p in poses[1:]]
    solved, errors = GR.solve_poses(start, edges, rounds=15, stop=0.0)
    assert errors[-1] < 1e-4 < errors[0] and max(np.abs(a - b).max() for a, b in zip(solved, poses, strict=True)) < 1e-5
    assert GR.gate(1.05, 1.0) and not GR.gate(1.2, 1.0)
    tilted = [np.eye(4), GR.exp_se3(np.array([0, 0, 0, 0.2, 0, 0]))]
    extra = GR.gravity_terms([(1, np.array([0, 0, 1.0]), np.array([0, 0, 1.0]), 500.0)], 2)
    upright, _ = GR.solve_poses(tilted, [], rounds=10, stop=-1, extra=extra)
    assert np.abs(upright[1][:3, 2] - [0, 0, 1]).max() < 1e-6
    assert np.allclose(GR.log_so3(turn(0.4)), [0, 0, 0.4])


def test_closed_form_error_and_kabsch(spark, cloud):
    r, t = turn(0.3), np.array([1.0, 2, 3])
    q = cloud @ r.T + t
    df = spark.createDataFrame([(1, *map(float, a), *map(float, b), 1.0) for a, b in zip(cloud, q, strict=True)], "k int, px double, py double, pz double, qx double, qy double, qz double, w double")
    stats = ST.sums(df, ["k"], ["px", "py", "pz"], ["qx", "qy", "qz"], "w")
    got = stats.select(ST.error(r.ravel(), t).alias("good"), ST.error(r.ravel(), t + [0, 0, 1]).alias("bad")).first()
    assert abs(got.good) < 1e-6 and abs(got.bad - math.sqrt(200) / 200) < 1e-9
    fit = ST.fitted(stats, ["k"]).first()
    assert np.abs(np.array(fit.r) - r.ravel()).max() < 1e-9 and np.abs(np.array(fit.t) - t).max() < 1e-9


def test_schedule_takes_two_peaks_and_closes_gaps():
    values = np.zeros(30)
    values[5:10], values[20:22], values[25:27] = 9, 7, 6
    got = SQ.schedule_of(values)
    assert [i for i, _ in got] == [5, 6, 7, 8, 9, 20, 21, 25, 26]
    assert SQ.schedule_of(np.zeros(9)) == [] and [t for _, t in SQ.schedule_of(np.array([1.0, 2, 3]))] == [1, 1, 3]
    b, f = SQ.belief_of(np.array([0.9] * 6 + [0.05] * 12))
    assert f[:5].all() and not f[-3:].any() and (0 <= b).all() and (b <= 1).all()


def test_components_of_three_agents(spark):
    edges = spark.createDataFrame([("A", "B"), ("B", "C")], "u string, v string")
    nodes = spark.createDataFrame([(x,) for x in "ABCD"], "camera string")
    assert {r.camera: r.root for r in GR.merged_groups(nodes, edges, "camera").collect()} == {"A": "A", "B": "A", "C": "A", "D": "D"}


def test_planes_of_three_walls():
    rng = np.random.default_rng(5)
    a, flat = rng.uniform(0, 3, (400, 2)), np.zeros(400)
    walls = [np.column_stack([a, flat]), np.column_stack([flat - 1, a + 1]), np.column_stack([a[:, 0], flat + 4, a[:, 1] + 1])]
    label = RM.grow_planes(np.vstack(walls), np.repeat(np.eye(3)[[2, 0, 1]], 400, axis=0), 0.4, 200)
    assert set(label) - {-1} == {0, 1, 2}
    for k in range(3):
        own = label[400 * k : 400 * k + 400]
        assert (own == np.bincount(own[own >= 0]).argmax()).mean() > 0.95


def test_a_refused_neighbour_counts_as_visited():
    """Where two planes meet, points that the first refuses stay without one: the rule of the growth."""
    rng = np.random.default_rng(5)
    a, flat = rng.uniform(0, 3, (400, 2)), np.zeros(400)
    label = RM.grow_planes(np.vstack([np.column_stack([a, flat]), np.column_stack([flat, a])]), np.repeat(np.eye(3)[[2, 0]], 400, axis=0), 0.4, 200)
    assert set(label) == {-1, 0, 1}


def test_two_rooms_joined_by_a_door():
    s = RM.Subdivision((0, 0), (10, 6))
    s.insert((1.0, 0.0), -5.0, 0)
    assert len(s.faces) == 2 and sorted(s.areas()) == [30.0, 30.0] and s.locate(1, 1) != s.locate(9, 1) and s.locate(11, 1) == -1
    s.insert((0.0, 1.0), -3.0, 1)
    assert len(s.faces) == 4 and abs(sum(s.areas()) - 60) < 1e-9
    sides = {(a, b): w for a, b, w in s.adjacent()}
    inner = [k for k in sides if -1 not in k]
    assert len(inner) == 4 and all(abs(sides[k] - 5) < 1e-9 or abs(sides[k] - 3) < 1e-9 for k in inner)
    left = [i for i in range(4) if all(x <= 5 for x, _, _ in s.faces[i])]
    # A thick wall between the halves and towards the outside on the left: the left faces are a room.
    weights = {k: 0.05 if set(k) == set(left) else (6.0 if set(k) & set(left) else 0.05) for k in sides}
    assert sorted(RM.room_faces(weights, 4)) == left
    assert RM.merge_lines([(np.array([1.0, 0]), -2.0), (np.array([0.99, 0.1]), -2.1), (np.array([0, 1.0]), -2.0)]) == [0, 0, 1]


def test_near_pairs_and_nearest_are_those_of_all_pairs(spark):
    pts = np.random.default_rng(8).uniform(-1, 1, (150, 3))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "id int, x double, y double, z double")
    got = {(r.a, r.b) for r in RM.near_pairs(df, "id", ["x", "y", "z"], 0.3).collect()}
    d = np.linalg.norm(pts[:, None] - pts[None], axis=2)
    assert got == {(i, j) for i in range(150) for j in range(i + 1, 150) if d[i, j] <= 0.3}
    near = {r.id: r.match for r in RM.nearest(df.where("id < 75"), df.where("id >= 75").withColumnRenamed("id", "t"), "id", "t", ["x", "y", "z"], 0.4).collect()}
    assert near == {i: 75 + int(d[i, 75:].argmin()) for i in range(75) if d[i, 75:].min() <= 0.4}


def test_mean_shift_and_medoids(spark):
    pts = np.vstack([np.random.default_rng(9).normal(c, 0.1, (30, 2)) for c in (0, 5)])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "id int, x double, y double")
    got = {r.id: r for r in RM.mean_shift_clusters(df, "id", ["x", "y"], 0.25).collect()}
    # By brute force: every point to the mean of those within reach, until it stands still; modes within a hundredth are one.
    modes = pts.copy()
    for i in range(len(pts)):
        while True:
            new = pts[np.linalg.norm(pts - modes[i], axis=1) <= 0.25].mean(axis=0)
            way = np.linalg.norm(new - modes[i])
            modes[i] = new
            if way < 0.001:
                break
    cluster = list(range(len(pts)))
    for i in range(len(pts)):
        for j in range(i):
            if np.linalg.norm(modes[i] - modes[j]) <= 0.01 and cluster[i] != cluster[j]:
                low, high = sorted((cluster[i], cluster[j]))
                cluster = [low if c == high else c for c in cluster]
    assert all(abs(got[i].m_x - modes[i][0]) < 1e-9 and got[i].cluster == cluster[i] for i in range(len(pts)))
    assert len(set(cluster)) >= 2 and got[0].cluster != got[45].cluster
    d = spark.createDataFrame([(a, b, float(abs(a - b))) for a in (1, 2, 3, 10, 11) for b in (1, 2, 3, 10, 11) if a != b], "a int, b int, d double")
    own, centres = RM.medoids(d, [1, 11])
    assert own[1] == own[2] == own[3] != own[10] and centres[0] == 2


def test_two_way_score(spark):
    rows = [("ref", 1, i < 120) for i in range(240)] + [("ref", 2, False) for i in range(240)] + [("new", 1, i < 5) for i in range(240)] + [("new", 3, True)] * 10
    df = spark.createDataFrame(rows, "side string, inst int, m boolean")
    got = {r.side: r.score for r in RM.instance_score(df, "side", "inst", "m", 200, {"ref": -0.1, "new": -0.5}).collect()}
    assert got == {"ref": 0.25, "new": -0.5}
    assert RM.instance_score(df.where("inst = 3"), "side", "inst", "m", 200, {}).count() == 0
    assert df.where(F.col("side") == "new").count() == 250


def test_side_weights_against_plain(spark):
    rng = np.random.default_rng(3)
    xy = np.round(rng.uniform(0, 10, (3000, 2)), 3)
    s = RM.Subdivision((0, 0), (10, 6))
    s.insert((0.6, 0.8), -5.0, 0)
    s.insert((1.0, 0.0), -4.0, 1)
    sides = list(s.sides().values())
    assert [(a, b) for a, b, _ in s.adjacent()] == list(s.sides())
    got = {r.side: (r.n, round(r.ratio, 9), round(r.weight, 6)) for r in RM.side_weights(spark.createDataFrame(xy.tolist(), "x double, y double"), sides, 0.3, 80).collect()}
    want = {}
    for i, (x1, y1, x2, y2) in enumerate(sides):
        a, u = np.array([x1, y1]), np.array([x2 - x1, y2 - y1])
        length = np.linalg.norm(u)
        t, off = (xy - a) @ u / length, (xy - a) @ np.array([u[1], -u[0]]) / length
        t = t[(np.abs(off) <= 0.3) & (t >= 0) & (t <= length)]
        if len(t):
            ratio = (t.max() - t.min()) / length
            want[i] = len(t), round(ratio, 9), round(0.0 if len(t) < 80 or ratio <= 0.4 else ratio * len(t), 6)
    assert got == want and any(w for *_, w in got.values()) and not all(w for *_, w in got.values())
    assert RM.side_weights(spark.createDataFrame([], "x double, y double"), sides, 0.3).count() == 0 and RM.side_weights(spark.createDataFrame(xy.tolist(), "x double, y double"), [], 0.3).count() == 0


def test_rooms_come_from_the_points(spark, tmp_path):
    """Other points, other faces; the faces fill the box of the points."""
    from gridloom.plans import rooms

    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    li.write.parquet(str(tmp_path / "a" / "lineitem.parquet"))
    li.where("l_quantity < 25").write.parquet(str(tmp_path / "b" / "lineitem.parquet"))
    li.where("l_quantity < 0").write.parquet(str(tmp_path / "c" / "lineitem.parquet"))
    got = {n: rooms.room_extraction(spark, str(tmp_path / n)).collect() for n in "abc"}
    box = li.selectExpr("(max(l_quantity) - min(l_quantity)) * (max(l_extendedprice) - min(l_extendedprice)) / 2000").first()[0]
    assert abs(sum(r.area for r in got["a"]) - box) < 0.01 * len(got["a"]) and len(got["a"]) > 4
    assert sorted(r.area for r in got["a"]) != sorted(r.area for r in got["b"]) and got["c"] == []

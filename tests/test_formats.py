import struct

import numpy as np
import pandas as pd
import pytest

from gridloom.sources import formats as S


@pytest.fixture
def put(tmp_path):
    def write(name, data):
        path = tmp_path / name
        path.write_bytes(data if isinstance(data, bytes) else data.encode())
        return str(path)

    return write


def test_text_scans(spark, put):
    got = S.associations(spark, put("associate.txt", "1.0 a.png 2.0 b.png\nbad line\n\n3 c 4 d e\n5 c.png 6 d.png\n")).collect()
    assert [(r.ts, r.rgb_path) for r in got] == [(1.5, "a.png"), (5.5, "c.png")]
    rows = S.trajectory(spark, put("groundtruth.txt", "1 2 3 4 5 6 7 8\n1 2 3\n1 2 3 4 5 6 7 x\n")).collect()
    assert rows[0].qw == 8 and rows[1].ts is None and rows[2].qw is None
    cam = S.calibration(spark, put("calib.txt", "640 480 500 501 320 240 0 0 0 0 0 1000 8\n")).first()
    assert (cam.width, cam.fy, list(cam.d), cam.max_depth) == (640, 501.0, [0.0] * 5, 8.0)
    assert S.calibration(spark, put("bad.txt", "1 2 3\n")).first().fx == 525.0
    assert S.settings('%YAML:1.0\nn: 3 # three\nx: 0.5\nname: "a b"\nempty:\n', {"spare": 1}) == {"spare": 1, "n": 3, "x": 0.5, "name": "a b"}
    sbp = S.submap_poses(spark, put("0.sbp", "1\n7 1 0 0 0 1 0 0 0 1 4 5 6\n")).first()
    assert sbp.submap_id == 7 and list(sbp.t) == [4.0, 5.0, 6.0] and list(sbp.r) == [1, 0, 0, 0, 1, 0, 0, 0, 1]
    room = {r.room_id: list(r.submaps) for r in S.rooms(spark, put("0.room", "2\n0 3 1 2 5\n1 1 4\n")).collect()}
    assert room == {0: [1, 2, 5], 1: [4]}
    assert [(r.agent_id, r.path) for r in S.base_paths(spark, put("base_paths.txt", "1\n0 /data/a\n")).collect()] == [(0, "/data/a")]


def test_clouds_round_trip(spark, put, tmp_path):
    df = spark.createDataFrame([(i, i * 0.5, 1.0, 2.0, 0.0, 0.0, 1.0, i * 10000 + 9999) for i in range(20)], "idx long, x double, y double, z double, nx double, ny double, nz double, label long")
    S.write_fpcd(df, str(tmp_path / "cloud"), "idx")
    got = S.fpcd(spark, str(tmp_path / "cloud")).orderBy("idx").collect()
    assert len(got) == 20 and all(r.complete for r in got) and [r.label for r in got] == [i * 10000 + 9999 for i in range(20)]
    short = S.fpcd(spark, put("short.fpcd", "3\n1 2 3 0 0 1 5\n")).collect()
    assert len(short) == 1 and not short[0].complete
    pdf = pd.DataFrame({"x": [0.0, 1, 0], "y": [0.0, 0, 1], "z": [0.0, 0, 0.25], "red": [1, 2, 3], "green": [4, 5, 6], "blue": [7, 8, 9]})
    path = put("a.ply", S.ply_text(pdf, [(0, 1, 2)]))
    pts = S.ply_points(spark, path).orderBy("idx").collect()
    assert [r.z for r in pts] == [0, 0, 0.25] and [r.red for r in pts] == [1, 2, 3] and pts[0].nx is None
    binary = put("b.ply", S.ply_binary(pdf, [(0, 1, 2), (2, 1, 0)]))
    assert [(r.v0, r.v1, r.v2) for r in S.ply_faces(spark, binary).orderBy("tri_id").collect()] == [(0, 1, 2), (2, 1, 0)]
    assert [r.z for r in S.ply_points(spark, binary).orderBy("idx").collect()] == [0, 0, 0.25]


def test_binary_files(spark, put):
    a = np.arange(6, dtype="int32")
    assert (S.npy_array(S.npy_bytes(a)) == a).all() and (S.npz_arrays(S.npz_bytes(u=a, v=a + 1))["v"] == a + 1).all()
    s, i = put("3_semantic.npy", S.npy_bytes(a)), put("3_instance.npy", S.npy_bytes(a * 2))
    assert sorted((r.idx, r.semantic, r.instance) for r in S.labels(spark, s, i).collect()) == [(k, k, 2 * k) for k in range(6)]
    one = np.arange(13.0)
    assert S.submap_info(spark, put("submaps_info.txt", np.concatenate([[1.0], one]).tobytes())).first().t == [10.0, 11.0, 12.0]
    assert S.keyframe_info(spark, put("keyframes_info.txt", np.concatenate([[1.0], np.arange(26.0)]).tobytes())).first().rel_t == [23.0, 24.0, 25.0]
    # The count says 3, two records are there.
    got = S.correspondences(spark, put("corrs.txt", np.concatenate([[3.0], np.arange(45.0), np.arange(45.0)]).tobytes())).collect()
    assert len(got) == 2 and got[0].new == 1 and len(got[0].sums) == 43
    data = S.spill_bytes([((1, 2, 3), {0: (0.5, 1.0), 4: (999.0, 0.0), 9: (-0.25, 2.0)}), ((0, 0, -1), {})])
    rows = S.spilled(spark, put("0.map", data)).collect()
    assert [(r.cx, r.vid, r.sdf, r.weight) for r in rows] == [(1, 0, 0.5, 1.0), (1, 9, -0.25, 2.0)]
    packed = S.pack_points(np.ones((2, 3)), np.zeros((2, 3)), np.full((2, 3), 0.5))
    assert len(packed) == 60 and (S.unpack_points(packed)["n"] == 0.5).all()


def test_raw_log_source_and_stream(spark, put, tmp_path):
    frames = [(100 + k, struct.pack("<4H", k, k, k, k), bytes([k]) * 3) for k in range(10)]
    path = put("log.klg", S.raw_log_bytes(frames))
    spark.dataSource.register(S.RawLog)
    rows = spark.read.format("rawlog").option("frames", 3).load(path).orderBy("frame").collect()
    assert [(r.stamp, bytes(r.depth), bytes(r.colour)) for r in rows] == frames
    assert len(S.raw_log_index(S.raw_log_bytes(frames)[:-2])) == 9
    q = spark.readStream.format("rawlog").option("frames", 4).load(path).writeStream.format("memory").queryName("log").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    try:
        for _ in range(30):
            q.awaitTermination(1)
            if spark.table("log").count() >= 10:
                break
    finally:
        q.stop()
    assert sorted(r.frame for r in spark.table("log").collect()) == list(range(10))


def test_trajectory_and_state_files(spark, tmp_path):
    df = spark.createDataFrame([(1.5, 1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 1.0, True), (2.5, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, False)], "ts double, tx double, ty double, tz double, qx double, qy double, qz double, qw double, ok boolean")
    S.write_trajectory(df, str(tmp_path / "t"), df.ok)
    assert [tuple(r) for r in S.trajectory(spark, str(tmp_path / "t")).collect()] == [(1.5, 1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 1.0)]
    S.write_counted(df, str(tmp_path / "s"), df.ts.cast("string"), "ts")
    assert [r.value for r in spark.read.text(str(tmp_path / "s")).collect()] == ["2", "1.5", "2.5"]

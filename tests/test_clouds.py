from collections import defaultdict

from gridloom.plans import voxels as P
from gridloom.plans.carriers import points


def test_clouds_of_all_cameras_are_concatenated(spark, sf):
    want = defaultdict(lambda: [0, 0.0])
    for r in points(spark, sf).select("submap", "camera", "x").collect():
        want[r.submap][0] += 1
        want[r.submap][1] += r.x + 100 * r.camera
    got = {r.submap: (r.n, r.x) for r in P.concatenated_clouds(spark, sf).collect()}
    assert set(got) == set(want)
    assert all(got[k][0] == n and abs(got[k][1] - x) < 1e-2 for k, (n, x) in want.items())

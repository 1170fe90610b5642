from gridloom.operators import sparse as SP
from gridloom.plans import rooms as P


def all_sites(spark, sf):
    return {(r.sx, r.sy): (r.a, r.b) for r in P.sites(spark, sf).collect()}


def windows(k, last):
    """Windows of three at every second place, up to the first that holds the last site."""
    return [o for o in range(k // 2 + 1) if 0 <= k - 2 * o <= 2 and (o == 0 or 2 * (o - 1) + 2 < last)]


def test_strided_takes_every_site(spark, sf):
    want, sites = {}, all_sites(spark, sf)
    last = max(max(k) for k in sites)
    for (x, y), (a, b) in sites.items():
        for ox in windows(x, last):
            for oy in windows(y, last):
                tap = (x - 2 * ox) * 3 + y - 2 * oy
                at = want.setdefault((ox, oy), [0.1, 0.2])
                for o in range(2):
                    at[o] += a * P.weight(tap, 0, o) + b * P.weight(tap, 1, o)
    got = {(r.sx, r.sy): (r.y0, r.y1) for r in P.strided(spark, sf).collect()}
    assert set(got) == set(want) and max(y for _, y in got) > 30
    assert all(abs(g - w) < 1e-4 for k in got for g, w in zip(got[k], want[k], strict=True))


def test_transposed_and_unet_reach_every_site(spark, sf):
    sites = all_sites(spark, sf)
    assert {(r.sx, r.sy) for r in P.transposed(spark, sf).collect()} == set(sites)
    whole = lambda rows: {(r.sx, r.sy): (round(r.a, 3), round(r.b, 3)) for r in rows.collect()}

    def params(name, ins, outs, taps):
        return [[[P.weight(t + len(name), i, o) / ins for o in range(outs)] for i in range(ins)] for t in range(taps)], [0.01] * outs

    got, want = whole(P.unet(spark, sf)), whole(SP.unet(P.sites(spark, sf), P.K, ["a", "b"], 2, 256, params))
    assert set(got) == set(sites) == set(want)
    assert all(abs(g - w) < 2e-3 for k in got for g, w in zip(got[k], want[k], strict=True))


def test_extent_holds_the_last_site(spark):
    for last in range(1, 12):
        for size, stride in ((3, 2), (2, 2), (2, 3)):
            extent = SP.extent_of(spark.createDataFrame([(0, last)], "x long, y long"), ["x", "y"], size, stride)
            assert ((extent - size) // stride) * stride + size > last

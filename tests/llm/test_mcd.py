"""The robust estimates of the quality rules against a plain numpy version."""

import numpy as np
import pytest

from tremorlake.llm import quality_rules as Q


def _plain(x):
    """Concentration from the same three starts, exact quantiles."""
    size, floors = x.shape[1], np.diag(np.square(Q.FLOORS))
    half = (len(x) + 1) // 2 - 1  # the lower of two middle values
    m = np.sort(x, axis=0)[half]
    d = np.maximum(1.4826 * np.sort(np.abs(x - m), axis=0)[half], Q.FLOORS)
    wound = np.corrcoef(np.tanh((x - m) / d), rowvar=False) * np.outer(d, d)
    best = None
    for centre, scatter in ((m, np.diag(d * d)), (m, wound), (x.mean(axis=0), np.cov(x, rowvar=False, bias=True))):
        scatter, old = scatter + floors, np.inf
        for _ in range(100):
            gap = x - centre
            d2 = np.einsum("ij,jk,ik->i", gap, np.linalg.inv(scatter), gap)
            near = x[d2 <= np.sort(d2)[int(np.ceil(Q.NEAREST * len(x))) - 1]]
            c, s = near.mean(axis=0), Q.CONSISTENT * np.cov(near, rowvar=False, bias=True) + floors
            now = np.linalg.slogdet(s)[1]
            if now >= old - Q.FALL:
                break
            centre, scatter, old = c, s, now
        if best is None or old < best[0]:
            best = (old, centre, scatter)
    assert size == len(Q.STATS)
    return best


@pytest.mark.parametrize("share", [0.0, 0.2])
def test_estimates_equal_a_plain_version(spark, share):
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(5, 5))
    groups = {}
    for gid in (1, 2):
        x = rng.normal(size=(400, 5)) @ mix * gid + gid
        far = int(share * len(x))
        x[:far] = rng.normal(size=(far, 5)) * 0.3 + 25 * gid  # planted: a tight clump far away
        groups[gid] = x
    rows = [(gid, *map(float, row)) for gid, x in groups.items() for row in x]
    rows = spark.createDataFrame(rows, "gid bigint, " + ", ".join(f"{s} double" for s in Q.STATS))
    got = {r.gid: r for r in Q.estimates(rows).collect()}
    for gid, x in groups.items():
        log_det, centre, scatter = _plain(x)
        assert got[gid].log_det == pytest.approx(log_det, abs=1e-5)
        assert [got[gid][f"m_{i}"] for i in range(5)] == pytest.approx(list(centre), abs=1e-5)
        assert got[gid].c_3_1 == pytest.approx(scatter[3, 1], abs=1e-4)
    measured = Q._distance(rows.where("gid = 1"), spark.createDataFrame(list(got.values())))
    far = measured.where(f"s_words > 15 and d2 > {Q.LIMIT}").count()
    assert far >= int(share * 400)

"""Components and star moments across tiles against whole-frame labels."""

import numpy as np
import pytest

from nightloom.operators import components as C
from nightloom.operators import registration as R


def masks():
    rng = np.random.default_rng(3)
    out = [rng.random((23, 31)) < p for p in (0.15, 0.42, 0.6)] + [np.ones((9, 20), bool)]
    spiral = np.zeros((31, 31), bool)
    for k in range(0, 15, 2):
        spiral[k, k : 31 - k] = spiral[30 - k, k : 31 - k] = spiral[k : 31 - k, k] = spiral[k : 31 - k, 30 - k] = True
    return [*out, spiral]


@pytest.mark.parametrize("tile", [1, 5, 16])
def test_labels_do_not_depend_on_tiles(spark, tile):
    cells = [(f, int(x), int(y)) for f, m in enumerate(masks()) for y, x in zip(*np.nonzero(m), strict=True)]
    got = {(r.frame, r.x, r.y): r.component for r in C.label_cells(spark.createDataFrame(cells + cells[:9], "frame long, x long, y long"), tile).collect()}
    assert len(got) == len(cells)
    for f, m in enumerate(masks()):
        want = R.label(m) - 1
        for y, x in zip(*np.nonzero(m), strict=True):
            assert got[f, x, y] == want[y, x] // m.shape[1] * C.ROW + want[y, x] % m.shape[1]


def test_moments_merge(spark):
    rng = np.random.default_rng(5)
    v = rng.random((40, 50)) * 3
    for x, y in ((10.3, 8.8), (31.7, 16.2), (15.9, 31.5)):
        yy, xx = np.mgrid[0:40, 0:50]
        v += 60 * np.exp(-((xx - x) ** 2 + (yy - y) ** 2 / 2) / 6)
    cells = [(0, int(x), int(y), float(v[y, x] - 2)) for y, x in zip(*np.nonzero(v > 10), strict=True)]
    got = C.star_moments(spark.createDataFrame(cells, "frame long, x long, y long, w double"), 8).orderBy("flux", ascending=False).collect()
    want = R.star_moments(v, 2.0, 10.0)
    assert len(got) == len(want) == 3
    for r, (_, w) in zip(got, want.iterrows(), strict=True):
        np.testing.assert_allclose([r.flux, r.x, r.y, r.hfr, r.eccentricity], w.to_numpy(), rtol=1e-9)


def test_no_cells(spark):
    assert C.label_cells(spark.createDataFrame([], "frame long, x long, y long")).count() == 0

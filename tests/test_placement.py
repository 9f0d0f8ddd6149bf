import numpy as np
import pytest

from arcweave.operators import placement, search


@pytest.mark.parametrize("floor", [3.0, 16.0])
def test_floors_hold_and_order_counts(spark, floor):
    rng = np.random.default_rng(4)
    old, centers = rng.normal(size=(40, 3)), rng.normal(size=(30, 3))
    centers[10:20] = centers[10] + 0.01 * rng.normal(size=(10, 3))  # a crowd
    rows = [(i, v.tolist(), 25.0) for i, v in enumerate(centers)] + [(90, [0.0, 0.0, 0.0], 25.0)]
    asked = spark.createDataFrame(rows, "id long, vector array<double>, cone double").repartition(3)
    frame = spark.createDataFrame([(1000 + i, v.tolist()) for i, v in enumerate(old)], "id long, vector array<double>")
    draws = {}
    for r in placement.draws_in_cones(asked).collect():
        draws.setdefault(r.id, {})[r.draw] = np.array(r.vector)
    assert set(draws) == set(range(30)) and all(len(d) == placement.DRAWS for d in draws.values())
    assert all(search._angles(np.array([centers[i]]), np.array(list(d.values()))).max() <= 25.0 + 1e-6 for i, d in draws.items())

    index = search.AngularIndex.build(frame)
    got = {r.id: r for r in placement.place(index, asked, floor).collect()}
    assert set(got) == set(range(30)) | {90} and got[90].vector is None
    kept = []
    for i in range(30):  # one by one
        d = draws[i]
        clear = {k: search._angles(v[None, :], old).min() for k, v in d.items()}
        best = next((k for k in sorted(d, key=lambda k: (-round(clear[k], 9), k)) if clear[k] >= floor and (not kept or search._angles(d[k][None, :], np.array(kept)).min() >= floor)), None)
        assert (got[i].vector is None) == (best is None)
        if best is not None:
            assert np.allclose(got[i].vector, d[best]) and got[i].clearance == pytest.approx(clear[best])
            kept.append(d[best])
    t = search._angles(np.array(kept), np.r_[old, kept])
    t[np.arange(len(kept)), 40 + np.arange(len(kept))] = 180
    assert t.min() >= floor and (floor > 3.0 or len(kept) == 30)
    assert sum(c.rows for c in index.cells.values()) == 40 + len(kept)

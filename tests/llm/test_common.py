import os

import numpy as np
import pyarrow as pa

from arcweave.llm import common
from arcweave.llm.shingles import pack, shingle_set, unpack, windows


def test_pack_round_trip():
    rng = np.random.default_rng(1)
    kind = np.dtype([("t", "<u8"), ("doc", "<i8"), ("pos", "<u4")])
    for n in (0, 1, 7, 5000):
        table = np.zeros(n, kind)
        table["t"], table["doc"], table["pos"] = rng.integers(0, 2**63, n), np.sort(rng.integers(-5, 50, n)), np.arange(n)
        names, payloads = pack(rng.integers(0, 3, n), table, most=700)
        back = unpack(pa.array(payloads, pa.binary()), kind)
        assert sorted(back.tolist()) == sorted(table.tolist()) and len(names) == len(payloads)


def test_windows_and_sets():
    h = np.arange(10, dtype=np.uint64)
    assert len(windows(h, 5)) == 6 and len(windows(h, 11)) == 0
    assert len(shingle_set(h[:0])) == 0 and len(shingle_set(h[:3])) == 1 and len(shingle_set(np.zeros(50, np.uint64))) == 1


def test_staged_tables(spark):
    t = common.stage(spark.range(5), "five")
    path = t._arcweave_path.removeprefix("file:")
    assert t.count() == 5 and common.again(t).count() == 5 and os.path.isdir(path)
    kept = common.staged()
    u = common.stage(spark.range(3), "three")
    common.clean(spark, but=kept)
    assert os.path.exists(path) and not os.path.exists(u._arcweave_path.removeprefix("file:"))
    common.clean(spark)
    assert not os.path.exists(path) and not common.staged()


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    import pytest

    from arcweave.sources import workspace

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: {})
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext, conf = Context, {}

    with pytest.raises(ValueError):
        workspace.shared_folder(Session)


def test_beside_goes_by_number(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (None, "b", "y"), (2, "c", "z")], "c1 int, s0 string, s1 string")
    side = spark.createDataFrame([(1, "one")], "k long, v string")
    out = common.beside(docs, "c1", side, "k", "v", lambda columns, values: [columns[0], columns[1], pa.array([v or "-" for v in values])])
    assert out.columns == docs.columns and sorted((r.s0, r.s1) for r in out.collect()) == [("a", "one"), ("b", "-"), ("c", "-")]

"""Ranks and shuffles of large groups, exports and turns of odd tables: whole results without a task that has a group."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from arcweave.operators import ordered, search
from arcweave.plans import registry
from arcweave.plans.dialect import SPARK


def embeddings(spark, folder, ids, level=lambda i: i):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=64)], level(i)) for i in ids]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def test_export_json_where_names_are_cut(spark, tmp_path):
    """ids of six digits share names of five; each concept is still one row."""
    at = embeddings(spark, tmp_path, [12345, 123450, 123451, 123452])
    rows = registry.queries()["export_json"](spark, at).collect()
    assert [r.name for r in rows] == ["C12345"] * 4 and len({r.x for r in rows}) == 4


def test_correlation_of_what_never_changes(spark):
    """a rank that never changes has no correlation, and is no error."""
    at = lambda x: spark.sql(f"SELECT {SPARK.corr('a', 'b')} AS c FROM VALUES {x} AS t(a, b)").first().c
    assert math.isnan(at("(1e0, 1e0), (1e0, 2e0), (1e0, 4e0)")) and abs(at("(1e0, 2e0), (2e0, 4e0), (3e0, 6e0)") - 1) < 1e-12
    assert SPARK.corr("rd", "ra") in next(q for q in registry._all() if q.name == "rotation_statistics").text(SPARK)


def test_numbers_and_mean_ranks_in_groups(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(9), i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, v long, id long").repartition(5)
    number = {r.id: r.place for r in ordered.numbered(df, ["g"], ["v", "id"]).collect()}
    rank = {r.id: r.rk for r in ordered.mean_ranks(df, ["g"], "v").collect()}
    for g, v, i in rows:
        own = [(w, j) for h, w, j in rows if h == g]
        assert number[i] == sum(x <= (v, i) for x in own)
        less, same = sum(w < v for w, _ in own), sum(w == v for w, _ in own)
        assert rank[i] == less + (same + 1) / 2


@pytest.mark.parametrize("name", ["spearman_by_group", "pooled_rank_corr", "median_error_null", "incremental_auroc"])
def test_no_window_over_a_group(spark, name):
    """no window by the group's key, of which there are few."""
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    keys = [w.split("], [")[1] for w in plan.splitlines() if "Window [" in w]
    assert keys and all(k.startswith("_p#") for k in keys)  # ranges of the order, and one line a range


def test_contraction_has_no_nested_loop(spark):
    """pairs of replicates meet by their number."""
    plan = registry.queries()["contraction"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not any(" OR " in w for w in plan.splitlines() if "Join" in w)


def test_shifts_over_borders_of_blocks(spark, tmp_path, monkeypatch):
    """the same agreement from small blocks as from one."""
    from arcweave.operators import inference

    at = embeddings(spark, tmp_path, range(0, 300, 2))
    one = {(r.s, r.axis): r.hits for r in inference.shifted_agreement(spark, at).collect()}
    monkeypatch.setattr(inference, "BLOCK", 16)
    assert {(r.s, r.axis): r.hits for r in inference.shifted_agreement(spark, at).collect()} == one and len(one) == 41 * 7


def test_trained_floor_needs_no_pairs(spark):
    """F16: the nearest of a class comes from the search, without a join by class."""
    plan = registry.queries()["trained_floor"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


@pytest.mark.parametrize("zero,most,own", [(90.0, 180.0, True), (0.0, 180.0, False), (90.0, 25.0, True)])
def test_closest_is_the_sorted_row(zero, most, own):
    """the product rules out, angles decide; copies, ties and vectors without length."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 5))
    x[10:14], x[20] = x[9], 0.0
    ids = rng.permutation(300)
    q = np.r_[x[:40], np.zeros((1, 5))]
    i, j, t = search._closest(q, x, np.r_[ids[:40], -1], ids, np.full(41, most), 6, own, 9, zero)
    full = search._angles(q, x, zero)
    for k in range(41):
        want = sorted((round(a, 9), b) for a, b in zip(full[k], ids) if a <= most and not (own and k < 40 and b == ids[k]))[:6]
        assert [b for _, b in want] == ids[j[i == k]].tolist()
        assert np.allclose([a for a, _ in want], t[i == k], atol=1e-8)


def test_routed_queries_go_on_in_small_batches(spark, monkeypatch):
    """what a worker holds at once does not grow with the batch that Spark sends it."""
    rng = np.random.default_rng(8)
    monkeypatch.setattr(search, "SHARD_ROWS", 16)
    monkeypatch.setattr(search, "CELL_ROWS", 16)
    monkeypatch.setattr(search, "ROUTED_ROWS", 8)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(200, 8)))], "id long, vector array<double>").coalesce(1)
    seen = []
    index = search.AngularIndex.build(v)

    class Rows:
        def mapInArrow(self, run, schema):
            self.run = run
            return self

    rows = Rows()
    index._routed(rows, lambda t, *_: np.ones(t.shape, bool))
    n = 50
    batch = pa.RecordBatch.from_arrays([pa.array([""] * n), pa.array(range(n)), pa.array([[1.0] * 8] * n), pa.array([180.0] * n), pa.array([-2] * n, pa.int32())], names=["_g", "_q", "_x", "_tau", "_home"])
    seen = [b.num_rows for b in rows.run([batch])]
    assert sum(seen) == n * len(index.cells) and max(seen) == 8 * len(index.cells)

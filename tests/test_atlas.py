"""Planted fixtures with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from arcweave.atlas import Atlas
from arcweave.functions import geometry as G
from arcweave.operators import models
from arcweave.operators.search import nearest
from arcweave.streaming import runlog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def axes(spark):
    rows = [(1, "EAST", 1.0, 0.0, 0.0), (2, "NORTH", 0.0, 1.0, 0.0), (3, "UP", 0.0, 0.0, 1.0), (4, "NONE", 0.0, 0.0, 0.0), (5, "EAST2", 1.0, 0.0, 0.0)]
    c = spark.createDataFrame(rows, "id long, name string, x double, y double, z double")
    for i, k in enumerate(G.DOMAIN):
        c = c.withColumn(k, F.lit(0.5 if i == 0 else 0.0))
    for k in G.FUNCTION:
        c = c.withColumn(k, F.lit(0.0))
    c = c.withColumn("level", F.lit(1).cast("long")).withColumn("trigram", G.trigram())
    a = spark.createDataFrame([("SUNRISE", 1)], "alias string, concept_id long")
    r = spark.createDataFrame([], "c1 long, c2 long, rel_type string, angle4 double, angle8 double")
    return Atlas(c, a, r)


def test_axes_are_orthogonal(axes):
    r = axes.angle("east", "north").first()
    assert r.angle3 == pytest.approx(90) and r.witness == pytest.approx(1) and r.relation == "complement"
    assert axes.angle("east", "none").first().angle3 == 0.0 and axes.angle("east", "none").first().witness == 1.0


def test_lookup(axes):
    assert axes.get("sunrise").first().id == 1 and axes.exists("Up") and not axes.exists("down") and axes.count() == 5
    assert [r.name for r in axes.by_trigram("qian").collect()] == ["EAST", "EAST2", "NORTH"]
    with pytest.raises(ValueError):
        axes.by_domain("x")


def test_neighbors_and_ties(axes):
    got = [(r.place, r.name, r.angle) for r in axes.neighbors("east", 3, G.CORE).collect()]
    assert got[0] == (1, "EAST2", 0.0) and [g[2] for g in got[1:]] == [90.0, 90.0] and [g[1] for g in got[1:]] == ["NORTH", "UP"]


def test_compose_and_slerp(axes):
    c = axes.compose("east", "north").first()
    assert (c.x, c.y, c.w) == (0.5, 0.5, 1.0)
    s = axes.slerp("east", "north", 0.5).first()
    assert s.x == pytest.approx(math.sqrt(0.5)) and s.y == pytest.approx(math.sqrt(0.5))


def test_gate_and_growth(spark, axes):
    new = axes.concepts.where("id IN (1, 3)").withColumn("id", F.col("id") + 100).withColumn("name", F.when(F.col("id") == 101, "SUNRISE").otherwise("TOP"))
    v = {r.name: r.verdict for r in axes.check(new).collect()}
    assert v == {"SUNRISE": "alias", "TOP": "near"}
    assert axes.add(new).count() == 5 and axes.add(new, force=True).count() == 7
    grown = axes.relate(spark.createDataFrame([(1, 2), (2, 1), (1, 3)], "c1 long, c2 long"))
    assert grown.relations.count() == 2 and {r.rel_type for r in grown.relations.collect()} == {"complement"}
    assert grown.relate(spark.createDataFrame([(3, 1)], "c1 long, c2 long")).relations.count() == 2
    assert {r.name for r in grown.orphans().collect()} == {"NONE", "EAST2"}


def test_binding_matches_queries(spark):
    a = Atlas.of_embeddings(spark, SF)
    from arcweave.plans import registry

    want = {(r.value, r.n) for r in registry.queries()["distributions"](spark, SF).where("kind = 'rel_type'").collect()}
    assert {(r["value"], r["count"]) for r in a.statistics().where("kind = 'rel_type'").collect()} == want


def test_nearest_is_exact_over_blocks(spark):
    import arcweave.operators.search as S

    c = G.concepts(spark.read.parquet(f"{SF}/embeddings.parquet")).select("id", F.array(*G.ESSENCE).alias("vector"))
    one = sorted(map(tuple, nearest(c, c.where("id < 40"), 5).collect()))
    old = S.SHARD_ROWS, S.BLOCK_ROWS
    S.SHARD_ROWS, S.BLOCK_ROWS = 70, 9
    try:
        assert sorted(map(tuple, nearest(c, c.where("id < 40"), 5).collect())) == one
    finally:
        S.SHARD_ROWS, S.BLOCK_ROWS = old
    assert nearest(c.limit(0), c, 5).count() == 0


def test_models_on_planted_data(spark):
    import numpy as np

    assert models.pav(np.array([1.0, 3, 2, 4]), np.ones(4)).tolist() == [1, 2.5, 2.5, 4]
    rows = [(0, [float(i), 2.0 * i]) for i in range(1, 30)]
    g = models.gram(spark.createDataFrame(rows, "fold int, v array<double>"), 1)[0]
    assert models._solve(g, 1)[0, 0] == pytest.approx(2.0)


@pytest.mark.parametrize("name", sorted(models.QUERIES))
def test_models_run(spark, name):
    assert models.QUERIES[name][1](spark, SF).count() > 0


def test_stream_windows(spark, tmp_path):
    """All windows of a drained stream, and a second run over more files that goes on from the first one's state."""
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.where("event_id % 2 = 0").coalesce(1).write.parquet(f"{tmp_path}/e")
    e.where("event_id % 2 = 1").coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
    s = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/e")
    got = runlog.latest(runlog.final_stream(s), ["call_id"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, runlog.final_stream(e).collect()))
    assert runlog.latest(runlog.windowed_rates(s, late="400 days"), ["window", "event_type"]).agg(F.sum("n")).first()[0] == e.count()


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    """Two drops of files with a new query between them: the second reads its own files only and adds to the kept state."""
    e = spark.read.parquet(f"{SF}/events.parquet")
    drop, folder = str(tmp_path / "drop"), str(tmp_path / "state")
    read = lambda: spark.readStream.schema(e.schema).parquet(drop)
    first, second = e.where("event_id % 3 = 0"), e.where("event_id % 3 <> 0")
    first.write.mode("append").parquet(drop)
    one = runlog.latest(runlog.final_stream(read()), ["call_id"], folder)
    assert one._read == first.count() and sorted(map(tuple, one.collect())) == sorted(map(tuple, runlog.final_stream(first).collect()))
    second.repartition(3).write.mode("append").parquet(drop)
    two = runlog.latest(runlog.final_stream(read()), ["call_id"], folder)
    assert two._read == second.count() and sorted(map(tuple, two.collect())) == sorted(map(tuple, runlog.final_stream(e).collect()))
    three = runlog.latest(runlog.final_stream(read()), ["call_id"], folder)
    assert three._read == 0 and three.count() == two.count()

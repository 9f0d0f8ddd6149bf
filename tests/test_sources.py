import gzip
import json

from pyspark.sql import functions as F

from arcweave.functions import geometry as G
from arcweave.sources import tables as S

SF = "/root/testdata/sf0.001"


def concepts(spark):
    return G.concepts(spark.read.parquet(f"{SF}/embeddings.parquet")).where("id < 50")


def aliases(spark):
    return spark.createDataFrame([("A", 1), ("B", 1), ("C", 3)], S.ALIASES)


def test_batch(spark, tmp_path):
    p = tmp_path / "b.json"
    p.write_text(json.dumps([{"name": "fog", "x": 1, "y": 0, "z": 0, "level": "atom"}, {"name": "dew", "x": 0, "y": 1, "z": 0, "h": -2, "level": 4, "aliases": ["drop"]}]))
    r = {x.name: x for x in S.read_batch(spark, str(p)).collect()}
    assert r["FOG"].level == 2 and r["FOG"].e == 0.0 and r["FOG"].aliases == []
    assert r["DEW"].level == 4 and r["DEW"].trigram == "DUI" and r["DEW"].aliases == ["drop"]


def test_entries_and_lists(spark, tmp_path):
    p = tmp_path / "e.txt"
    p.write_text("# head\nfog | grey mist | kan\nstone\n\n")
    assert [tuple(x) for x in S.read_entries(spark, str(p)).orderBy("name").collect()] == [("FOG", "grey mist", "KAN"), ("STONE", "", "QIAN")]
    assert S.read_claim_list(spark, str(p)).count() == 2
    p.write_text("**Calm** - blue, slow\n1. Storm\nfields\n")
    assert [x.name for x in S.read_state_list(spark, str(p)).orderBy("place").collect()] == ["Calm", "Storm"]


def test_csv_claims_and_matrix(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text("question,correct,incorrect,category\nQ1,a;b,c,x\nQ2,d,,y\n")
    assert S.read_claims_csv(spark, str(p)).count() == 4
    assert S.read_claims_csv(spark, str(p), "y").count() == 1
    m = tmp_path / "m.csv"
    m.write_text("panel,red,blue\np1,0.5,0.25\n")
    assert sorted((r.panel, r.key, r.value) for r in S.read_matrix_csv(spark, str(m), ["red", "blue"]).collect()) == [("p1", "blue", 0.25), ("p1", "red", 0.5)]


def test_run_log_and_raters(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"call_id":"1","status":"retry"}\n{"call_id":"1","status":"ok"}\n')
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write('{"call_id":"2","status":"ok"}\n')
    assert S.read_run_log(spark, str(tmp_path)).count() == 3
    p = tmp_path / "r.txt"
    p.write_text("OUTPUT\nREL a b OPP 120\nREL a c SYN\nPOL a NEG\nnoise\n")
    rows, dropped = S.read_rater_lines(spark, str(p))
    assert dropped == 1 and {(r.kind, r.a, r.b, r.label, r.degrees) for r in rows.collect()} == {("REL", "a", "b", "OPP", 120.0), ("REL", "a", "c", "SYN", None), ("POL", "a", None, "NEG", None)}


def test_sinks_round_trip(spark, tmp_path):
    c, a = concepts(spark), aliases(spark)
    S.write_json(c, a, f"{tmp_path}/j")
    back = spark.read.json(f"{tmp_path}/j")
    assert back.count() == 50 and back.where("name = 'C00001'").first().aliases == ["A", "B"]
    S.write_arrays(c, f"{tmp_path}/n")
    assert spark.read.parquet(f"{tmp_path}/n").select(F.size("full")).first()[0] == 14
    S.write_names(c, f"{tmp_path}/t")
    assert spark.read.text(f"{tmp_path}/t").count() == 50
    S.write_csv(c, f"{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").count() == 50
    S.write_dedup_manifest(c, a, f"{tmp_path}/d")
    assert spark.read.json(f"{tmp_path}/d").where("aliases IS NOT NULL").count() == 2
    r = spark.createDataFrame([("1", "s", "ok", 0, 0.0, 0.1, "x")], S.RUN_RECORDS)
    S.append_records(r, f"{tmp_path}/log")
    S.append_records(r, f"{tmp_path}/log", compress=True)
    assert S.read_run_log(spark, f"{tmp_path}/log").count() == 2
    S.ship(c.select(F.col("id").alias("key"), F.array("x", "y").alias("v")), f"{tmp_path}/parts", 20)
    assert S.read_parts(spark, f"{tmp_path}/parts").count() == 50
    S.append_validation(c.select((F.col("id") > 1).alias("valid"), F.col("name").alias("issue")), f"{tmp_path}/v")
    assert json.loads(spark.read.parquet(f"{tmp_path}/v").first().issues) == ["C00000", "C00001"] or len(json.loads(spark.read.parquet(f"{tmp_path}/v").first().issues)) == 2
    S.write_session(spark.createDataFrame([(1, "t", "r")], "n int, timestamp string, result string"), f"{tmp_path}/s", "one")
    assert spark.read.json(f"{tmp_path}/s").first()["count"] == 1
    assert S.read_sessions(spark, f"{tmp_path}/s").count() == 1

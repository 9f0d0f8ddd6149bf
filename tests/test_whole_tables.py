"""Queries that once read a part of their rows, on small tables made for them."""

import glob
import math
import os

import duckdb
import numpy as np
import pytest

from arcweave.functions import geometry as G
from arcweave.model import concepts, relations
from arcweave.plans import registry
from arcweave.plans.dialect import DUCK


def write(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_binom_tail_keeps_large_strata(spark, tmp_path):
    n = {"en": 5000, "fr": 30}
    docs = [(i, "x", "en" if i < 5000 else "fr", "s", 7) for i in range(5030)]
    labels = [(i, int(i % 5 != 0 or i % 45 == 0), 0) for i in range(5030)]
    at = write(spark, tmp_path, documents=(docs, "doc_id long, text string, lang string, source string, n_chars long"), labels=(labels, "doc_id long, quality int, toxic int"))
    got = {r.stratum: r for r in registry.queries()["binom_tail"](spark, at).collect()}
    assert set(got) == set(n)
    for lang, total in n.items():
        k = sum(q for (i, q, _), d in zip(labels, docs) if d[2] == lang)
        p = [math.exp(math.lgamma(total + 1) - math.lgamma(i + 1) - math.lgamma(total - i + 1) + i * math.log(0.8) + (total - i) * math.log(0.2)) for i in range(total + 1)]
        assert (got[lang].n, got[lang].k) == (total, k)
        assert got[lang].upper_ == pytest.approx(sum(p[k:]), abs=2e-6)
        assert got[lang].two_sided == pytest.approx(sum(x for x in p if x <= p[k] * (1 + 1e-7)), abs=2e-6)


DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


ALL = "SELECT count(*) FROM embeddings"
LINKS = f"WITH {concepts(DUCK)}, {relations(DUCK)} SELECT count(DISTINCT (c1, c2)) FROM relations WHERE c1 <> c2"
EDGES = "SELECT count(*) FROM (SELECT DISTINCT l_suppkey % 7, least(l_partkey % 101, l_orderkey % 101), greatest(l_partkey % 101, l_orderkey % 101){} FROM lineitem WHERE l_partkey % 101 <> l_orderkey % 101)"


@pytest.mark.parametrize(
    "name,of,want",
    [
        ("coin_cast", len, ALL),
        ("state_round_trip", len, ALL),
        ("self_claim_verdicts", len, "SELECT count(*) FROM events"),
        ("response_checks", len, "SELECT count(*) FROM events"),
        ("trial_plan", len, "SELECT 4 * count(*) * (SELECT count(DISTINCT s_suppkey % 3) FROM supplier) FROM part"),
        ("full_check", lambda rows: sum(r.claim_id.startswith("vector:") for r in rows), LINKS),
        ("tercile_codes", len, ALL),
        ("nudged_candidates", len, ALL),
        ("fold_compose", len, "SELECT count(*) - 4 FROM embeddings"),
        ("mantel", lambda rows: rows[0].pairs, "SELECT count(*) * (count(*) - 1) // 2 FROM embeddings"),
        ("link_ranks", lambda rows: sum(r.n for r in rows), LINKS),
        ("stratified_perm_hash", lambda rows: rows[0].observed, "SELECT round(avg((n_chars % 1000) / 1000e0) FILTER (quality = 1) - avg((n_chars % 1000) / 1000e0) FILTER (quality = 0), 6) FROM labels JOIN documents USING (doc_id)"),
        ("union_degree", lambda rows: sum(r.edges for r in rows), EDGES.format(", l_returnflag")),
        ("rater_agreement_t", lambda rows: sum(r.k * r.pairs for r in rows), EDGES.format("")),
        ("label_consensus", len, EDGES.format(", l_returnflag").replace("SELECT count(*) FROM (SELECT DISTINCT", "SELECT count(*) FROM (SELECT 1 FROM (SELECT DISTINCT") + " v(f, a, b, kind) GROUP BY a, b HAVING count(*) >= 2)"),
        ("isolates", lambda rows: sum(r.degree or 0 for r in rows), EDGES.format(", l_returnflag").replace("count(*)", "2 * count(*)")),
    ],
)
def test_no_row_is_left_out(spark, duck, name, of, want):
    assert of(registry.queries()[name](spark, DIR).collect()) == duck.execute(want).fetchall()[0][0]


def vectors(spark, folder, rows):
    return write(spark, folder, embeddings=([(i, [float(a) for a in v], i % 9) for i, v in enumerate(rows)], "vec_id long, embedding array<float>, label int"))


def test_relabel_null_reads_all_rows(spark, tmp_path):
    at = vectors(spark, tmp_path, np.random.default_rng(5).normal(size=(4700, 64)))
    got = registry.queries()["relabel_null"](spark, at).collect()[0]
    c = G.concepts(spark.read.parquet(f"{at}/embeddings.parquet")).orderBy("id").toPandas()
    x, y = np.c_[np.ones(len(c)), c[list(G.ESSENCE)].to_numpy()], c[list(G.FUNCTION)].to_numpy()
    half = np.linalg.solve(x.T @ x + 0.1 * np.eye(8), x.T)
    free = 1 - np.einsum("ij,ji->i", x, half)
    press = [float((((m - x @ (half @ m)) / free[:, None]) ** 2).sum()) for m in (np.roll(y, s, axis=0) for s in range(60))]
    assert got.observed == pytest.approx(press[0], abs=1e-3) and got.null_mean == pytest.approx(np.mean(press[1:]), abs=1e-3)


def test_every_core_is_solved(spark):
    rows = registry.queries()["constrained_cores"](spark, DIR).collect()
    assert sorted(r.id for r in rows) == list(range(500))


def test_batches_against_one_by_one(spark):
    """Batches that fit, fit in part and do not fit, against the old rows and then row by row."""
    from arcweave.operators import models, search

    rng = np.random.default_rng(6)
    old = rng.normal(size=(60, 4))
    new = rng.normal(size=(90, 4))
    new[::9] = new[1::9] + 0.01
    ids = [int(i) for i in range(90)]
    table = spark.createDataFrame([(i // 15, 1000 + i, new[i].tolist()) for i in ids], "batch long, id long, vector array<double>").repartition(3)
    index = search.AngularIndex.build(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(old)], "id long, vector array<double>"))
    got = {r.id - 1000: r.state for r in models.insert_batches(index, table, 9.0).collect()}
    far = search._angles(new, old).min(axis=1)
    want = {}
    for b in range(6):
        own, kept = ids[15 * b : 15 * b + 15], []
        for i in own:
            if (far[own] < 9.0).any():
                want[i] = "rejected"
                continue
            near = bool(kept) and search._angles(new[[i]], new[kept]).min() < 9.0
            want[i] = "near" if near else "added"
            if not near:
                kept.append(i)
    assert got == want and set(want.values()) == {"rejected", "near", "added"}
    added = [1000 + i for i, s in want.items() if s == "added"]
    assert sum(c.rows for c in index.cells.values()) == 60 + len(added)
    back = index.nearest(table, 1, exclude_self=False).where(f"id = query_id AND id IN ({', '.join(map(str, added))})")
    assert back.count() == len(added)


def test_batches_of_the_tables(spark):
    rows = registry.queries()["batch_insert"](spark, DIR).collect()
    assert len(rows) == 26 and all(r.found for r in rows if r.state == "added")
    assert {r.state for r in rows} >= {"added", "near"}


@pytest.mark.parametrize("ids", [[-30, 2, 5, 6, 40, 1000, 123456789012, 7, 19], [4], []])
def test_contraction_takes_all_pairs(spark, tmp_path, ids):
    """every two replicates are a pair, not only those one or seven numbers apart; the draws are those of the twin."""
    rows = [(c, t, "user", "x" * ((c * 7 + t * t * 5 + 3 * (c % 4)) % 23)) for c in ids for t in range(2 if c == 7 else 5)] + [(None, 0, "user", "x")]
    at = write(spark, tmp_path, conversations=(rows, "conv_id long, turn long, role string, text string"))
    got = registry.queries()["contraction"](spark, at).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{at}/conversations.parquet/*.parquet'")
    want = con.execute(registry.oracles()["contraction"]).fetchall()
    assert [tuple(r) for r in got] == [pytest.approx(w, nan_ok=True) for w in want]
    assert (got[0].pairs or 0) == len(ids) * (len(ids) - 1) // 2

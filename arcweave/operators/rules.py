"""Rule pipelines over texts and sequences: word gaps, firewall, diagnosis, casting, plans and pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import CORE, DOMAIN, angle, concepts, cosine, r, relations, undirected
from ..plans.dialect import query
from . import ordered, pairs

QUERIES: list = []
Q = lambda ids, **views: query(QUERIES, ids, **views)

#: Common words of the corpora, left out of content words.
STOP = ("the", "and", "that", "with", "this", "from", "die", "der", "das", "les", "des", "que", "los", "las", "una", "por")
_STOP = ", ".join(f"'{w}'" for w in STOP)


def graph(d):
    return f"{concepts(d)}, {relations(d)}, {undirected(d)}"


def words(d):
    return f"words AS (SELECT doc_id, {d.explode(d.rall('lower(text)', '[a-z]+'))} AS w FROM documents), content AS (SELECT doc_id, w FROM words WHERE length(w) > 2 AND w NOT IN ({_STOP}))"


@Q("TXT-01 SET-01 SET-02 TOP-07 VAL-06")
def content_word_gap(d):
    """Words of texts that the vocabulary (words of the benchmark) lacks, with one document each."""
    return f"""WITH {words(d)}, vocab AS (SELECT DISTINCT w FROM (SELECT {d.explode(d.rall('lower(text)', '[a-z]+'))} AS w FROM benchmark) t),
    m AS (SELECT w, count(*) AS n, min(doc_id) AS example FROM content WHERE w NOT IN (SELECT w FROM vocab) GROUP BY w)
    SELECT w, n, example FROM (SELECT *, row_number() OVER (ORDER BY n DESC, w) AS place FROM m) t WHERE place <= 50"""


@Q("VAL-06 SET-02")
def self_containment(d):
    return f"""WITH {words(d)}, vocab AS (SELECT DISTINCT w FROM (SELECT {d.explode(d.rall('lower(text)', '[a-z]+'))} AS w FROM benchmark) t),
    t AS (SELECT w, count(*) AS n FROM content GROUP BY w), k AS (SELECT t.*, v.w IS NOT NULL AS known FROM t LEFT JOIN vocab v ON v.w = t.w)
    SELECT count(*) AS types, CAST(sum(n) AS BIGINT) AS tokens, {r('avg(CASE WHEN known THEN 1e0 ELSE 0e0 END)')} AS type_share,
    {r('sum(CASE WHEN known THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE)')} AS token_share FROM k"""


@Q("TXT-06 JOIN-17")
def shingle_firewall(d):
    """Documents that share runs of eight words with a benchmark item, equal it or contain it; runs meet by hash first, and only hits are spelled out."""
    def tokens(table, key):
        text = f'trim({d.rr("lower(text)", "[^a-z0-9]+", " ")})'
        return f"{table}_w AS (SELECT {key} AS k, {text} AS t, {d.split(text, ' ')} AS w FROM {table})"
    run, at = d.concat(d.slice("w", "i", "8"), " "), d.seq(1, f"{d.size('w')} - 7")
    if d.name == "spark":
        hashed = lambda t: f"{t}_h AS (SELECT k, h.pos + 1 AS i, h.col AS h FROM {t}_w LATERAL VIEW posexplode(CASE WHEN size(w) >= 8 THEN transform(sequence(1, size(w) - 7), i -> xxhash64(slice(w, i, 8))) END) h AS pos, col)"
        grams = f"""{hashed('benchmark')}, {hashed('documents')}, hits AS (SELECT k, i FROM documents_h LEFT SEMI JOIN benchmark_h ON benchmark_h.h = documents_h.h),
        documents_g AS (SELECT DISTINCT w.k, {run} AS s FROM hits JOIN documents_w w ON w.k = hits.k), benchmark_g AS (SELECT DISTINCT w.k, {run} AS s FROM benchmark_h b JOIN benchmark_w w ON w.k = b.k)"""
    else:
        grams = ", ".join(f"{t}_g AS (SELECT DISTINCT k, {run} AS s FROM (SELECT k, w, {d.explode(at)} AS i FROM {t}_w WHERE {d.size('w')} >= 8) z)" for t in ("documents", "benchmark"))
    return f"""WITH {tokens('documents', 'doc_id')}, {tokens('benchmark', 'item_id')}, {grams}, m AS (SELECT a.k AS doc_id, b.k AS item_id, count(*) AS shared FROM documents_g a JOIN benchmark_g b ON a.s = b.s GROUP BY a.k, b.k)
    SELECT m.doc_id, m.item_id, shared, x.t = y.t AS equal_, position(y.t IN x.t) > 0 AS contains_ FROM m JOIN documents_w x ON x.k = doc_id JOIN benchmark_w y ON y.k = item_id"""


#: Lines of each class, bottom first, as bits; the number of a pair (lower, upper) in our tables is 8 * lower + upper + 1.
LINES = {"QIAN": 7, "DUI": 3, "LI": 5, "ZHEN": 1, "XUN": 6, "KAN": 2, "GEN": 4, "KUN": 0}


def first_complements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, id): the best complement of each concept, and others."""
    from .dictionary import complement_rows

    return pairs.complements(complement_rows(spark, sf_dir), 1, False)


@Q("ORC-01 ORC-02 JSN-01", first_complements=first_complements)
def diagnosis(d):
    """Every concept as a question: its class, best complement, hexagram code, profile and witness, as JSON."""
    code = lambda x: "CASE " + x + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LINES.items()) + " END"
    met = "first_complements m JOIN q ON q.id = m.query_id JOIN concepts c ON c.id = m.id" if d.name == "spark" else "q CROSS JOIN concepts c"
    return f"""WITH {concepts(d)}, q AS (SELECT * FROM concepts),
    p AS (SELECT q.id AS k, q.trigram AS lower_, c.id, c.trigram AS upper_, {angle('q.', 'c.', CORE, '90e0')} AS t, {cosine('q.', 'c.', DOMAIN)} AS sim, greatest(0.3e0, least(1e0, c.level / 7e0)) AS wt FROM {met}),
    s AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(sim * 0.5e0 + wt * 0.3e0 - abs(t - 90e0) / 90e0 * 0.2e0, 9) DESC, id) AS place FROM p WHERE abs(t - 90e0) < 30e0)
    SELECT k, lower_, id AS complement, upper_, CAST(8 * {code('lower_')} + {code('upper_')} + 1 AS BIGINT) AS hexagram, {r('1e0 - cos(radians(t))')} AS witness,
    concat('{{"k":', CAST(k AS STRING), ',"class":"', lower_, '","complement":', CAST(id AS STRING), '}}') AS json FROM s WHERE place = 1"""


@Q("ORC-04 ORC-05 HSH-02")
def coin_cast(d):
    """Three hash-drawn coins for six lines: 6 to 9 each; changing lines and both codes."""
    coin = lambda c: f"({d.hash(f"""concat('cast|', CAST(k AS STRING), '|', CAST(ln AS STRING), '|{c}')""")} % 2 + 2)"
    return f"""WITH a AS (SELECT vec_id AS k FROM embeddings), b AS (SELECT k, ln FROM a CROSS JOIN (SELECT {d.explode(d.seq(0, 5))} AS ln) z),
    v AS (SELECT k, ln, {coin(0)} + {coin(1)} + {coin(2)} AS v FROM b)
    SELECT k, CAST(sum(v) AS BIGINT) AS total, CAST(sum(CASE WHEN v IN (6, 9) THEN 1 ELSE 0 END) AS BIGINT) AS changing,
    CAST(sum((v % 2) * CAST(power(2, ln) AS BIGINT)) AS BIGINT) AS code, CAST(sum(CASE WHEN v IN (7, 6) THEN CAST(power(2, ln) AS BIGINT) ELSE 0 END) AS BIGINT) AS resolved FROM v GROUP BY k"""


def with_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, sym, prev): the corpus with the symbol before, over ranges of its order."""
    s = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("user_id") % 64 + 1).alias("sym"))
    return ordered.previous(s, ["event_id"], prev="sym")


@Q("ORC-07 ORC-08 WIN-01 WIN-02 TOP-11", with_previous=with_previous)
def sequence_corpus(d):
    """A corpus of symbols: frequency, repeats, transitions with the next, and members never seen."""
    w = "w AS (SELECT * FROM with_previous)" if d.name == "spark" else "s AS (SELECT event_id, user_id % 64 + 1 AS sym FROM events), w AS (SELECT *, lag(sym) OVER (ORDER BY event_id) AS prev FROM s)"
    return f"""WITH {w},
    u AS (SELECT {d.explode(d.seq(1, 80))} AS sym), f AS (SELECT sym, count(*) AS n, CAST(sum(CASE WHEN prev = sym THEN 1 ELSE 0 END) AS BIGINT) AS repeats FROM w GROUP BY sym),
    t AS (SELECT prev, sym, count(*) AS n FROM w WHERE prev IS NOT NULL GROUP BY prev, sym), top AS (SELECT prev, sym AS nxt, n, row_number() OVER (PARTITION BY prev ORDER BY n DESC, sym) AS place FROM t)
    SELECT u.sym, coalesce(f.n, 0) AS n, coalesce(repeats, 0) AS repeats, f.sym IS NULL AS absent, CAST((u.sym - 1) % 8 AS BIGINT) AS lower_, CAST(floor((u.sym - 1) / 8) AS BIGINT) AS upper_, nxt, top.n AS next_n
    FROM u LEFT JOIN f ON f.sym = u.sym LEFT JOIN top ON top.prev = u.sym AND place = 1"""


@Q("TXT-10 PRJ-12")
def pos_heuristics(d):
    return f"""WITH {words(d)}, v AS (SELECT DISTINCT w FROM content)
    SELECT w, CASE WHEN {d.rx('w', 'ly$')} THEN 'adverb' WHEN {d.rx('w', '(ed|en)$')} THEN 'verb' WHEN {d.rx('w', '(able|ble|ous)$')} THEN 'adjective' WHEN {d.rx('w', '(tion|ness|ing)$')} THEN 'noun' ELSE '' END AS pos,
    {d.hash('w')} % 9 AS level FROM v WHERE {d.rx('w', '^th')}"""


@Q("CUR-16 SET-04")
def pool_build(d):
    """One entry per (axis, pole) with merged members, banned names left out, keys missing or extra against a table."""
    return f"""WITH {concepts(d)}, s AS (SELECT id, name, CASE WHEN x > 0e0 THEN 'high' ELSE 'low' END AS pole, trigram AS axis FROM concepts WHERE NOT {d.rx('name', '7$')}),
    k AS (SELECT axis, pole, count(*) AS members, min(name) AS head, {d.hash("concat(axis, '|', pole)")} AS seed FROM s GROUP BY axis, pole), w AS (SELECT * FROM (VALUES ('QIAN', 'high'), ('QIAN', 'low'), ('VOID', 'high')) AS v(axis, pole))
    SELECT coalesce(k.axis, w.axis) AS axis, coalesce(k.pole, w.pole) AS pole, members, head, seed, CASE WHEN k.axis IS NULL THEN 'missing' WHEN w.axis IS NULL THEN 'extra' ELSE 'both' END AS state
    FROM k FULL OUTER JOIN w ON w.axis = k.axis AND w.pole = k.pole"""

"""The registered queries of this subpackage: thin digests of its operators over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, html, jaccard, langid, leaks, lines, media, packing, pieces, repair, sessions, substrings, topk, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = common.crc_mod(F.col("doc_id"), 4) == 2
    return langid.language_query(_table(spark, sf_dir, "documents"), ~held_out, held_out)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_query(_table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_words(_table(spark, sf_dir, "documents"))


def op10_topk_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.topk_search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.sessions(_table(spark, sf_dir, "clicks"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damaged(_table(spark, sf_dir, "conversations")))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_line_dedup": op3_line_dedup,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_mpeg_audio": op6_mpeg_audio,
    "op7_toxicity": op7_toxicity,
    "op8_html_extraction": op8_html_extraction,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_topk_maxscore": op10_topk_maxscore,
    "op11_gap_sessions": op11_gap_sessions,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_decontamination": op13_decontamination,
}

#: Lower-cased words of a document; the class is what the contract names.
_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"""

#: Words of letters, digits and what lies beyond ASCII, A-Z lower-cased.
_PLAIN = _WORDS.replace("[^\\x20\\x09-\\x0D]+", "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")

ORACLES = {
    "op2_jaccard_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                     ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        f AS (SELECT g, list(doc_id) AS d FROM s GROUP BY g HAVING count(*) > 1),
        p AS (SELECT a, b, count(*) AS i FROM (SELECT unnest(d) AS a, d FROM f) t, unnest(t.d) AS u(b) WHERE a < b GROUP BY a, b),
        e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
        l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS component_id
        FROM documents d LEFT JOIN n USING (doc_id)""",
    "op9_substring_dedup": """
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        v AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM d WHERE len(w) >= 20),
        h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS g FROM v),
        l AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM h) t WHERE r > 1),
        c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM l),
        g AS (SELECT doc_id, list(p) AS p FROM c GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(g.p), 0) AS BIGINT) AS n_removed,
               sha256(CASE WHEN g.p IS NULL THEN array_to_string(w, ' ')
                      ELSE coalesce((SELECT string_agg(x.word, ' ' ORDER BY x.k) FROM (SELECT unnest(d.w) AS word, unnest(range(1, len(d.w) + 1)) AS k) x
                            WHERE NOT list_contains(g.p, x.k)), '') END) AS kept_sha256
        FROM d LEFT JOIN g USING (doc_id)""",
    "op10_topk_maxscore": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                     CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
              FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op11_gap_sessions": """
        WITH RECURSIVE k AS (SELECT click_id, epoch_us(ts) AS us, client_id, coalesce(epoch_us(arrived_at) - epoch_us(ts) > 900000000, false) AS late,
                    coalesce(value >= 60 AND kind IN ('purchase', 'signup'), false) AS final, CASE WHEN isfinite(value) THEN CAST(floor(100 * value + 0.5) AS BIGINT) ELSE 0 END AS cents
             FROM clicks WHERE click_id IS NOT NULL AND ts IS NOT NULL AND client_id IS NOT NULL),
        d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY click_id ORDER BY us, client_id, late, final, cents) AS one FROM k) t WHERE one = 1),
        c AS (SELECT *, row_number() OVER w AS pos, CASE WHEN lag(final) OVER w THEN 'end' WHEN us - lag(us) OVER w < 900000000 THEN NULL ELSE 'gap' END AS why
              FROM d WHERE NOT late WINDOW w AS (PARTITION BY client_id ORDER BY us, click_id)),
        t AS (SELECT client_id, us, min(pos) AS pos FROM c GROUP BY client_id, us),
        b AS (SELECT *, min(CASE WHEN why IS NOT NULL THEN pos END) OVER (PARTITION BY client_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS hard FROM c),
        n AS (SELECT b.*, least(hard, t.pos) AS nxt FROM b ASOF LEFT JOIN t ON t.client_id = b.client_id AND b.us + 3600000000 < t.us),
        s AS (SELECT client_id, pos, nxt FROM n WHERE why IS NOT NULL
              UNION ALL SELECT n.client_id, n.pos, n.nxt FROM s JOIN n ON n.client_id = s.client_id AND n.pos = s.nxt WHERE n.why IS NULL),
        m AS (SELECT c.client_id, s.pos AS spos, s.nxt, min(us) AS start_us, max(us) AS end_us, count(*) AS n_clicks, CAST(sum(cents) AS BIGINT) AS value_cents,
                     first(click_id ORDER BY c.pos) AS session_id, last(final ORDER BY c.pos) AS final, sha256(string_agg(CAST(click_id AS VARCHAR), ',' ORDER BY c.pos)) AS path_sha256
              FROM c ASOF JOIN s ON s.client_id = c.client_id AND c.pos >= s.pos GROUP BY c.client_id, s.pos, s.nxt),
        o AS (SELECT client_id, start_us, max(spos) AS spos FROM m GROUP BY client_id, start_us),
        l AS (SELECT o.client_id, o.spos, count(*) AS n FROM (SELECT * FROM d WHERE late) d ASOF JOIN o ON o.client_id = d.client_id AND d.us >= o.start_us GROUP BY o.client_id, o.spos)
        SELECT m.client_id, m.session_id, start_us, end_us, n_clicks, coalesce(l.n, 0) AS n_late, value_cents,
               CASE WHEN m.final THEN 'end' WHEN x.pos IS NULL THEN 'none' ELSE coalesce(x.why, 'length') END AS closed_by, path_sha256
        FROM m LEFT JOIN l ON l.client_id = m.client_id AND l.spos = m.spos LEFT JOIN c x ON x.client_id = m.client_id AND x.pos = m.nxt""",
    "op13_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_PLAIN} AS w FROM documents),
        b AS (SELECT item_id, {_PLAIN} AS w FROM benchmark),
        i AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 10 THEN [w] ELSE list_transform(range(1, len(w) - 8), lambda i: w[i:i + 9]) END) AS win FROM b),
        v AS (SELECT item_id, len(win) AS k, array_to_string(win, ' ') AS g FROM i),
        p AS (SELECT rid, k, unnest(range(1, len(w) - k + 2)) AS s, w FROM d, (SELECT DISTINCT k FROM v) z WHERE len(w) >= k),
        h AS (SELECT rid, p.k, s, item_id FROM p JOIN v ON v.k = p.k AND v.g = array_to_string(p.w[s:s + p.k - 1], ' ')),
        n AS (SELECT rid, count(DISTINCT x) AS n_hit FROM (SELECT rid, unnest(range(s, s + k)) AS x FROM h) t GROUP BY rid),
        o AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item_id FROM h WHERE item_id IS NOT NULL) t GROUP BY rid)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN n USING (rid) LEFT JOIN o USING (rid)""",
}

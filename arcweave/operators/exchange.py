"""Sources and sinks as queries: a table is written in a format and read back by the reader of that format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..model import ESSENCE, FUNCTION, LEVELS, aliases, concepts, r
from ..plans.dialect import DUCK
from ..sources import tables as S
from ..sources.workspace import new_path

BASE = f"WITH {concepts(DUCK)}, {aliases(DUCK)}, al AS (SELECT concept_id AS id, list(alias ORDER BY alias) AS aliases FROM aliases GROUP BY concept_id)"
COLS = ", ".join(f"{r(k)} AS {k}" for k in ESSENCE + FUNCTION)


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = G.concepts(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return c, c.where("id % 3 = 0").select(F.concat(F.lit("A"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("alias"), F.col("id").alias("concept_id"))


def _round(*cols: str):
    return [(F.round(c, 6) + F.lit(0.0)).alias(c.split(".")[-1]) for c in cols]


def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full export: nested core, domain and function groups, and aliases as an array; and the compact one's vectors beside it."""
    c, a = _tables(spark, sf_dir)
    full, compact = new_path(spark, "full"), new_path(spark, "compact")
    S.write_json(c, a, full)
    S.write_json(c, a, compact, compact=True)
    group = lambda cols: "struct<" + ",".join(f"{k}:double" for k in cols) + ">"
    back = spark.read.schema(f"name string, level long, trigram string, core {group(ESSENCE[:3])}, domain {group(ESSENCE[3:])}, function {group(FUNCTION)}, aliases array<string>").json(full)
    # names of six digits are cut to five and not unique: a concept meets its own vector, and equal rows of the compact file are one
    small = spark.read.schema("name string, trigram string, v array<double>").json(compact).distinct().select(F.col("name").alias("n"), F.col("trigram").alias("c"), "v", F.size("v").cast("long").alias("compact_size"))
    own = F.array(*[f"core.{k}" for k in ESSENCE[:3]], *[f"domain.{k}" for k in ESSENCE[3:]])
    return back.join(small, F.col("name").eqNullSafe(F.col("n")) & F.col("trigram").eqNullSafe(F.col("c")) & own.eqNullSafe(F.col("v"))).select("name", "level", "trigram", *_round(*[f"core.{k}" for k in ESSENCE[:3]], *[f"domain.{k}" for k in ESSENCE[3:]], *[f"function.{k}" for k in FUNCTION]), F.array_join("aliases", ",").alias("aliases"), "compact_size")


EXPORT_JSON = f"{BASE} SELECT name, level, trigram, {COLS}, coalesce(array_to_string(aliases, ','), '') AS aliases, CAST(7 AS BIGINT) AS compact_size FROM concepts LEFT JOIN al ON al.id = concepts.id"


def export_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, levels and the vectors as arrays: sizes and ends of each."""
    path = new_path(spark, "arrays")
    S.write_arrays(_tables(spark, sf_dir)[0], path)
    t = spark.read.parquet(path)
    return t.select("name", "level", F.size("essence").cast("long").alias("n_essence"), F.size("func").cast("long").alias("n_function"), F.size("full").cast("long").alias("n_full"), *[(F.round(F.element_at("full", i), 6) + F.lit(0.0)).alias(f"v{i}") for i in (1, 7, 8, 14)])


EXPORT_ARRAYS = f"{BASE} SELECT name, level, CAST(7 AS BIGINT) AS n_essence, CAST(7 AS BIGINT) AS n_function, CAST(14 AS BIGINT) AS n_full, {r('x')} AS v1, {r('h')} AS v7, {r('fx')} AS v8, {r('fh')} AS v14 FROM concepts"


def export_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as sorted text: each line and whether it follows the one before it in its file."""
    path = new_path(spark, "names")
    S.write_names(_tables(spark, sf_dir)[0], path)
    return spark.read.text(path).select(F.col("value").alias("name"), F.length("value").cast("long").alias("chars"))


EXPORT_NAMES = f"{BASE} SELECT name, CAST(length(name) AS BIGINT) AS chars FROM concepts"


def export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns as CSV with a header, read by an explicit schema."""
    c = _tables(spark, sf_dir)[0]
    path = new_path(spark, "csv")
    S.write_csv(c, path)
    return spark.read.schema(c.schema).option("header", True).csv(path).select("id", "name", "level", "trigram", *_round(*ESSENCE, *FUNCTION))


EXPORT_CSV = f"{BASE} SELECT id, name, level, trigram, {COLS} FROM concepts"


def export_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dedup manifest: names, and aliases where there are any."""
    c, a = _tables(spark, sf_dir)
    path = new_path(spark, "manifest")
    S.write_dedup_manifest(c, a, path)
    return spark.read.schema("name string, aliases array<string>").json(path).select("name", F.array_join("aliases", ",").alias("aliases"))


EXPORT_MANIFEST = f"{BASE} SELECT name, array_to_string(aliases, ',') AS aliases FROM concepts LEFT JOIN al ON al.id = concepts.id"


def shipped_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors shipped in parts of bounded size and loaded against their manifest: nothing is lost and no part is too large."""
    path = new_path(spark, "parts")
    c = _tables(spark, sf_dir)[0]
    S.ship(c.select(F.col("id").alias("key"), F.array(*G.ESSENCE).alias("v")), path, 200)
    t = S.read_parts(spark, path)
    most = t.groupBy("part").count().agg(F.max("count")).first()[0] or 0  # one number
    return t.select(F.col("key").alias("id"), *[(F.round(F.element_at("v", i + 1), 6) + F.lit(0.0)).alias(k) for i, k in enumerate(ESSENCE)], F.lit(most <= 400).alias("bounded"))


SHIPPED_PARTS = f"{BASE} SELECT id, {', '.join(f'{r(k)} AS {k}' for k in ESSENCE)}, true AS bounded FROM concepts"


def session_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions dumped as JSON, one file each, and the last ten read back by their start."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("session", F.concat(F.lit("s"), F.lpad((F.col("event_id") % 12).cast("string"), 2, "0")))
    q = F.transform(F.array_sort(F.collect_list(F.struct(F.col("event_id").cast("int").alias("n"), "event_type"))), lambda s: F.struct(s["n"].alias("n"), s["event_type"].alias("timestamp")))
    dump = e.groupBy("session").agg(q.alias("queries"), F.count("*").cast("int").alias("count")).withColumn("started", F.concat(F.lit("2024-01-"), F.substring("session", 2, 2)))
    path = new_path(spark, "sessions")
    dump.select("*", F.col("started").alias("ended"), F.col("session").alias("of")).write.partitionBy("of").json(path)
    return S.read_sessions(spark, f"{path}/*").select("session", "started", F.col("count").cast("long").alias("n"), F.element_at("queries", 1)["n"].cast("long").alias("first_"), F.element_at("queries", -1)["timestamp"].alias("last_kind"))


SESSION_HISTORY = """WITH s AS (SELECT concat('s', lpad(CAST(event_id % 12 AS VARCHAR), 2, '0')) AS session, event_id, event_type FROM events)
    SELECT session, concat('2024-01-', session[2:3]) AS started, count(*) AS n, min(event_id) AS first_, max_by(event_type, event_id) AS last_kind FROM s GROUP BY session ORDER BY started DESC, session LIMIT 10"""


def batch_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concept batches as JSON arrays, a file each: levels as numbers or names, components that are left out, aliases."""
    c, _ = _tables(spark, sf_dir)
    level = F.when(F.col("id") % 2 == 0, F.col("level").cast("string")).otherwise(F.element_at(F.array(*map(F.lit, LEVELS)), F.col("level").cast("int") + 1))
    one = F.struct(F.lower("name").alias("name"), *[F.col(k) for k in ESSENCE], F.when(F.col("id") % 3 == 0, F.col("fx")).alias("fx"), level.alias("level"), F.when(F.col("id") % 5 == 0, F.array(F.concat(F.lit("b"), "name"))).alias("aliases"))
    path = new_path(spark, "batches")
    c.groupBy((F.col("id") % 4).alias("batch")).agg(F.to_json(F.collect_list(one)).alias("value")).write.partitionBy("batch").text(path)
    t = S.read_batch(spark, f"{path}/*")
    return t.select("name", F.col("level").cast("long").alias("level"), "trigram", *_round(*ESSENCE, "fx", "fh"), F.array_join("aliases", ",").alias("aliases"))


BATCH_SOURCE = f"{BASE} SELECT name, level, trigram, {', '.join(f'{r(k)} AS {k}' for k in ESSENCE)}, {r('CASE WHEN id % 3 = 0 THEN fx ELSE 0e0 END')} AS fx, 0e0 AS fh, CASE WHEN id % 5 = 0 THEN concat('b', name) ELSE '' END AS aliases FROM concepts"


def limited_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of JSON lines, part of it gzipped, read with a limit on its records: as many as asked for, each from the log."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rec = e.select(F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("call_id"), F.lit("").alias("body_sha"), F.when(F.col("event_type") == "error", "retry").otherwise("ok").alias("status"), F.lit(0).alias("attempt"), F.col("event_id").cast("double").alias("t"), F.col("value").alias("latency_s"), F.lit(None).cast("string").alias("response"))
    path = new_path(spark, "log")
    S.append_records(rec.where("t % 2 = 0"), path)
    S.append_records(rec.where("t % 2 = 1"), path, compress=True)
    whole, some = S.read_run_log(spark, path), S.read_jsonl(spark, path, S.RUN_RECORDS, 100)
    n = some.join(rec.select("t").distinct(), "t", "left_semi").agg(F.count("*").alias("limited"))
    return whole.agg(F.count("*").alias("records"), F.count_if(F.col("status") == "ok").alias("ok"), F.sum(F.col("t").cast("long")).alias("sum_t")).crossJoin(F.broadcast(n))  # one row each


LIMITED_RECORDS = "SELECT count(*) AS records, count_if(event_type <> 'error') AS ok, CAST(sum(event_id) AS BIGINT) AS sum_t, least(100, count(*)) AS limited FROM events"


def code_whitelists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code tables as lines of a script: a constant with the allowed values of each, as JSON."""
    c = _tables(spark, sf_dir)[0]
    u = c.select(F.lit("TRIGRAMS").alias("k"), F.col("trigram").alias("v")).union(c.select(F.lit("LEVELS"), F.element_at(F.array(*map(F.lit, LEVELS)), F.col("level").cast("int") + 1))).union(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.lit("EVENTS"), "event_type")).distinct()
    lines = u.groupBy("k").agg(F.concat(F.lit("const "), F.first("k"), F.lit(" = "), F.to_json(F.array_sort(F.collect_set("v"))), F.lit(";")).alias("value"))
    path = new_path(spark, "whitelist")
    lines.select("value").write.text(path)
    return spark.read.text(path).select(F.col("value").alias("line"))


CODE_WHITELISTS = f"""{BASE}, u AS (SELECT DISTINCT 'TRIGRAMS' AS k, trigram AS v FROM concepts UNION SELECT 'LEVELS', ([{', '.join(repr(x) for x in LEVELS)}])[level + 1] FROM concepts UNION SELECT 'EVENTS', event_type FROM events)
    SELECT concat('const ', k, ' = ["', string_agg(v, '","' ORDER BY v), '"];') AS line FROM u GROUP BY k"""


QUERIES = {
    "export_json": ("SNK-01", export_json, EXPORT_JSON),
    "export_arrays": ("SNK-02", export_arrays, EXPORT_ARRAYS),
    "export_names": ("SNK-03", export_names, EXPORT_NAMES),
    "export_csv": ("SNK-04", export_csv, EXPORT_CSV),
    "export_manifest": ("SNK-05", export_manifest, EXPORT_MANIFEST),
    "shipped_parts": ("SNK-07 SRC-15", shipped_parts, SHIPPED_PARTS),
    "session_history": ("SNK-09 SRC-16", session_history, SESSION_HISTORY),
    "batch_source": ("SRC-06", batch_source, BATCH_SOURCE),
    "limited_records": ("SRC-09 SRC-11 SNK-06", limited_records, LIMITED_RECORDS),
    "code_whitelists": ("SNK-10", code_whitelists, CODE_WHITELISTS),
}

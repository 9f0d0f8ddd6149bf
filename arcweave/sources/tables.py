"""Sources and sinks of the dictionary, each a thin reader or writer with an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import ESSENCE, FUNCTION, trigram
from ..model import LEVELS

_D = T.DoubleType()
CONCEPTS = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("w", _D), *[T.StructField(k, _D) for k in ESSENCE + FUNCTION]]
    + [T.StructField("level", T.IntegerType()), T.StructField("description", T.StringType()), T.StructField("trigram", T.StringType()), T.StructField("pos", T.StringType())]
)
ALIASES = T.StructType([T.StructField("alias", T.StringType()), T.StructField("concept_id", T.LongType())])
RELATIONS = T.StructType([T.StructField("c1", T.LongType()), T.StructField("c2", T.LongType()), T.StructField("rel_type", T.StringType()), T.StructField("angle4", _D), T.StructField("angle8", _D)])
RUN_RECORDS = T.StructType([T.StructField(n, t) for n, t in (("call_id", T.StringType()), ("body_sha", T.StringType()), ("status", T.StringType()), ("attempt", T.IntegerType()), ("t", T.DoubleType()), ("latency_s", T.DoubleType()), ("response", T.StringType()))])
BATCH = T.StructType([T.StructField("name", T.StringType()), *[T.StructField(k, _D) for k in ESSENCE + FUNCTION], T.StructField("level", T.StringType()), T.StructField("pos", T.StringType()), T.StructField("description", T.StringType()), T.StructField("aliases", T.ArrayType(T.StringType()))])


# -- sources --------------------------------------------------------------------------------


def read_batch(spark: SparkSession, path: str) -> DataFrame:
    """Concept batches as JSON arrays; a level may be a number or a name; missing function components are 0 (SRC-06)."""
    raw = spark.read.schema(BATCH).option("multiLine", True).json(path)
    by_name = F.coalesce(*[F.when(F.upper("level") == n.upper(), F.lit(i)) for i, n in enumerate(LEVELS)])
    out = raw.withColumn("level", F.coalesce(F.expr("try_cast(level AS INT)"), by_name, F.lit(0)))
    for k in ESSENCE[3:] + FUNCTION:
        out = out.withColumn(k, F.coalesce(k, F.lit(0.0)))
    return out.withColumn("name", F.upper("name")).withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>"))).withColumn("trigram", trigram())


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """``NAME | description | CLASS`` lines; ``#`` starts a comment; the last two are optional (SRC-07)."""
    t = spark.read.text(path).where("trim(value) <> '' AND NOT startswith(ltrim(value), '#')")
    p = F.split("value", r"\|")
    field = lambda i: F.nullif(F.trim(F.get(p, F.lit(i))), F.lit(""))
    return t.select(F.upper(F.trim(F.get(p, F.lit(0)))).alias("name"), F.coalesce(field(1), F.lit("")).alias("description"), F.coalesce(F.upper(field(2)), F.lit("QIAN")).alias("trigram"))


def read_claims_csv(spark: SparkSession, path: str, category: str | None = None) -> DataFrame:
    """Question and answer claims, several answers to a cell split at ``;`` (SRC-08)."""
    t = spark.read.schema("question string, correct string, incorrect string, category string").option("header", True).csv(path)
    t = t.where(F.col("category") == category) if category else t
    long = t.select("question", "category", F.explode(F.array(F.struct(F.lit(True).alias("label"), F.col("correct").alias("a")), F.struct(F.lit(False).alias("label"), F.col("incorrect").alias("a")))).alias("s"))
    return long.select("question", "category", "s.label", F.explode(F.split("s.a", ";")).alias("answer")).withColumn("answer", F.trim("answer")).where("answer <> ''")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, limit: int | None = None) -> DataFrame:
    """JSON lines, gzip too, with an optional record limit (SRC-09)."""
    t = spark.read.schema(schema).json(path)
    return t.limit(limit) if limit else t


def read_claim_list(spark: SparkSession, path: str) -> DataFrame:
    """One claim a line; blank lines and comments are skipped (SRC-10)."""
    return spark.read.text(path).select(F.trim("value").alias("text")).where("text <> '' AND NOT startswith(text, '#')")


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """Run records of plain and gzip logs (SRC-11)."""
    return read_jsonl(spark, path, RUN_RECORDS)


def read_matrix_csv(spark: SparkSession, path: str, keys: list[str], pinned: str | None = None) -> DataFrame:
    """A survey table with a panel, a row, and one column per key; its sorted rows' sha256 may be pinned (SRC-12)."""
    t = spark.read.option("header", True).csv(path)
    if pinned is not None:
        rows = t.select(F.concat_ws(",", *t.columns).alias("r")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("r")), "\n"), 256)).first()[0]
        if rows != pinned:
            raise ValueError(f"{path} is not the pinned table: {rows}")
    return t.unpivot([c for c in t.columns if c not in keys], keys, "key", "value").withColumn("value", F.col("value").cast("double"))


def read_rater_lines(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """REL / POL / REG rows behind an OUTPUT line are typed; the second value counts lines that fit no grammar (SRC-13)."""
    t = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> '' AND v <> 'OUTPUT'")
    rel = r"^REL\s+(\S+)\s+(\S+)\s+([A-Z]+)(?:\s+([0-9.]+))?$"
    lab = r"^(POL|REG)\s+(\S+)\s+(\S+)$"
    is_rel, is_lab = F.col("v").rlike(rel), F.col("v").rlike(lab)
    g = lambda p, i: F.nullif(F.regexp_extract("v", p, i), F.lit(""))
    out = t.where(is_rel | is_lab).select(F.when(is_rel, F.lit("REL")).otherwise(g(lab, 1)).alias("kind"), F.when(is_rel, g(rel, 1)).otherwise(g(lab, 2)).alias("a"), g(rel, 2).alias("b"), F.when(is_rel, g(rel, 3)).otherwise(g(lab, 3)).alias("label"), g(rel, 4).cast("double").alias("degrees"))
    return out, t.where(~(is_rel | is_lab)).count()


def read_state_list(spark: SparkSession, path: str) -> DataFrame:
    """Two layouts in one text: ``**name** - fields`` inline, or ``1. name`` above its fields (SRC-14)."""
    t = spark.read.text(path, wholetext=True)
    hits = F.regexp_extract_all("value", F.lit(r"(?m)(\*\*[^*]+\*\*[^\n]*|^[0-9]+\. [^\n]+)"), F.lit(1))
    h = t.select(F.posexplode(hits).alias("place", "h"))
    name = F.when(F.col("h").startswith("**"), F.regexp_extract("h", r"\*\*([^*]+)\*\*", 1)).otherwise(F.regexp_extract("h", r"^[0-9]+\. (.+)$", 1))
    return h.select("place", F.trim(name).alias("name"), F.trim(F.regexp_extract("h", r"\*\*[^*]+\*\*\s*-?\s*(.*)$", 1)).alias("fields"))


def read_sessions(spark: SparkSession, path: str, n: int = 10) -> DataFrame:
    """The last ``n`` session files by start (SRC-16)."""
    schema = "session string, started string, ended string, count int, queries array<struct<n:int,timestamp:string>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).orderBy(F.desc("started"), "session").limit(n)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """Shipped parts checked against their manifest: rows and digest of each (SRC-15)."""
    parts, manifest = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/manifest")
    found = _digests(parts)
    bad = manifest.join(found, ["part", "n", "sha"], "left_anti").count()
    if bad:
        raise ValueError(f"{bad} parts of {path} differ from the manifest")
    return parts


# -- sinks ----------------------------------------------------------------------------------


def nested(concepts: DataFrame, aliases: DataFrame, compact: bool = False) -> DataFrame:
    """Concepts with nested core, domain and function groups and their aliases (SNK-01)."""
    a = aliases.groupBy(F.col("concept_id").alias("id")).agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
    out = concepts.join(a, "id", "left")
    if compact:
        return out.select("name", "trigram", F.array(*ESSENCE).alias("v"))
    return out.select("name", "level", "trigram", F.struct(*ESSENCE[:3]).alias("core"), F.struct(*ESSENCE[3:]).alias("domain"), F.struct(*FUNCTION).alias("function"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))


def write_json(concepts: DataFrame, aliases: DataFrame, path: str, compact: bool = False) -> None:
    nested(concepts, aliases, compact).write.mode("overwrite").json(path)


def write_arrays(concepts: DataFrame, path: str) -> None:
    """Names, levels and the vectors as array columns (SNK-02)."""
    concepts.select("name", "level", F.array(*ESSENCE).alias("essence"), F.array(*FUNCTION).alias("func"), F.array(*ESSENCE, *FUNCTION).alias("full")).write.mode("overwrite").parquet(path)


def write_names(concepts: DataFrame, path: str) -> None:
    """Sorted names as text (SNK-03)."""
    concepts.select("name").orderBy("name").write.mode("overwrite").text(path)


def write_csv(concepts: DataFrame, path: str) -> None:
    """All columns by id (SNK-04)."""
    concepts.orderBy("id").write.mode("overwrite").option("header", True).csv(path)


def write_dedup_manifest(concepts: DataFrame, aliases: DataFrame, path: str) -> None:
    """Names with their aliases, where there are any (SNK-05)."""
    nested(concepts, aliases).select("name", F.when(F.size("aliases") > 0, F.col("aliases")).alias("aliases")).write.mode("overwrite").json(path)


def append_records(records: DataFrame, path: str, compress: bool = False) -> None:
    """Append run records as JSON lines; finished logs are gzipped (SNK-06)."""
    records.write.mode("append").option("compression", "gzip" if compress else "none").json(path)


def _digests(parts: DataFrame) -> DataFrame:
    key = F.sha2(F.to_json(F.struct("key", "v")), 256)
    return parts.select("part", key.alias("h")).groupBy("part").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("sha"))


def ship(rows: DataFrame, path: str, part_rows: int = 10_000) -> None:
    """(key, v) rows in parts of bounded size, with a manifest of counts and digests (SNK-07)."""
    n = max(1, -(-rows.count() // part_rows))
    parts = rows.select("key", "v", F.pmod(F.xxhash64("key"), F.lit(n)).cast("int").alias("part"))
    parts.write.mode("overwrite").parquet(f"{path}/rows")
    _digests(rows.sparkSession.read.parquet(f"{path}/rows")).write.mode("overwrite").parquet(f"{path}/manifest")


def append_validation(report: DataFrame, path: str) -> None:
    """One row a run: totals and the issues as a JSON array (SNK-08)."""
    report.agg(F.current_timestamp().alias("run_at"), F.count("*").alias("checked"), F.count_if("valid").alias("ok"), F.to_json(F.collect_list(F.when(~F.col("valid"), F.col("issue")))).alias("issues")).write.mode("append").parquet(path)


def write_session(results: DataFrame, path: str, session: str) -> None:
    """The queries of a session, nested in order, as one JSON object (SNK-09)."""
    q = F.array_sort(F.collect_list(F.struct("n", "timestamp", "result")))
    results.agg(q.alias("queries"), F.count("*").alias("count")).select(F.lit(session).alias("session"), "count", "queries").coalesce(1).write.mode("overwrite").json(path)

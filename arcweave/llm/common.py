"""Shared plumbing of the training-data operators.

Everything a job keeps between two passes is a Parquet table in the folder
that the cluster names in ``spark.checkpoint.dir``: every executor can read it
and it outlives any of them. Only Spark readers and writers touch it.
"""

from __future__ import annotations

import gc

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.workspace import new_path

#: Rows of one Arrow batch. Texts may be long, so batches stay small.
BATCH_ROWS = 500


#: Staged tables of this driver that are still there.
_STAGED: set[str] = set()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    A table that a result still reads stays until :func:`clean`, and at the
    latest until the driver's JVM ends.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    _STAGED.add(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._arcweave_path = path
    return out


def again(table: DataFrame) -> DataFrame:
    """A second reading of a staged table, with columns of its own for self-joins."""
    out = table.sparkSession.read.schema(table.schema).parquet(table._arcweave_path)
    out._arcweave_path = table._arcweave_path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _STAGED.discard(path)


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for t in tables:
        if getattr(t, "_arcweave_path", None):
            _delete(t.sparkSession, t._arcweave_path)


def staged() -> frozenset[str]:
    """The paths of staged tables that are still there."""
    return frozenset(_STAGED)


def clean(spark: SparkSession, but: frozenset[str] = frozenset()) -> None:
    """Delete staged tables other than ``but``, once the results that read them are written."""
    for path in sorted(_STAGED - but):
        _delete(spark, path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished passes now rather than at its next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the memory of an Arrow batch; texts of any length pass through."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def texts(df: DataFrame, id_col: str, text_col: str, null_as_empty: bool = True) -> DataFrame:
    """(``_id`` long, ``_text`` UTF-8 bytes) of ``df``; other columns are not read.

    The names cannot clash with columns of ``df`` as only the two are selected.
    """
    text = F.col(f"`{text_col}`").cast("binary")
    if null_as_empty:
        text = F.coalesce(text, F.lit("").cast("binary"))
    return df.select(F.col(f"`{id_col}`").cast("long").alias("_id"), text.alias("_text"))


def crc_mod(col, m: int):
    """crc32 of the id's decimal text, modulo ``m``."""
    return F.crc32(col.cast("string").cast("binary")) % m


def parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def buckets(docs: DataFrame, most: int = 256 << 20) -> int:
    """Buckets for tables as large as ``docs``: the session's partitions, and more where one would hold over ``most`` bytes.

    The size is the planner's estimate for the scan, which costs no job; it is not known for rows made in memory.
    """
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = 0 if size > 1 << 56 else size
    return max(parts(docs.sparkSession), min(-(-size // most), 1 << 20))


def beside(docs: DataFrame, id_col: str, side: DataFrame, key: str, value: str, change) -> DataFrame:
    """``docs`` with rows changed by ``change(columns, values)``, where ``side`` gives a row's value by id.

    ``columns`` are the Arrow columns of ``docs`` in order and ``values`` a list,
    None where ``side`` has no row or the id is null. Inside, columns go by
    number, so that names of ``docs`` clash with nothing.
    """
    n = len(docs.columns)
    plain = docs.toDF(*[f"c{k}" for k in range(n)])
    at = docs.columns.index(id_col)
    both = plain.join(side.select(F.col(key).alias("s0"), F.col(value).alias("s1")).hint("merge"), F.col(f"c{at}").cast("long") == F.col("s0"), "left")
    names = docs.columns

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(change(list(b.columns[:n]), b.column(n).to_pylist()), names=names)

    return both.select(*[f"c{k}" for k in range(n)], "s1").mapInArrow(run, docs.schema)


def schema(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)

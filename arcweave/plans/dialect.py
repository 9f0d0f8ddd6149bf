"""One query text for two engines.

A query is a function of a dialect that returns SQL. Spark runs it over temp
views of the tables; the same text in DuckDB's spelling is its check. Only what
is spelled differently goes through the dialect.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

RANKS = frozenset(("place", "claim_id", "sym", "rk", "near", "far"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Spark:
    name = "spark"

    def at(self, a, i):
        return f"element_at({a}, {i})"

    def explode(self, a):
        return f"explode({a})"

    def seq(self, a, b):
        return f"sequence({a}, {b})"

    def rx(self, x, p):
        return f"rlike({x}, {self.lit(p)})"

    def rr(self, x, p, r):
        return f"regexp_replace({x}, {self.lit(p)}, {self.lit(r)})"

    def rg(self, x, p, g):
        return f"regexp_extract({x}, {self.lit(p)}, {g})"

    def rall(self, x, p):
        return f"regexp_extract_all({x}, {self.lit(p)}, 0)"

    def lit(self, s):
        return "r'" + s + "'"

    def hash(self, x):
        return f"CAST(conv(substr(md5({x}), 1, 8), 16, 10) AS BIGINT)"

    def join(self, x, sep, order):
        return f"listagg({x}, '{sep}') WITHIN GROUP (ORDER BY {order})"

    def pct(self, x, p):
        return f"percentile({x}, {p})"

    def corr(self, a, b):
        """Correlation; NaN, not an error, where one of the two never changes."""
        return f"coalesce(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0e0), double('NaN'))"

    def size(self, a):
        return f"size({a})"

    def split(self, x, sep):
        return f"split({x}, '{sep}')"

    def json(self, x, k):
        return f"get_json_object({x}, '$.{k}')"

    def micros(self, ts):
        return f"unix_micros(CAST({ts} AS TIMESTAMP))"

    def map(self, a, v, e):
        return f"transform({a}, {v} -> {e})"

    def keep(self, a, v, e):
        return f"filter({a}, {v} -> {e})"

    def arr(self, *xs):
        return f"array({', '.join(xs)})"

    def rec(self):
        return "WITH RECURSIVE"

    def sha(self, x):
        return f"sha2({x}, 256)"

    def concat(self, a, sep):
        return f"array_join({a}, '{sep}')"

    def xor(self, a, b):
        return f"({a} ^ {b})"

    def shr(self, a, b):
        return f"shiftright({a}, {b})"

    def pairs_of(self, *kv):
        return f"named_struct({', '.join(kv)})"

    def left_pad(self, x, n):
        return f"lpad(CAST({x} AS STRING), {n}, '0')"

    def slice(self, a, i, n):
        return f"slice({a}, {i}, {n})"

    def last(self, a):
        return f"try_element_at({a}, -1)"

    def overlap(self, a, b):
        return f"arrays_overlap({a}, {b})"

    def distinct(self, a):
        return f"array_distinct({a})"

    def sorted(self, a):
        return f"array_sort({a})"

    def fold(self, a, x, y, e):
        """Left fold of a non-empty array of doubles."""
        return f"aggregate(slice({a}, 2, size({a})), element_at({a}, 1), ({x}, {y}) -> {e})"

    def gather(self, x, order):
        """Values of a group in order, as an array."""
        return f"transform(array_sort(collect_list(named_struct('o', {order}, 'v', {x}))), s -> s.v)"

    def try_double(self, x):
        return f"try_cast({x} AS DOUBLE)"

    def rand(self, x):
        """A hash-drawn number in [0, 1)."""
        return f"({self.hash(x)} / 4294967296e0)"


class Duck(Spark):
    name = "duck"

    def at(self, a, i):
        return f"({a})[{i}]"

    def explode(self, a):
        return f"unnest({a})"

    def seq(self, a, b):
        return f"range({a}, ({b}) + 1)"

    def rx(self, x, p):
        return f"regexp_matches({x}, {self.lit(p)})"

    def rr(self, x, p, r):
        return f"regexp_replace({x}, {self.lit(p)}, {self.lit(r)}, 'g')"

    def rall(self, x, p):
        return f"regexp_extract_all({x}, {self.lit(p)})"

    def lit(self, s):
        return "'" + s + "'"

    def hash(self, x):
        return f"CAST('0x' || substr(md5({x}), 1, 8) AS BIGINT)"

    def join(self, x, sep, order):
        return f"string_agg({x}, '{sep}' ORDER BY {order})"

    def pct(self, x, p):
        return f"quantile_cont({x}, {p})"

    def corr(self, a, b):
        return f"corr({a}, {b})"

    def size(self, a):
        return f"len({a})"

    def split(self, x, sep):
        return f"string_split({x}, '{sep}')"

    def json(self, x, k):
        return f"json_extract_string({x}, '$.{k}')"

    def micros(self, ts):
        return f"epoch_us({ts})"

    def map(self, a, v, e):
        return f"list_transform({a}, lambda {v}: {e})"

    def keep(self, a, v, e):
        return f"list_filter({a}, lambda {v}: {e})"

    def arr(self, *xs):
        return f"[{', '.join(xs)}]"

    def sha(self, x):
        return f"sha256({x})"

    def concat(self, a, sep):
        return f"array_to_string({a}, '{sep}')"

    def xor(self, a, b):
        return f"xor({a}, {b})"

    def shr(self, a, b):
        return f"({a} >> {b})"

    def slice(self, a, i, n):
        return f"({a})[({i}):({i}) + ({n}) - 1]"

    def last(self, a):
        return f"({a})[-1]"

    def overlap(self, a, b):
        return f"list_has_any({a}, {b})"

    def distinct(self, a):
        return f"list_distinct({a})"

    def sorted(self, a):
        return f"list_sort({a})"

    def fold(self, a, x, y, e):
        return f"list_reduce({a}, lambda {x}, {y}: {e})"

    def gather(self, x, order):
        return f"list({x} ORDER BY {order})"


SPARK, DUCK = Spark(), Duck()


def bind(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """Views of the tables of ``sf_dir`` that a text names."""
    for t in TABLES:
        if t in sql:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def rows(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of a Spark text over the tables of ``sf_dir``."""
    bind(spark, sf_dir, sql)
    return spark.sql(sql)


@dataclass(frozen=True)
class Query:
    name: str
    ids: str  # operators of the inventory that the query exercises
    text: Callable[[Spark], str]
    #: Views that a DataFrame program fills here and a common table expression of the twin's text there.
    views: tuple[tuple[str, Callable[[SparkSession, str], DataFrame]], ...] = ()

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        sql = self.text(SPARK)
        bind(spark, sf_dir, sql)  # before the views, which may read the same tables
        for name, fill in self.views:
            fill(spark, sf_dir).createOrReplaceTempView(name)
        out = rows(spark, sf_dir, sql)
        # ranks are int here and bigint there
        return out.withColumns({c: out[c].cast("long") for c, t in out.dtypes if t == "int" and c in RANKS})

    def oracle(self) -> str:
        return self.text(DUCK)


def query(registry: list, ids: str, **views: Callable[[SparkSession, str], DataFrame]):
    """Register a dialect function as a query of its own name."""

    def wrap(f):
        registry.append(Query(f.__name__, ids, f, tuple(views.items())))
        return f

    return wrap

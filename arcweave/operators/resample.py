"""Bootstrap in one pass: Poisson weights drawn by an integer hash of (unit, replicate).

Every task turns its rows into the weighted sums of all replicates at once, so
what is shuffled is a line a group, replicate and task, however many rows there
are; no table of rows times replicates is ever made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Replicates of an interval.
REPLICATES = 1000
#: A Mersenne prime: squares of what is below it fit into 63 bits in any engine.
P = 2**31 - 1
#: Cumulative probabilities of a Poisson count of mean one.
_CUT = np.cumsum([np.exp(-1.0) / float(np.prod(np.arange(1, k + 1))) for k in range(10)])
CUTS = tuple(round(float(c), 12) for c in _CUT)
#: Rows whose weights are drawn together.
ROWS = 512


def weights(units: np.ndarray, replicates: int) -> np.ndarray:
    """(units x replicates) Poisson counts; the same in every engine and task."""
    x = units.astype(np.int64)[:, None] % P + 1
    b = np.arange(1, replicates + 1, dtype=np.int64)[None, :]
    y = x * ((b * 7919 + 104729) % P) % P
    y = (y * y + x) % P
    y = (y * 48271 + b) % P
    y = (y * y + 12345) % P
    return np.searchsorted(np.array(CUTS), y / P, side="right")


def weight_sql(unit: str, b: str) -> str:
    """The same count in SQL."""
    y = f"((({unit}) % {P} + 1) * ((({b}) * 7919 + 104729) % {P}) % {P})"
    y = f"(({y} * {y} + ({unit}) % {P} + 1) % {P})"
    y = f"(({y} * 48271 + ({b})) % {P})"
    u = f"(({y} * {y} + 12345) % {P} / {P}e0)"
    return "(" + " + ".join(f"CASE WHEN {u} >= {c!r} THEN 1 ELSE 0 END" for c in CUTS) + ")"


def poisson_sums(rows: DataFrame, unit: str, group: str, values: list[str], replicates: int = REPLICATES) -> DataFrame:
    """(group, b, n, values...): for each replicate the sum of the weights and of each weighted value; b 0 has all weights one.

    ``unit`` is a long id that is not negative: rows of one unit are drawn together. Null units and null
    values add nothing.
    """
    schema = f"g string, b int, n double, {', '.join(f'v{k} double' for k in range(len(values)))}"
    plain = rows.where(F.col(unit).isNotNull()).select(F.col(group).cast("string").alias("g"), F.col(unit).cast("long").alias("u"), *[F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(f"v{k}") for k, v in enumerate(values)])

    def part(batches):
        total: dict[str | None, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            units = batch.column(1).to_numpy()
            v = np.stack([np.ones(len(units)), *(batch.column(2 + k).to_numpy() for k in range(len(values)))])
            for lo in range(0, len(units), ROWS):
                at = slice(lo, lo + ROWS)
                w = np.concatenate([np.ones((len(units[at]), 1)), weights(units[at], replicates)], axis=1)
                for g in set(names[at]):
                    own = names[at] == g if g is not None else np.array([x is None for x in names[at]])
                    total[g] = total.get(g, 0) + v[:, at][:, own] @ w[own]
        for g, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([g] * (replicates + 1), pa.string()), pa.array(np.arange(replicates + 1, dtype=np.int32)), *(pa.array(x) for x in t)], names=["g", "b", "n", *(f"v{k}" for k in range(len(values)))])

    sums = plain.mapInArrow(part, schema).groupBy("g", "b").agg(F.sum("n").alias("n"), *[F.sum(f"v{k}").alias(v) for k, v in enumerate(values)])
    return sums.withColumnRenamed("g", group)

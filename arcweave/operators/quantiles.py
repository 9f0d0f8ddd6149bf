"""Exact quantiles by group in bounded memory: a histogram of the range first, then the values of the cells that hold the wanted ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import keep

#: Cells of a group's range in one pass, and distinct values of a cell that are taken as they are.
CELLS, MOST = 1024, 4096


def quantiles(rows: DataFrame, group: str, value: str, shares: Sequence[float]) -> DataFrame:
    """(group, share, q): the values at ``shares`` of the sorted values of each group, interpolated between neighbours.

    Null and NaN values do not count; a group without values gives no row. Each pass counts the values
    of every open interval in CELLS cells and keeps the cells that hold a wanted rank; intervals
    of at most MOST distinct values end it. What a task holds is a count by cell, never a group.
    """
    spark = rows.sparkSession
    v = F.col(value).cast("double")
    data = keep(rows.select(F.col(group).alias("g"), v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")), "values")
    whole = data.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    s = F.explode(F.array(*map(F.lit, shares))).alias("share")
    at = F.col("share") * (F.col("n") - 1)
    ranks = keep(whole.select("g", "n", "lo", "hi", s).select("*", F.floor(at).alias("low"), (at - F.floor(at)).alias("part")), "ranks")  # a line a group and share
    # one line for each wanted place (from 0): the place itself and the next
    places = ranks.select("g", "lo", "hi", F.explode(F.array_distinct(F.array("low", F.least(F.col("low") + 1, F.col("n") - 1)))).alias("place")).distinct()
    places = keep(places.withColumn("before", F.lit(0).cast("long")), "places")
    done = []
    while places.limit(1).count():
        spans = places.select(F.col("g").alias("h"), "lo", "hi", "before").distinct()
        held = data.join(F.broadcast(spans) if _few(spans) else spans, F.col("g").eqNullSafe(F.col("h")) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        width = F.col("hi") - F.col("lo")
        cell = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("lo")) / width * CELLS), F.lit(CELLS - 1))).otherwise(0)
        counts = held.withColumn("cell", cell).groupBy("g", "lo", "hi", "before", "cell").agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"), F.approx_count_distinct("v").alias("kinds"))
        w = Window.partitionBy("g", "lo", "hi").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        counts = keep(counts.withColumn("start", F.col("before") + F.coalesce(F.sum("c").over(w), F.lit(0))), "cells")
        hit = places.alias("p").join(counts.alias("c"), F.expr("p.g <=> c.g AND p.lo = c.lo AND p.hi = c.hi AND p.place >= c.start AND p.place < c.start + c.c")).select("p.g", "p.place", "c.least", "c.most", "c.start", "c.kinds")
        hit = keep(hit, "hits")
        one = F.col("least") == F.col("most")
        done.append(hit.where(one).select("g", "place", F.col("least").alias("v")))
        small = hit.where(~one & (F.col("kinds") <= MOST / 2))
        if small.limit(1).count():
            spots = small.select(F.col("g").alias("h"), "least", "most", "start").distinct()
            own = data.join(F.broadcast(spots) if _few(spots) else spots, F.col("g").eqNullSafe(F.col("h")) & (F.col("v") >= F.col("least")) & (F.col("v") <= F.col("most"))).groupBy("g", "least", "most", "start", "v").agg(F.count("*").alias("c"))
            upto = Window.partitionBy("g", "least", "most").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
            own = own.withColumn("from_", F.col("start") + F.coalesce(F.sum("c").over(upto), F.lit(0)))
            done.append(small.alias("p").join(own.alias("o"), F.expr("p.g <=> o.g AND p.least = o.least AND p.most = o.most AND p.place >= o.from_ AND p.place < o.from_ + o.c")).select("p.g", "p.place", "o.v"))
        places = keep(hit.where(~one & (F.col("kinds") > MOST / 2)).select("g", F.col("least").alias("lo"), F.col("most").alias("hi"), "place", F.col("start").alias("before")), "places")
    found = spark.createDataFrame([], data.schema.add("place", "long")).select("g", "place", "v")
    for t in done:
        found = found.union(t)
    a, b = found.alias("a"), found.alias("b")
    both = ranks.alias("r").join(a, F.expr("r.g <=> a.g AND r.low = a.place")).join(b, F.expr("r.g <=> b.g AND least(r.low + 1, r.n - 1) = b.place"))
    q = F.when(F.col("part") == 0, F.col("a.v")).otherwise((1 - F.col("part")) * F.col("a.v") + F.col("part") * F.col("b.v"))
    return both.select(F.col("r.g").alias(group), "share", q.alias("q"))


def _few(table: DataFrame) -> bool:
    """Whether a table of intervals is small enough to be sent to all tasks."""
    return table.limit(100_001).count() <= 100_000

"""New cores in given cones, clear of all old ones and of each other."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources.workspace import keep
from . import rewiring, search

#: Draws of a request, degrees of its cone, and degrees that any two cores keep between them.
DRAWS, CONE, FLOOR = 16, 30.0, 2.0


def draws_in_cones(requests: DataFrame, draws: int = DRAWS) -> DataFrame:
    """(id, draw, vector): unit vectors drawn evenly over the cap of each request (id, vector, cone in degrees); seeded by the id."""

    def run(batches):
        for b in batches:
            ids, cones = b.column("id").to_pylist(), b.column("cone").to_pylist()
            out = []
            for i, c, cone in zip(ids, search._matrix(b.column("vector")), cones):
                rng = np.random.default_rng([int(i) & 0x7FFFFFFF, int(i) >> 31 & 0x7FFFFFFF])
                axis = c / np.linalg.norm(c)
                side = np.cross(axis, np.eye(3)[np.abs(axis).argmin()])
                side /= np.linalg.norm(side)
                height = 1 - rng.random(draws) * (1 - np.cos(np.radians(cone)))
                turn, wide = 2 * np.pi * rng.random(draws), np.sqrt(1 - height * height)
                out.append(height[:, None] * axis + wide[:, None] * (np.cos(turn)[:, None] * side + np.sin(turn)[:, None] * np.cross(axis, side)))
            flat = np.concatenate(out) if out else np.zeros((0, 3))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), draws)), pa.array(np.tile(np.arange(draws, dtype=np.int32), len(ids))), pa.array(flat.tolist(), pa.list_(pa.float64()))], names=["id", "draw", "vector"])

    plain = requests.select(F.col("id").cast("long").alias("id"), "vector", F.col("cone").cast("double").alias("cone"))
    real = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x) > 1e-20
    return plain.where(F.col("id").isNotNull() & real).mapInArrow(run, "id long, draw int, vector array<double>")


def place(old: search.AngularIndex, requests: DataFrame, floor: float = FLOOR, draws: int = DRAWS) -> DataFrame:
    """(id, vector, clearance): a core for each request, in the order of ids, or none where no draw is clear.

    A request takes the draw farthest from all old cores that is at least ``floor`` degrees from them and from every core placed
    before it. That is the first-fit set of the draws, in the order of (request, clearance), where draws of one
    request and draws under ``floor`` degrees apart exclude each other; it is found in rounds. Requests without
    direction give none. What is placed is appended to ``old``.
    """
    drawn = keep(draws_in_cones(requests, draws).withColumn("key", F.col("id") * draws + F.col("draw")), "draws")
    near = old.nearest(drawn, 1, id_col="key", exclude_self=False, digits=None).select(F.col("query_id").alias("key"), F.col("angle").alias("clearance"))
    seen = drawn.join(near.hint("merge"), "key", "left").withColumn("clearance", F.coalesce("clearance", F.lit(180.0))).where(F.col("clearance") >= floor)
    w = Window.partitionBy("id").orderBy(F.desc(F.round("clearance", 9)), "draw")  # as many rows as draws
    open_ = keep(seen.withColumn("place", F.col("id") * draws + F.row_number().over(w) - 1).select("id", F.col("place"), "vector", "clearance"), "open")
    items = open_.select(F.col("place").alias("id"), "vector")
    close = search.AngularIndex.build(items).within(items, 0.0, float(np.nextafter(floor, 0)), once=True).select(F.col("query_id").alias("a"), F.col("id").alias("b"))
    again = open_.select(F.col("id").alias("other"), F.col("place").alias("b"))
    own = open_.join(again.hint("merge"), (F.col("id") == F.col("other")) & (F.col("place") < F.col("b"))).select(F.col("place").alias("a"), "b")
    won = rewiring.first_fit(items, close.union(own)).where("added").select(F.col("id").alias("place"))
    placed = keep(open_.join(won.hint("merge"), "place", "left_semi").select("id", "vector", "clearance"), "placed")
    old.append(placed)
    return requests.select(F.col("id").cast("long").alias("id")).join(placed.hint("merge"), "id", "left")


def placed_cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new core near each tenth concept's, clear of all concepts and of the other new ones."""
    c = G.concepts(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select("id", F.array(*G.CORE).alias("vector"))
    asked = c.where("id % 10 = 0").select((F.col("id") + F.lit(1 << 32)).alias("id"), "vector", F.lit(CONE).alias("cone"))
    got = place(search.AngularIndex.build(c), asked)
    axes = [F.round(F.element_at("vector", k + 1), 6).alias(a) for k, a in enumerate(G.CORE)]
    return got.select((F.col("id") - F.lit(1 << 32)).alias("id"), *axes, F.round("clearance", 4).alias("clearance"))

"""The dictionary as an object: lookups, filters, search, composition and curation over DataFrames.

Every method returns a DataFrame. Names and aliases match without regard to
case. An atlas is never changed in place: ``add`` and ``relate`` return a new one.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import geometry as G
from .operators.search import nearest


@dataclass(frozen=True)
class Atlas:
    concepts: DataFrame
    aliases: DataFrame
    relations: DataFrame

    @staticmethod
    def of_embeddings(spark: SparkSession, sf_dir: str) -> Atlas:
        """The binding of the base tables: vectors as concepts, every third with an alias, two edges each."""
        c = G.concepts(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
        a = c.where("id % 3 = 0").select(F.concat(F.lit("A"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("alias"), F.col("id").alias("concept_id"))
        n = c.count()
        e = c.select(F.col("id").alias("a"), F.explode(F.array((7 * F.col("id") + 3) % n, (13 * F.col("id") + 1) % n)).alias("b")).where("a <> b")
        e = e.select(F.least("a", "b").alias("c1"), F.greatest("a", "b").alias("c2")).distinct()
        empty = Atlas(c, a, spark.createDataFrame([], "c1 long, c2 long, rel_type string, angle4 double, angle8 double"))
        return empty.relate(e)

    # -- lookups and filters

    def get(self, name: str) -> DataFrame:
        """The concept of a name, else of an alias."""
        u = name.upper()
        by_name = self.concepts.where(F.upper("name") == u).withColumn("_o", F.lit(0))
        by_alias = self.concepts.join(self.aliases.where(F.upper("alias") == u).select(F.col("concept_id").alias("id")), "id", "left_semi").withColumn("_o", F.lit(1))
        return by_name.unionByName(by_alias).orderBy("_o").limit(1).drop("_o")

    def exists(self, name: str) -> bool:
        return bool(self.get(name).limit(1).count())

    def count(self) -> int:
        return self.concepts.count()

    def names(self) -> DataFrame:
        return self.concepts.select("name").orderBy("name")

    def by_trigram(self, trigram: str) -> DataFrame:
        return self.concepts.where(F.col("trigram") == trigram.upper()).orderBy("name")

    def by_level(self, level: int) -> DataFrame:
        return self.concepts.where(F.col("level") == level).orderBy("name")

    def by_domain(self, axis: str, least: float = 0.5) -> DataFrame:
        if axis not in G.DOMAIN:
            raise ValueError(f"no domain axis: {axis}")
        return self.concepts.where(F.col(axis) >= least).orderBy(F.desc(axis), "id")

    def search(self, text: str) -> DataFrame:
        """Names that contain a text; ``%`` and ``_`` in it match themselves."""
        return self.concepts.where(F.contains(F.lower("name"), F.lit(text.lower()))).orderBy("name")

    # -- graph

    def undirected(self) -> DataFrame:
        r = self.relations
        return r.select(F.col("c1").alias("me"), F.col("c2").alias("other"), "rel_type", "angle4", "angle8").unionByName(r.select(F.col("c2").alias("me"), F.col("c1").alias("other"), "rel_type", "angle4", "angle8"))

    def relations_of(self, name: str, rel_type: str | None = None) -> DataFrame:
        me = self.get(name).select(F.col("id").alias("me"))
        r = self.undirected().join(F.broadcast(me), "me")  # one row
        return (r.where(F.col("rel_type") == rel_type) if rel_type else r).orderBy("angle4", "other")

    def orphans(self) -> DataFrame:
        return self.concepts.join(self.undirected().select(F.col("me").alias("id")), "id", "left_anti")

    def statistics(self) -> DataFrame:
        c = self.concepts
        parts = [c.groupBy(F.lit("trigram").alias("kind"), F.col("trigram").alias("value")).count(), c.groupBy(F.lit("level").alias("kind"), F.col("level").cast("string").alias("value")).count(), self.relations.groupBy(F.lit("rel_type").alias("kind"), F.col("rel_type").alias("value")).count()]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    # -- geometry

    def _pair(self, a: str, b: str) -> DataFrame:
        left, right = (self.get(n).select(*[F.col(k).alias(p + k) for k in ("name", *G.ESSENCE, *G.FUNCTION)]) for n, p in ((a, "p_"), (b, "q_")))
        return left.crossJoin(right)  # one row each

    def angle(self, a: str, b: str) -> DataFrame:
        return self._pair(a, b).select(G.angle("p_", "q_", G.CORE).alias("angle3"), G.angle("p_", "q_").alias("angle7"), G.witness("p_", "q_").alias("witness"), G.band(G.angle("p_", "q_", G.CORE)).alias("relation"))

    def compose(self, a: str, b: str) -> DataFrame:
        return self._pair(a, b).select(G.witness("p_", "q_").alias("w"), *G.compose("p_", "q_"))

    def slerp(self, a: str, b: str, t: float = 0.5) -> DataFrame:
        return self._pair(a, b).select(*G.slerp("p_", "q_", t))

    def neighbors(self, name: str, k: int = 10, axes=G.ESSENCE) -> DataFrame:
        """The k nearest of a concept, itself left out."""
        v = F.array(*axes).alias("vector")
        got = nearest(self.concepts.select("id", v), self.get(name).select("id", v), k)
        return got.join(self.concepts.select("id", "name"), "id").orderBy("place")

    def near_vector(self, vector: list[float], k: int = 10, axes=G.ESSENCE) -> DataFrame:
        """The k nearest of any vector; nothing is left out."""
        spark = self.concepts.sparkSession
        q = spark.createDataFrame([(-1, [float(x) for x in vector])], "id long, vector array<double>")
        return nearest(self.concepts.select("id", F.array(*axes).alias("vector")), q, k, exclude_self=False).join(self.concepts.select("id", "name"), "id").orderBy("place")

    def analogy(self, a: str, b: str, c: str, k: int = 5) -> DataFrame:
        """Nearest to c + (b - a)."""
        rows = [self.get(n).select(*G.ESSENCE).first() for n in (a, b, c)]  # three rows
        return self.near_vector([rows[2][x] + rows[1][x] - rows[0][x] for x in G.ESSENCE], k)

    # -- curation

    def check(self, new: DataFrame, least: float = 15.0) -> DataFrame:
        """Verdict on each new concept: its name or alias is taken, another stands nearer than ``least``, or accept."""
        v = F.array(*G.ESSENCE).alias("vector")
        near = nearest(self.concepts.select("id", v), new.select("id", v), 1, exclude_self=False).select(F.col("query_id").alias("id"), F.col("id").alias("near"), "angle")
        old = self.concepts.select(F.upper("name").alias("_n")).withColumn("_by_name", F.lit(True))
        ali = self.aliases.select(F.upper("alias").alias("_a")).distinct().withColumn("_by_alias", F.lit(True))
        out = new.select("id", "name").join(near, "id", "left").join(old, F.upper("name") == F.col("_n"), "left").join(ali, F.upper("name") == F.col("_a"), "left")
        verdict = F.when(F.col("_by_name"), "name").when(F.col("_by_alias"), "alias").when(F.col("angle") < least, "near").otherwise("accept")
        return out.select("id", "name", verdict.alias("verdict"), "near", "angle")

    def add(self, new: DataFrame, least: float = 15.0, force: bool = False) -> Atlas:
        """A new atlas with the accepted rows; of several with one name the smallest id stays."""
        ok = new if force else new.join(self.check(new, least).where("verdict = 'accept'").select("id"), "id", "left_semi")
        w = Window.partitionBy(F.upper("name")).orderBy("id")
        ok = ok.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
        return replace(self, concepts=self.concepts.unionByName(ok.withColumn("trigram", G.trigram()).select(*self.concepts.columns)))

    def relate(self, pairs: DataFrame) -> Atlas:
        """A new atlas with the pairs (c1, c2) as edges, angles computed; known pairs, either way round, are left out."""
        p, q = (self.concepts.select(F.col("id").alias(k), *[F.col(x).alias(f"{k}_{x}") for x in G.ESSENCE]) for k in ("c1", "c2"))
        known = self.relations.select(F.least("c1", "c2").alias("lo"), F.greatest("c1", "c2").alias("hi"))
        fresh = pairs.select("c1", "c2").withColumn("lo", F.least("c1", "c2")).withColumn("hi", F.greatest("c1", "c2")).dropDuplicates(["lo", "hi"]).join(known, ["lo", "hi"], "left_anti")
        e = fresh.select("c1", "c2").join(p, "c1").join(q, "c2")
        a = G.angle("c1_", "c2_", G.CORE)
        e = e.select("c1", "c2", G.band(a).alias("rel_type"), a.alias("angle4"), G.angle("c1_", "c2_").alias("angle8"))
        return replace(self, relations=self.relations.unionByName(e))

"""Column builders of the vector geometry: whole-stage-codegen expressions over scalar columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import CORE, DOMAIN, ESSENCE, FUNCTION, TRIGRAMS

__all__ = ["CORE", "DOMAIN", "ESSENCE", "FUNCTION", "angle", "array_angle", "band", "compose", "concepts", "cosine", "dot", "hamilton", "norm", "slerp", "trigram", "witness"]


def _sum(xs: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, xs)


def _cols(prefix: str, axes: Sequence[str]) -> list[Column]:
    return [F.col(f"{prefix}{k}") for k in axes]


def dot(a: str, b: str, axes: Sequence[str] = ESSENCE) -> Column:
    """Inner product of two prefixed column groups."""
    return _sum([x * y for x, y in zip(_cols(a, axes), _cols(b, axes))])


def norm(a: str, axes: Sequence[str] = ESSENCE) -> Column:
    return F.sqrt(dot(a, a, axes))


def cosine(a: str, b: str, axes: Sequence[str] = ESSENCE) -> Column:
    """Clipped cosine; null where a vector has no length."""
    size = norm(a, axes) * norm(b, axes)
    return F.when(size != 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b, axes) / F.when(size != 0, size))))


def angle(a: str, b: str, axes: Sequence[str] = ESSENCE, zero: float | None = 0.0) -> Column:
    """Degrees; ``zero`` (0, 90 or null by use) where a vector is shorter than 1e-10."""
    short = (norm(a, axes) < 1e-10) | (norm(b, axes) < 1e-10)
    return F.when(short, F.lit(zero).cast("double")).otherwise(F.degrees(F.acos(cosine(a, b, axes))))


def array_angle(a: Column, b: Column) -> Column:
    """Degrees between two array columns of one length."""
    d = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    size = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)) * F.sqrt(F.aggregate(b, F.lit(0.0), lambda s, x: s + x * x))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), d / F.when(size != 0, size)))))


def witness(a: str, b: str) -> Column:
    """1 - cos of the cores; 1 where one has no length."""
    return F.coalesce(1 - cosine(a, b, CORE), F.lit(1.0))


def trigram(prefix: str = "", x_limit: float = 0.2) -> Column:
    """Class by the first largest domain component and the polarity of x, then y."""
    d = [F.abs(c) for c in _cols(prefix, DOMAIN)]
    x, y = F.col(f"{prefix}x"), F.col(f"{prefix}y")
    yang = (x > x_limit) | ((F.abs(x) <= x_limit) & (y > 0))
    out = None
    for c, (a, b) in zip(d, TRIGRAMS.values()):
        arm = F.when(yang, F.lit(a)).otherwise(F.lit(b))
        out = F.when(c == F.greatest(*d), arm) if out is None else out.when(c == F.greatest(*d), arm)
    return out


def band(a: Column, limits: Sequence[float] = (15, 45, 80, 105)) -> Column:
    """Relation type of an angle; the limits are a parameter, as uses differ."""
    s, f, j, c = limits
    return F.when(a < s, "synonym").when(a < f, "affinity").when(a < j, "adjacent").when(a <= c, "complement").otherwise("opposition")


def hamilton(p: Sequence[Column], q: Sequence[Column]) -> list[Column]:
    """Product of two quaternions (w, x, y, z)."""
    (a, b, c, d), (e, f, g, h) = p, q
    return [a * e - b * f - c * g - d * h, a * f + b * e + c * h - d * g, a * g - b * h + c * e + d * f, a * h + b * g - c * f + d * e]


def compose(a: str, b: str) -> list[Column]:
    """Mean core and length-weighted domain of two concepts, named by axis."""
    core = [((F.col(f"{a}{k}") + F.col(f"{b}{k}")) / 2).alias(k) for k in CORE]
    m, n = norm(a, DOMAIN) + 0.1, norm(b, DOMAIN) + 0.1
    return core + [((F.col(f"{a}{k}") * m + F.col(f"{b}{k}") * n) / (m + n)).alias(k) for k in DOMAIN]


def slerp(a: str, b: str, t: float) -> list[Column]:
    """Point at ``t`` on the arc between two cores, linear in the domain."""
    w = F.radians(angle(a, b, CORE))
    core = [((F.sin((1 - t) * w) * F.col(f"{a}{k}") / norm(a, CORE) + F.sin(t * w) * F.col(f"{b}{k}") / norm(b, CORE)) / F.when(F.sin(w) != 0, F.sin(w))).alias(k) for k in CORE]
    return core + [((1 - t) * F.col(f"{a}{k}") + t * F.col(f"{b}{k}")).alias(k) for k in DOMAIN]


def concepts(embeddings: DataFrame) -> DataFrame:
    """id, name, level, 14 components and class of each vector."""
    cols = [F.element_at("embedding", i + 1).cast("double").alias(k) for i, k in enumerate(ESSENCE + FUNCTION)]
    out = embeddings.select(F.col("vec_id").alias("id"), F.concat(F.lit("C"), F.lpad(F.col("vec_id").cast("string"), 5, "0")).alias("name"), (F.col("label") % 9).cast("long").alias("level"), *cols)
    return out.withColumn("trigram", trigram())

"""The model tables as SQL over the base tables, in either dialect.

``concepts``: one row per vector; seven essence and seven function components,
a name, a level and a trigram class. ``relations``: directed typed edges with
both angles stored. ``succession``: frame and cycle edges of a small calendar.
"""

from __future__ import annotations

ESSENCE = ("x", "y", "z", "e", "f", "g", "h")
FUNCTION = ("fx", "fy", "fz", "fe", "ff", "fg", "fh")
CORE, DOMAIN = ESSENCE[:3], ESSENCE[3:]

#: Class by dominant domain (e, f, g, h in order) and polarity.
TRIGRAMS = {"e": ("QIAN", "KUN"), "f": ("ZHEN", "XUN"), "g": ("LI", "KAN"), "h": ("DUI", "GEN")}
#: Names of the levels 0 to 8.
LEVELS = ("quark", "particle", "atom", "molecule", "organic", "complex", "abstract", "integration", "unity")


def dot(a: str, b: str, axes) -> str:
    return "(" + " + ".join(f"{a}{k} * {b}{k}" for k in axes) + ")"


def norm(a: str, axes) -> str:
    return f"sqrt({dot(a, a, axes)})"


def cosine(a: str, b: str, axes) -> str:
    """Clipped; null where a vector has no length."""
    size = f"{norm(a, axes)} * {norm(b, axes)}"
    return f"CASE WHEN {size} <> 0e0 THEN greatest(-1e0, least(1e0, {dot(a, b, axes)} / nullif({size}, 0e0))) END"


def angle(a: str, b: str, axes, zero: str = "0e0") -> str:
    """Degrees between two vectors; ``zero`` where one has no length."""
    return f"CASE WHEN {norm(a, axes)} < 1e-10 OR {norm(b, axes)} < 1e-10 THEN {zero} ELSE degrees(acos({cosine(a, b, axes)})) END"


def r(x: str, n: int = 6) -> str:
    """Rounded, without a negative zero."""
    return f"(round({x}, {n}) + 0e0)"


def trigram(p: str = "") -> str:
    big = f"greatest(abs({p}e), abs({p}f), abs({p}g), abs({p}h))"
    yang = f"({p}x > 0.2e0 OR (abs({p}x) <= 0.2e0 AND {p}y > 0e0))"
    arms = " ".join(f"WHEN abs({p}{k}) = {big} THEN CASE WHEN {yang} THEN '{a}' ELSE '{b}' END" for k, (a, b) in TRIGRAMS.items())
    return f"CASE {arms} END"


def band(a: str) -> str:
    """Relation type of an angle."""
    return f"CASE WHEN {a} < 15e0 THEN 'synonym' WHEN {a} < 45e0 THEN 'affinity' WHEN {a} < 80e0 THEN 'adjacent' WHEN {a} <= 105e0 THEN 'complement' ELSE 'opposition' END"


def level_name(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} = {i} THEN '{n}'" for i, n in enumerate(LEVELS)) + " END"


def concepts(d) -> str:
    cols = ", ".join(f"CAST({d.at('embedding', i + 1)} AS DOUBLE) AS {k}" for i, k in enumerate(ESSENCE + FUNCTION))
    return f"""v0 AS (SELECT vec_id AS id, concat('C', {d.left_pad('vec_id', 5)}) AS name, CAST(label % 9 AS BIGINT) AS level, {cols} FROM embeddings),
    concepts AS (SELECT *, {trigram()} AS trigram FROM v0)"""


def aliases(d) -> str:
    return f"aliases AS (SELECT concat('A', {d.left_pad('vec_id', 5)}) AS alias, vec_id AS concept_id FROM embeddings WHERE vec_id % 3 = 0)"


def relations(d) -> str:
    return f"""n0 AS (SELECT count(*) AS n FROM embeddings),
    e0 AS (SELECT vec_id AS a, (7 * vec_id + 3) % n AS b FROM embeddings, n0 UNION SELECT vec_id, (13 * vec_id + 1) % n FROM embeddings, n0),
    e1 AS (SELECT least(a, b) AS c1, greatest(a, b) AS c2 FROM e0 WHERE a <> b GROUP BY least(a, b), greatest(a, b)),
    e2 AS (SELECT c1, c2, {angle('p.', 'q.', CORE)} AS angle4, {angle('p.', 'q.', ESSENCE)} AS angle8
           FROM e1 JOIN concepts p ON p.id = c1 JOIN concepts q ON q.id = c2),
    relations AS (SELECT c1, c2, angle4, angle8, {band('angle4')} AS rel_type FROM e2)"""


def undirected(d) -> str:
    return "und AS (SELECT c1 AS me, c2 AS other, rel_type, angle4, angle8 FROM relations UNION ALL SELECT c2, c1, rel_type, angle4, angle8 FROM relations)"


#: The region that stands for the present.
PRESENT = 2


def succession(d) -> str:
    """Regions in the order of their keys are the frame; the nations of a region are a wheel whose last station leads back to the first."""
    return """stations AS (SELECT n_name, r_name, lead(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS next_, first_value(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS first_ FROM nation JOIN region ON r_regionkey = n_regionkey),
    succession AS (SELECT a.r_name AS earlier, b.r_name AS later, 'frame' AS regime, '' AS cycle_name, 0 AS wrap FROM region a JOIN region b ON b.r_regionkey = a.r_regionkey + 1
      UNION ALL SELECT n_name, coalesce(next_, first_), 'cycle', r_name, CASE WHEN next_ IS NULL THEN 1 ELSE 0 END FROM stations WHERE n_name <> coalesce(next_, first_))"""

"""Resampling inference: permutation and bootstrap tests, gates and readings over all rows.

Rows are first averaged into the units that are resampled (sixty clusters an
arm, one row a document, one a replicate); draws are hashes that both engines
compute, and every replicate is a group of one long table. A permutation
p-value is (1 + hits) / (1 + draws).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import Tails
from ..model import CORE, ESSENCE, FUNCTION, concepts, dot, r, relations, undirected
from ..plans.dialect import SPARK, query, rows
from ..sources.workspace import keep
from . import ordered, pairs
from .statistics import avg_rank, items, matrix, n_if, raters, runlog, scored, series, share

QUERIES: list = []
Q = lambda ids, **views: query(QUERIES, ids, **views)

A, B = "'1-URGENT'", "'5-LOW'"


def boots(d, n: int) -> str:
    return f"b AS (SELECT {d.explode(d.seq(1, n))} AS b)"


def draw(d, tag: str, *keys: str) -> str:
    """A hash of the keys, as text joined by bars."""
    return d.hash(f"concat('{tag}'" + "".join(f", '|', CAST({k} AS STRING)" for k in keys) + ")")


def cells(d) -> str:
    """Means of clusters by arm and polarity; ``wide`` has a row by arm and cluster."""
    return f"""{items(d)}, cells AS (SELECT arm, item % 60 AS i, pol, avg(v) AS v, count(*) AS n FROM items GROUP BY arm, item % 60, pol),
    wide AS (SELECT arm, i, max(CASE WHEN pol = 0 THEN v END) AS v0, max(CASE WHEN pol = 1 THEN v END) AS v1, sum(n) AS n, sum(v * n) / sum(n) AS v FROM cells GROUP BY arm, i)"""


def p_value(c: str, n: int) -> str:
    return r(f"(1e0 + {n_if(c)}) / {n + 1}e0")


def ci(d, x: str, name: str, digits: int = 5) -> str:
    """Ends of the percentile interval; interpolated, so one digit fewer than the statistics have."""
    return f"{r(d.pct(x, '0.025e0'), digits)} AS {name}_lo, {r(d.pct(x, '0.975e0'), digits)} AS {name}_hi"


@Q("STAT-30")
def within_arm_rho(d):
    """Rank correlation of the two polarities in each arm: permuted within the arm, and its stratified bootstrap interval."""
    return f"""WITH {cells(d)}, w AS (SELECT arm, i, row_number() OVER (PARTITION BY arm ORDER BY i) - 1 AS pos, count(*) OVER (PARTITION BY arm) AS m, {avg_rank('v0', 'arm')} AS ra, {avg_rank('v1', 'arm')} AS rb FROM wide WHERE v0 IS NOT NULL AND v1 IS NOT NULL), {boots(d, 99)},
    o AS (SELECT arm, corr(ra, rb) AS rho FROM w GROUP BY arm), q AS (SELECT b, arm, ra, row_number() OVER (PARTITION BY b, arm ORDER BY {draw(d, 'rho', 'b', 'arm', 'i')}, i) - 1 AS pos FROM b CROSS JOIN w),
    s AS (SELECT q.b, q.arm, corr(q.ra, w.rb) AS rho FROM q JOIN w ON w.arm = q.arm AND w.pos = q.pos GROUP BY q.b, q.arm), k AS (SELECT b, arm, {draw(d, 'pick', 'b', 'i')} % m AS pick FROM b CROSS JOIN w),
    t AS (SELECT k.b, k.arm, corr(ra, rb) AS rho FROM k JOIN w ON w.arm = k.arm AND w.pos = k.pick GROUP BY k.b, k.arm), e AS (SELECT arm, {ci(d, 'rho', 'rho')} FROM t GROUP BY arm),
    x AS (SELECT t.b, max(CASE WHEN arm = {A} THEN rho END) - max(CASE WHEN arm = {B} THEN rho END) AS delta FROM t GROUP BY t.b), y AS (SELECT {ci(d, 'delta', 'delta')} FROM x)
    SELECT o.arm, {r('max(o.rho)')} AS rho, {p_value('abs(s.rho) >= abs(o.rho) - 1e-12', 99)} AS p_value, max(rho_lo) AS rho_lo, max(rho_hi) AS rho_hi, max(delta_lo) AS delta_lo, max(delta_hi) AS delta_hi
    FROM o JOIN s ON s.arm = o.arm JOIN e ON e.arm = o.arm CROSS JOIN y GROUP BY o.arm"""


@Q("STAT-31")
def condition_swap(d):
    """The difference of two arms' correlations when items swap their arms by a mask, and the joint statistic over all pairs of arms."""
    return f"""WITH {cells(d)}, w AS (SELECT * FROM wide WHERE v0 IS NOT NULL AND v1 IS NOT NULL), p AS (SELECT x.arm AS a1, y.arm AS a2, x.i, x.v0 AS x0, x.v1 AS x1, y.v0 AS y0, y.v1 AS y1 FROM w x JOIN w y ON y.i = x.i AND x.arm < y.arm),
    b AS (SELECT {d.explode(d.seq(0, 99))} AS b), m AS (SELECT b, p.*, b > 0 AND {draw(d, 'swap', 'b', 'i')} % 2 = 1 AS sw FROM b CROSS JOIN p),
    s AS (SELECT b, a1, a2, corr(CASE WHEN sw THEN y0 ELSE x0 END, CASE WHEN sw THEN y1 ELSE x1 END) - corr(CASE WHEN sw THEN x0 ELSE y0 END, CASE WHEN sw THEN x1 ELSE y1 END) AS delta FROM m GROUP BY b, a1, a2),
    j AS (SELECT b, sum(delta * delta) AS joint FROM s GROUP BY b), jj AS (SELECT {p_value('z.joint >= o.joint - 1e-12', 99)} AS joint_p FROM j z CROSS JOIN (SELECT joint FROM j WHERE b = 0) o WHERE z.b > 0)
    SELECT s.a1, s.a2, {r('max(o.delta)')} AS delta, {p_value('abs(s.delta) >= abs(o.delta) - 1e-12', 99)} AS p_value, max(joint_p) AS joint_p FROM s JOIN s o ON o.b = 0 AND o.a1 = s.a1 AND o.a2 = s.a2 CROSS JOIN jj WHERE s.b > 0 GROUP BY s.a1, s.a2"""


@Q("STAT-32")
def rho_by_polarity(d):
    """Rank correlation of size and value by polarity, all and straight items alone, with bootstrap intervals."""
    return f"""WITH {cells(d)}, u AS (SELECT CAST(pol AS STRING) AS part_, arm, i, v, n FROM cells UNION ALL SELECT 'all', arm, i, v, n FROM wide), k AS (SELECT part_, {avg_rank('v', 'part_')} AS ra, {avg_rank('n', 'part_')} AS rb, row_number() OVER (PARTITION BY part_ ORDER BY arm, i) - 1 AS pos, count(*) OVER (PARTITION BY part_) AS m FROM u),
    {boots(d, 60)}, g AS (SELECT b, part_, {draw(d, 'pol', 'b', 'part_', 'pos')} % m AS pick FROM b CROSS JOIN k), t AS (SELECT g.b, g.part_, corr(ra, rb) AS rho FROM g JOIN k ON k.part_ = g.part_ AND k.pos = g.pick GROUP BY g.b, g.part_), o AS (SELECT part_, corr(ra, rb) AS rho, count(*) AS n FROM k GROUP BY part_)
    SELECT o.part_, max(n) AS n, {r('max(o.rho)')} AS rho, {ci(d, 't.rho', 'rho')}, o.part_ = '0' AS straight FROM o JOIN t ON t.part_ = o.part_ GROUP BY o.part_"""


DRAWS = 40


def shuffled(spark: SparkSession, sf_dir: str, tag: str, cols: str) -> DataFrame:
    """(b, at_, q, t): every row of a stratum (b 0: itself) beside the row that draw b puts in its place; ``cols`` of both.

    Places are numbered over ranges of all draws and strata, so that no task has a stratum.
    """
    t = rows(spark, sf_dir, f"WITH {scored(SPARK)} SELECT stratum, id, {cols} FROM scored WHERE stratum IS NOT NULL")
    return _shuffled(t, tag)


def _shuffled(t: DataFrame, tag: str) -> DataFrame:
    rest = [c for c in t.columns if c not in ("stratum", "id")]
    t = keep(ordered.numbered(t, ["stratum"], ["id"], "at_"), "placed")
    k = t.select(F.explode(F.sequence(F.lit(1), F.lit(DRAWS))).alias("b"), "stratum", "id", F.struct(*rest).alias("q")).withColumn("h", F.expr(draw(SPARK, tag, "b", "id")))
    drawn = ordered.numbered(k, ["b", "stratum"], ["h", "id"], "at_").select("b", "stratum", "at_", "q")
    own = t.select(F.lit(0).alias("b"), "stratum", "at_", F.struct(*rest).alias("q"))
    return own.union(drawn).join(t.select("stratum", "at_", F.struct(*rest).alias("t")), ["stratum", "at_"])


def shuffled_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(b, v, c): counts of the errors of each draw."""
    return shuffled(spark, sf_dir, "med", "card, floor(p * 7) AS guess").groupBy("b", F.abs(F.col("t.guess") - F.col("q.card")).alias("v")).agg(F.count("*").alias("c"))


@Q("STAT-33", shuffled_errors=shuffled_errors)
def median_error_null(d):
    """Median error of a report, exact hits and mean rank error, each against labels shuffled within strata."""
    if d.name == "spark":
        return f"""WITH s AS (SELECT b, percentile(v, 0.5e0, c) AS med, sum(CASE WHEN v = 0 THEN c ELSE 0 END) / CAST(sum(c) AS DOUBLE) AS hits, sum(v * c) / nullif(CAST(sum(CASE WHEN v IS NOT NULL THEN c END) AS DOUBLE), 0e0) AS mean FROM shuffled_errors GROUP BY b), o AS (SELECT * FROM s WHERE b = 0)
        SELECT {r('max(o.med)')} AS median_error, {p_value('s.med <= o.med', DRAWS)} AS median_p, {r('max(o.hits)')} AS hits, {p_value('s.hits >= o.hits - 1e-12', DRAWS)} AS hits_p, {r('max(o.mean)')} AS mean_error, {p_value('s.mean <= o.mean + 1e-12', DRAWS)} AS mean_p FROM s CROSS JOIN o WHERE s.b > 0"""
    return f"""WITH {scored(d)}, t AS (SELECT stratum, id, card, floor(p * 7) AS guess, row_number() OVER (PARTITION BY stratum ORDER BY id) AS at_ FROM scored), b AS (SELECT {d.explode(d.seq(0, 40))} AS b),
    q AS (SELECT b, stratum, card, CASE WHEN b = 0 THEN at_ ELSE row_number() OVER (PARTITION BY b, stratum ORDER BY {draw(d, 'med', 'b', 'id')}, id) END AS at_ FROM b CROSS JOIN t),
    s AS (SELECT q.b, {d.pct('abs(t.guess - q.card)', '0.5e0')} AS med, avg(CASE WHEN t.guess = q.card THEN 1e0 ELSE 0e0 END) AS hits, avg(abs(t.guess - q.card)) AS mean FROM q JOIN t ON t.stratum = q.stratum AND t.at_ = q.at_ GROUP BY q.b), o AS (SELECT * FROM s WHERE b = 0)
    SELECT {r('max(o.med)')} AS median_error, {p_value('s.med <= o.med', 40)} AS median_p, {r('max(o.hits)')} AS hits, {p_value('s.hits >= o.hits - 1e-12', 40)} AS hits_p, {r('max(o.mean)')} AS mean_error, {p_value('s.mean <= o.mean + 1e-12', 40)} AS mean_p FROM s CROSS JOIN o WHERE s.b > 0"""


@Q("STAT-34")
def balanced_intervals(d):
    """Balanced accuracy, detection and false alarms, and the difference of medians between labels, with bootstrap intervals by stratum."""
    stat = f"({share('y = 1 AND p >= 0.5e0')} / nullif({share('y = 1')}, 0e0) + {share('y = 0 AND p < 0.5e0')} / nullif({share('y = 0')}, 0e0)) / 2e0"
    med = f"{d.pct('CASE WHEN y = 1 THEN p END', '0.5e0')} - {d.pct('CASE WHEN y = 0 THEN p END', '0.5e0')}"
    return f"""WITH {scored(d)}, k AS (SELECT stratum, y, p, row_number() OVER (PARTITION BY stratum ORDER BY id) - 1 AS pos, count(*) OVER (PARTITION BY stratum) AS m FROM scored WHERE stratum IS NOT NULL), {boots(d, 40)},
    g AS (SELECT b, stratum, {draw(d, 'bal', 'b', 'stratum', 'pos')} % m AS pick FROM b CROSS JOIN k), t AS (SELECT g.b, g.stratum, {stat} AS bal, {med} AS med FROM g JOIN k ON k.stratum = g.stratum AND k.pos = g.pick GROUP BY g.b, g.stratum),
    e AS (SELECT stratum, {ci(d, 'bal', 'balanced')}, {ci(d, 'med', 'median')} FROM t WHERE bal IS NOT NULL AND med IS NOT NULL GROUP BY stratum)
    SELECT k.stratum, count(*) AS n, {r(stat)} AS balanced, {r(share('y = 1 AND p >= 0.5e0') + f" / nullif({share('y = 1')}, 0e0)")} AS detection, {r(share('y = 0 AND p >= 0.5e0') + f" / nullif({share('y = 0')}, 0e0)")} AS false_alarms, max(balanced_lo) AS balanced_lo, max(balanced_hi) AS balanced_hi, max(median_lo) AS median_lo, max(median_hi) AS median_hi
    FROM k LEFT JOIN e ON e.stratum = k.stratum GROUP BY k.stratum"""


def tercile(x: str) -> str:
    return f"CASE WHEN {x} < -0.05e0 THEN 0 WHEN {x} > 0.05e0 THEN 2 ELSE 1 END"


def fields(d) -> str:
    """``code``: by concept and axis the field that is true (essence) and the one that is reported (function)."""
    arms = " UNION ALL ".join(f"SELECT id, '{a}' AS axis, {tercile(a)} AS gold, {tercile(b)} AS said FROM concepts" for a, b in zip(ESSENCE, FUNCTION))
    return f"{concepts(d)}, code AS ({arms})"


SHIFTS, STEP, BLOCK = 40, 7, 4096


def shifted_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, axis, hits, n): how often, of n concepts, a concept's true field is the one reported STEP * s places on, from blocks of the order of ids."""
    both = lambda axes: "array(" + ", ".join(map(tercile, axes)) + ")"
    c = rows(spark, sf_dir, f"WITH {concepts(SPARK)} SELECT id, {both(ESSENCE)} AS gold, {both(FUNCTION)} AS said FROM concepts WHERE id IS NOT NULL")
    n = c.count()
    at = ordered.row_numbers(c, ["id"], "pos").select((F.col("pos") - 1).alias("pos"), "gold", "said")
    # a row goes to the blocks whose rows look at it
    seen = F.transform(F.sequence(F.lit(0), F.lit(SHIFTS)), lambda s: F.floor(F.pmod(F.col("pos") - s * STEP, F.lit(max(1, n))) / BLOCK))

    def hits(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        pos, own = t.column("pos").to_numpy(), t.column("block")[0].as_py()
        gold, said = (np.array(t.column(k).to_pylist()) for k in ("gold", "said"))
        mine = np.flatnonzero(pos // BLOCK == own)
        out = [(gold[mine] == said[np.searchsorted(pos, (pos[mine] + STEP * s) % n)]).sum(axis=0) for s in range(SHIFTS + 1)]
        return pa.table({"s": np.repeat(np.arange(SHIFTS + 1), len(ESSENCE)), "axis": list(ESSENCE) * (SHIFTS + 1), "hits": np.concatenate(out)})

    got = at.withColumn("block", F.explode(F.array_distinct(seen))).groupBy("block").applyInArrow(hits, "s long, axis string, hits long")
    return got.groupBy("s", "axis").agg(F.sum("hits").alias("hits")).withColumn("n", F.lit(n))


@Q("STAT-35", shifted_agreement=shifted_agreement)
def derangement_null(d):
    """Agreement of codes, pooled and by axis, against cyclic derangements of the concepts."""
    if d.name == "spark":
        # whole counts to the end: a mean of shares would round by the order of its sum
        return f"""WITH u AS (SELECT s, axis, hits, n FROM shifted_agreement UNION ALL SELECT s, 'pooled', sum(hits), sum(n) FROM shifted_agreement GROUP BY s), o AS (SELECT axis, hits FROM u WHERE s = 0)
        SELECT u.axis, {r('max(o.hits) / CAST(max(n) AS DOUBLE)')} AS agreement, {r('sum(u.hits) / CAST(sum(n) AS DOUBLE)')} AS null_mean, {p_value('u.hits >= o.hits', SHIFTS)} AS p_value FROM u JOIN o ON o.axis = u.axis WHERE u.s > 0 GROUP BY u.axis"""
    return f"""WITH {fields(d)}, n AS (SELECT count(*) AS n FROM concepts), at_ AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos FROM concepts), c AS (SELECT pos, axis, gold, said FROM code JOIN at_ ON at_.id = code.id), s AS (SELECT {d.explode(d.seq(0, 40))} AS s),
    m AS (SELECT s.s, a.axis, avg(CASE WHEN a.gold = z.said THEN 1e0 ELSE 0e0 END) AS agree FROM c a CROSS JOIN s CROSS JOIN n JOIN c z ON z.axis = a.axis AND z.pos = (a.pos + s.s * 7) % n.n GROUP BY s.s, a.axis),
    u AS (SELECT s, axis, agree FROM m UNION ALL SELECT s, 'pooled', avg(agree) FROM m GROUP BY s), o AS (SELECT axis, agree FROM u WHERE s = 0)
    SELECT u.axis, {r('max(o.agree)')} AS agreement, {r('avg(u.agree)')} AS null_mean, {p_value('u.agree >= o.agree - 1e-12', 40)} AS p_value FROM u JOIN o ON o.axis = u.axis WHERE u.s > 0 GROUP BY u.axis"""


@Q("AGG-28")
def field_confusion(d):
    """Errors of reported fields by axis: to an adjacent tercile, to the opposite one, and which way."""
    return f"""WITH {fields(d)} SELECT axis, count(*) AS n, {n_if('gold = said')} AS right_, {n_if('abs(gold - said) = 1')} AS adjacent, {n_if('abs(gold - said) = 2')} AS opposite, {n_if('said > gold')} AS upward,
    {r(f"{n_if('abs(gold - said) = 2')} / nullif(CAST({n_if('gold <> said')} AS DOUBLE), 0e0)")} AS opposite_share FROM code GROUP BY axis"""


@Q("STAT-36")
def order_discrimination(d):
    """Whether pairs score higher in their own order than flipped, by sign-flips over pairs."""
    own, flip = (" + ".join(f"{x}.{a} * {y}.{b}" for a, b in zip(ESSENCE, FUNCTION)) for x, y in (("p", "q"), ("q", "p")))
    return f"""WITH {concepts(d)}, {relations(d)}, s AS (SELECT c1, c2, rel_type, ({own}) - ({flip}) AS diff FROM relations JOIN concepts p ON p.id = c1 JOIN concepts q ON q.id = c2), {boots(d, 100)},
    t AS (SELECT b, rel_type, sum(CASE WHEN {draw(d, 'order', 'b', 'c1', 'c2')} % 2 = 0 THEN diff ELSE -diff END) AS t FROM b CROSS JOIN s GROUP BY b, rel_type), o AS (SELECT rel_type, count(*) AS n, sum(diff) AS t, avg(CASE WHEN diff > 0 THEN 1e0 ELSE 0e0 END) AS own_share FROM s GROUP BY rel_type)
    SELECT o.rel_type, max(n) AS n, {r('max(own_share)')} AS own_share, {r('max(o.t)', 4)} AS observed, {p_value('t.t >= o.t', 100)} AS p_value FROM o JOIN t ON t.rel_type = o.rel_type GROUP BY o.rel_type"""


FLIPS = 99
#: Replicates of a block, and blocks at least, so that few replicates are spread too.
REPLICATES, LEAST_BLOCKS = 4096, 8


def ends(d) -> str:
    """``e``: the means of each replicate's first and last two turns."""
    return f"""{series(d)}, l AS (SELECT rep, max(turn) AS last FROM series GROUP BY rep), e AS (SELECT s.rep, s.rep % 7 AS g, avg(CASE WHEN turn < 2 THEN v END) AS base_, avg(CASE WHEN turn > last - 2 THEN v END) AS term FROM series s JOIN l ON l.rep = s.rep GROUP BY s.rep)"""


def pair_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over all pairs of replicates of two blocks, a line for every two blocks: (n, m, t, ...) of the distances of first and last turns, and ``flips``, t under each draw of signs."""
    e = rows(spark, sf_dir, f"WITH {ends(SPARK)} SELECT CAST(rep AS BIGINT) AS id, g, base_, term FROM e WHERE rep IS NOT NULL")
    e = keep(e, "ends")
    n = e.count()
    sums = "m s0 s1 s00 s11 s01 min0 max0 min1 max1 t inside n_inside across n_across".split()

    def both(i, x, tails, j):
        """The pairs of the replicate ``i`` with those of ``x`` from ``j`` on."""
        d0, d1 = np.abs(x["base_"][j:] - i["base_"]), np.abs(x["term"][j:] - i["term"])
        ok, known, same = ~np.isnan(d0 - d1), ~np.isnan(d1), x["g"][j:] == i["g"]
        diff, p, q, rest = np.where(ok, d0 - d1, 0.0), d0[ok], d1[ok], [d1[known & same], d1[known & ~same]]
        odd = np.concatenate([tails.odd([f"pair|{b}|{i['id']}|".encode() for b in range(10**k, min(10 ** (k + 1), FLIPS + 1))], j) for k in range(len(str(FLIPS)))])
        edge = [p.min(), p.max(), q.min(), q.max()] if len(p) else [np.inf, -np.inf] * 2
        t = diff.sum()
        return len(d0), np.array([len(p), p.sum(), q.sum(), p @ p, q @ q, p @ q, *edge, t, rest[0].sum(), len(rest[0]), rest[1].sum(), len(rest[1])]), t - 2 * (odd @ diff)

    def kernel(a: pa.Table, b: pa.Table) -> pa.Table:
        one, other = ({c: t.column(c).to_numpy(zero_copy_only=False) for c in ("id", "g", "base_", "term")} for t in (a.sort_by("id"), b.sort_by("id")))
        same = a.column("_s")[0].as_py() == b.column("_b")[0].as_py()
        pairs_, total, flips = 0, np.zeros(len(sums)), np.zeros(FLIPS)
        total[6:10] = [np.inf, -np.inf] * 2
        for x, y in ((one, other),) if same else ((one, other), (other, one)):  # the lesser replicate of a pair comes first
            tails = Tails([str(k).encode() for k in y["id"].tolist()])
            for k, j in enumerate(np.searchsorted(y["id"], x["id"], "right").tolist()):
                if j < len(y["id"]):
                    got = both({c: v[k] for c, v in x.items()}, y, tails, j)
                    low, high = np.minimum(total, got[1]), np.maximum(total, got[1])
                    pairs_, total, flips = pairs_ + got[0], total + got[1], flips + got[2]
                    total[6:10] = low[6], high[7], low[8], high[9]
        row = {"n": [pairs_], **{c: [v] for c, v in zip(sums, total.tolist())}, "flips": [flips.tolist() if total[0] else [None] * FLIPS]}
        if not total[0]:
            row["t"] = [None]
        return pa.table({k: pa.array(v, pa.int64() if k == "n" else pa.list_(pa.float64()) if k == "flips" else pa.float64()) for k, v in row.items()})

    schema = "n long, " + ", ".join(f"{c} double" for c in sums) + ", flips array<double>"
    return keep(pairs.meet(e, None, kernel, schema, max(min(LEAST_BLOCKS, n), -(-n // REPLICATES), 1)).where("n > 0"), "pair-sums")  # a line a pair of blocks


@Q("STAT-39", pair_sums=pair_sums)
def contraction(d):
    """Whether replicates draw together: distance of all pairs at their first turns against their last, by sign-flips; how the two are coupled, and spreads within and between groups."""
    if d.name == "spark":
        flat = "max(max0) = min(min0) OR max(max1) = min(min1)"
        cov = lambda a, b: f"(sum(s{a}{b}) - sum(s{a}) * sum(s{b}) / sum(m))"
        sums = f"""t AS (SELECT b, sum(t) AS t FROM (SELECT posexplode(flips) AS (b, t) FROM pair_sums) z GROUP BY b), o AS (SELECT CAST(sum(n) AS BIGINT) AS n, sum(t) AS t, CASE WHEN sum(m) = 0e0 THEN NULL WHEN {flat} THEN double('NaN') ELSE {cov(0, 1)} / nullif(sqrt({cov(0, 0)} * {cov(1, 1)}), 0e0) END AS coupling,
        sum(inside) / nullif(sum(n_inside), 0e0) AS inside, sum(across) / nullif(sum(n_across), 0e0) AS across FROM pair_sums)"""
    else:
        sums = f"""p AS (SELECT x.rep AS i, y.rep AS j, x.g = y.g AS same, abs(x.base_ - y.base_) AS d0, abs(x.term - y.term) AS d1 FROM e x JOIN e y ON y.rep > x.rep), {boots(d, FLIPS)},
        t AS (SELECT b, sum(CASE WHEN {draw(d, 'pair', 'b', 'i', 'j')} % 2 = 0 THEN d0 - d1 ELSE d1 - d0 END) AS t FROM b CROSS JOIN p GROUP BY b), o AS (SELECT count(*) AS n, sum(d0 - d1) AS t, corr(d0, d1) AS coupling, avg(CASE WHEN same THEN d1 END) AS inside, avg(CASE WHEN NOT same THEN d1 END) AS across FROM p)"""
    return f"""WITH {ends(d)}, {sums}, v AS (SELECT var_pop(base_) AS v0, var_pop(term) AS v1 FROM e)
    SELECT max(n) AS pairs, {r('max(o.t) / max(n)', 3)} AS contraction, {p_value('t.t >= o.t', FLIPS)} AS p_value, {r('max(coupling)')} AS coupling, {r('max(inside) / nullif(max(across), 0e0)')} AS separation, {r('max(v1) / nullif(max(v0), 0e0)')} AS dispersion FROM t CROSS JOIN o CROSS JOIN v"""


def solve3(a: list[list[str]], y: list[str]) -> list[str]:
    """Cramer's rule for three unknowns, as expressions."""
    det = lambda m: f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]}) + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))"
    put = lambda k: [[y[i] if j == k else a[i][j] for j in range(3)] for i in range(3)]
    return [f"{det(put(k))} / nullif({det(a)}, 0e0)" for k in range(3)]


@Q("STAT-41")
def split_fit(d):
    """Through-origin slope, and the joint fit of three parameters from sums; the slope's precision decides the reading."""
    x = ("q", "c", "t")
    sums = ", ".join([f"sum({a} * {b}) AS {a}{b}" for i, a in enumerate(x) for b in x[i:]] + [f"sum({a} * y) AS {a}y" for a in x] + ["sum(y * y) AS yy", "count(*) AS n"])
    s = lambda a, b: "".join(sorted((a, b), key=x.index))
    w = solve3([[s(a, b) for b in x] for a in x], [f"{a}y" for a in x])
    return f"""WITH t AS (SELECT l_returnflag AS part_, l_quantity / 50e0 AS q, l_discount * 10e0 AS c, l_tax * 10e0 AS t, l_extendedprice / 100000e0 AS y FROM lineitem), g AS (SELECT part_, {sums} FROM t GROUP BY part_),
    f AS (SELECT part_, n, qy / qq AS alone, {w[0]} AS w1, {w[1]} AS w2, {w[2]} AS w3, sqrt(greatest(0e0, (yy - qy * qy / qq) / (n - 1)) / qq) AS se FROM g)
    SELECT part_, n, {r('alone')} AS alone, {r('w1')} AS w1, {r('w2')} AS w2, {r('w3')} AS w3, {r('se')} AS se, CASE WHEN se > 0.1e0 THEN 'IMPRECISE' WHEN abs(w1 - alone) <= 2e0 * se THEN 'ONE SOURCE' ELSE 'SPLIT' END AS reading FROM f"""


@Q("STAT-40 STAT-42 STAT-68")
def movement_split(d):
    """Shares of content and label in a two-by-two movement, their interaction, the sham's ratio by offset class, and both against a floor, with bootstrap intervals by ratio of sums."""
    pick = lambda arm, pol: f"max(CASE WHEN arm = {arm} THEN v{pol} END)"
    return f"""WITH {cells(d)}, m AS (SELECT i, i % 4 AS off, {pick(A, 0)} AS tt, {pick(A, 1)} AS tp, {pick(B, 0)} AS pt, {pick(B, 1)} AS pp, {pick("'2-HIGH'", 0)} AS s0, {pick("'2-HIGH'", 1)} AS s1 FROM wide GROUP BY i),
    s AS (SELECT off, i, ((tt - pt) + (tp - pp)) / 2e0 AS c, ((tt - tp) + (pt - pp)) / 2e0 AS l, tt - tp - pt + pp AS k, s0 - s1 AS sham FROM m WHERE tt IS NOT NULL AND tp IS NOT NULL AND pt IS NOT NULL AND pp IS NOT NULL AND s0 IS NOT NULL AND s1 IS NOT NULL),
    z AS (SELECT *, row_number() OVER (PARTITION BY off ORDER BY i) - 1 AS pos, count(*) OVER (PARTITION BY off) AS m FROM s), {boots(d, 60)}, g AS (SELECT b, off, {draw(d, 'move', 'b', 'i')} % m AS pick FROM b CROSS JOIN z),
    t AS (SELECT g.b, g.off, sum(c * c) / nullif(sum(c * c) + sum(l * l), 0e0) AS w FROM g JOIN z ON z.off = g.off AND z.pos = g.pick GROUP BY g.b, g.off), e AS (SELECT off, {ci(d, 'w', 'content')} FROM t GROUP BY off),
    o AS (SELECT off, count(*) AS n, sum(c * c) / (sum(c * c) + sum(l * l)) AS w, sum(l * l) / (sum(c * c) + sum(l * l)) AS lab, avg(k) AS k, sum(abs(sham)) / nullif(sum(abs(l)), 0e0) AS ratio FROM s GROUP BY off)
    SELECT o.off, n, {r('w')} AS content, {r('lab')} AS label, {r('k', 2)} AS interaction, {r('ratio')} AS sham_ratio, ratio >= 0.5e0 AS at_floor, content_lo, content_hi, CASE WHEN content_lo > 0.5e0 THEN 'CONTENT' WHEN content_hi < 0.5e0 THEN 'LABEL' ELSE 'MIXED' END AS reading FROM o JOIN e ON e.off = o.off"""


@Q("STAT-44 STAT-43")
def capability_gate(d):
    """Bootstrap interval of each group's mean; groups that pass the gate are read against chance."""
    return f"""WITH {scored(d)}, k AS (SELECT grp, y, row_number() OVER (PARTITION BY grp ORDER BY id) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS m FROM scored), {boots(d, 40)}, g AS (SELECT b, grp, {draw(d, 'gate', 'b', 'grp', 'pos')} % m AS pick FROM b CROSS JOIN k),
    t AS (SELECT g.b, g.grp, avg(CAST(y AS DOUBLE)) AS mean FROM g JOIN k ON k.grp = g.grp AND k.pos = g.pick GROUP BY g.b, g.grp), e AS (SELECT grp, {d.pct('mean', '0.025e0')} AS lo, {d.pct('mean', '0.975e0')} AS hi FROM t GROUP BY grp),
    o AS (SELECT grp, count(*) AS n, avg(CAST(y AS DOUBLE)) AS mean, {share('p >= 0.2e0')} AS capable FROM scored GROUP BY grp)
    SELECT o.grp, n, {r('mean')} AS mean, {r('lo')} AS lo, {r('hi')} AS hi, capable >= 0.5e0 AS gate, CASE WHEN capable < 0.5e0 THEN 'NOT READ' WHEN lo > 0.5e0 THEN 'CARRIES' WHEN hi <= 0.6e0 AND lo <= 0.5e0 THEN 'AT CHANCE' ELSE 'UNCLEAR' END AS reading FROM o JOIN e ON e.grp = o.grp"""


@Q("STAT-45")
def cross_study_difference(d):
    """Differences between two studies that share no items: unpaired bootstrap of both sides."""
    return f"""WITH {cells(d)}, k AS (SELECT arm, pol, v, row_number() OVER (PARTITION BY arm, pol ORDER BY i) - 1 AS pos, count(*) OVER (PARTITION BY arm, pol) AS m FROM cells), {boots(d, 100)}, g AS (SELECT b, arm, pol, {draw(d, 'study', 'b', 'arm', 'pol', 'pos')} % m AS pick FROM b CROSS JOIN k),
    t AS (SELECT g.b, g.arm, g.pol, avg(v) AS mean FROM g JOIN k ON k.arm = g.arm AND k.pol = g.pol AND k.pos = g.pick GROUP BY g.b, g.arm, g.pol), x AS (SELECT b, arm, max(CASE WHEN pol = 0 THEN mean END) - max(CASE WHEN pol = 1 THEN mean END) AS diff FROM t GROUP BY b, arm),
    o AS (SELECT arm, avg(CASE WHEN pol = 0 THEN v END) - avg(CASE WHEN pol = 1 THEN v END) AS diff FROM cells GROUP BY arm)
    SELECT o.arm, {r('max(o.diff)', 2)} AS diff, {r(d.pct('x.diff', '0.025e0'), 2)} AS lo, {r(d.pct('x.diff', '0.975e0'), 2)} AS hi FROM o JOIN x ON x.arm = o.arm GROUP BY o.arm"""


@Q("STAT-47")
def convergence_null(d):
    """Share of axes on which families converge, and the tallest axis, against draws that keep each family's number of axes."""
    return f"""WITH {raters(d)}, f AS (SELECT DISTINCT fam, a AS axis FROM raters WHERE kind = 'R' AND b % 10 = a % 10), k AS (SELECT fam, count(*) AS k FROM f GROUP BY fam), axes AS (SELECT DISTINCT axis FROM f), b AS (SELECT {d.explode(d.seq(0, 60))} AS b),
    q AS (SELECT b, k.fam, axis, k.k, row_number() OVER (PARTITION BY b, k.fam ORDER BY {draw(d, 'axis', 'b', 'k.fam', 'axis')}, axis) AS place FROM b CROSS JOIN k CROSS JOIN axes WHERE b > 0),
    u AS (SELECT 0 AS b, fam, axis FROM f UNION ALL SELECT b, fam, axis FROM q WHERE place <= k), g AS (SELECT b, axis, count(*) AS fams FROM u GROUP BY b, axis),
    s AS (SELECT b, sum(CASE WHEN fams >= 4 THEN fams ELSE 0 END) / CAST(sum(fams) AS DOUBLE) AS share_, max(fams) AS tower FROM g GROUP BY b), o AS (SELECT * FROM s WHERE b = 0)
    SELECT {r('max(o.share_)')} AS converged, {r('avg(s.share_)')} AS null_mean, {r(d.pct('s.share_', '0.95e0'))} AS null_p95, {p_value('s.share_ >= o.share_ - 1e-12', 60)} AS p_value, max(o.tower) AS tower, {p_value('s.tower >= o.tower', 60)} AS tower_p FROM s CROSS JOIN o WHERE s.b > 0"""


@Q("STAT-49")
def baseline_signflip(d):
    """Arms against a baseline pinned to the first arm's clusters, by paired sign-flips, with reading rules."""
    return f"""WITH {cells(d)}, base_ AS (SELECT i, v FROM wide WHERE arm = {A}), p AS (SELECT w.arm, w.i, w.v - base_.v AS diff FROM wide w JOIN base_ ON base_.i = w.i WHERE w.arm <> {A}), {boots(d, 200)},
    t AS (SELECT b, arm, avg(CASE WHEN {draw(d, 'base', 'b', 'i')} % 2 = 0 THEN diff ELSE -diff END) AS t FROM b CROSS JOIN p GROUP BY b, arm), o AS (SELECT arm, count(*) AS n, avg(diff) AS t FROM p GROUP BY arm), z AS (SELECT o.arm, max(n) AS n, max(o.t) AS t, (1e0 + {n_if('abs(t.t) >= abs(o.t)')}) / 201e0 AS p FROM o JOIN t ON t.arm = o.arm GROUP BY o.arm)
    SELECT arm, n, {r('t', 2)} AS diff, {r('p')} AS p_value, CASE WHEN p <= 0.05e0 AND t > 0 THEN 'ABOVE' WHEN p <= 0.05e0 THEN 'BELOW' WHEN p <= 0.2e0 THEN 'OPEN' ELSE 'NO DIFFERENCE' END AS reading FROM z"""


@Q("STAT-05 STAT-73 STAT-69")
def holm_stepdown(d):
    """Sign-flip p-values of all arms under three forms of Holm (step-down thresholds, fixed .05, adjusted values); arms behind the second wait for it; the stage's verdict is one of three forks."""
    return f"""WITH {cells(d)}, p0 AS (SELECT arm, i, v0 - v1 AS diff FROM wide WHERE v0 IS NOT NULL AND v1 IS NOT NULL), {boots(d, 200)}, t AS (SELECT b, arm, sum(CASE WHEN {draw(d, 'holm', 'b', 'i')} % 2 = 0 THEN diff ELSE -diff END) AS t FROM b CROSS JOIN p0 GROUP BY b, arm),
    o AS (SELECT arm, sum(diff) AS t FROM p0 GROUP BY arm), pv AS (SELECT o.arm AS name, (1e0 + {n_if('t.t >= o.t')}) / 201e0 AS p FROM o JOIN t ON t.arm = o.arm GROUP BY o.arm),
    k AS (SELECT *, row_number() OVER (ORDER BY p, name) AS i, count(*) OVER () AS m FROM pv), a AS (SELECT *, least(1e0, max(p * (m - i + 1)) OVER (ORDER BY i)) AS adj, max(CASE WHEN p > 0.05e0 / (m - i + 1) THEN 1 ELSE 0 END) OVER (ORDER BY i) AS failed FROM k),
    gate AS (SELECT max(CASE WHEN name = '2-HIGH' THEN adj END) AS second_, {n_if('adj <= 0.05e0')} AS moved FROM a)
    SELECT name, {r('p')} AS p, {r('adj')} AS adjusted, failed = 0 AS step_down, adj <= 0.05e0 AS fixed_, CASE WHEN name > '2-HIGH' AND second_ > 0.05e0 THEN 'not judged' WHEN adj <= 0.05e0 THEN 'moves' ELSE 'holds' END AS verdict, CASE WHEN adj <= 0.05e0 THEN 'moves' ELSE 'holds' END AS kept_aside,
    CASE WHEN moved = 0 THEN 'STOP' WHEN second_ <= 0.05e0 THEN 'GO' ELSE 'FORK' END AS stage FROM a CROSS JOIN gate"""


@Q("STAT-16 STAT-58")
def cluster_bootstrap(d):
    """Several statistics of paired presentations by source, resampled together by cluster: mean, contrast, spread and correlation."""
    return f"""WITH {cells(d)}, p AS (SELECT x.i, x.v AS a, y.v AS b_, x.v0 AS a0, x.v1 AS a1 FROM wide x JOIN wide y ON y.i = x.i WHERE x.arm = {A} AND y.arm = {B} AND x.v0 IS NOT NULL AND x.v1 IS NOT NULL), k AS (SELECT *, row_number() OVER (ORDER BY i) - 1 AS pos, count(*) OVER () AS m FROM p), {boots(d, 200)},
    g AS (SELECT b, {draw(d, 'many', 'b', 'pos')} % m AS pick FROM b CROSS JOIN k), t AS (SELECT g.b, avg(a) AS mean, avg(a - b_) AS contrast, stddev_pop(a - b_) AS spread, corr(a0, a1) AS rho FROM g JOIN k ON k.pos = g.pick GROUP BY g.b),
    o AS (SELECT count(*) AS n, avg(a) AS mean, avg(a - b_) AS contrast, stddev_pop(a - b_) AS spread, corr(a0, a1) AS rho FROM p)
    SELECT max(n) AS n, {', '.join(f"{r(f'max(o.{s})', 4)} AS {s}, {r(d.pct(f't.{s}', '0.025e0'), 4)} AS {s}_lo, {r(d.pct(f't.{s}', '0.975e0'), 4)} AS {s}_hi" for s in ('mean', 'contrast', 'spread', 'rho'))} FROM t CROSS JOIN o"""


@Q("STAT-18 STAT-60")
def table_agreement(d):
    """Two centred tables: their correlation, the mean rank correlation of columns, the share of columns with the same top row (ties shared), and its tier above a floor."""
    c = lambda x: f"{x} - avg({x}) OVER (PARTITION BY row_) - avg({x}) OVER (PARTITION BY col_) + avg({x}) OVER ()"
    return f"""WITH {matrix(d)}, c AS (SELECT row_, col_, {c('v')} AS cv, {c('n')} AS cn FROM mat), k AS (SELECT *, {avg_rank('cv', 'col_')} AS rv, {avg_rank('cn', 'col_')} AS rn, rank() OVER (PARTITION BY col_ ORDER BY cv DESC) AS tv, rank() OVER (PARTITION BY col_ ORDER BY cn DESC) AS tn FROM c),
    s AS (SELECT col_, corr(rv, rn) AS rho, max(CASE WHEN tv = 1 AND tn = 1 THEN 1e0 ELSE 0e0 END) / sum(CASE WHEN tv = 1 THEN 1e0 ELSE 0e0 END) AS top FROM k GROUP BY col_), g AS (SELECT corr(cv, cn) AS all_ FROM c)
    SELECT {r('max(all_)')} AS rho, {r('avg(rho)')} AS column_rho, {r('avg(top)')} AS top_match, count(*) AS columns_, CASE WHEN max(all_) < 0.2e0 THEN 'FLOOR' WHEN max(all_) < 0.5e0 THEN 'PART' WHEN max(all_) < 0.8e0 THEN 'MOST' ELSE 'SAME' END AS tier FROM s CROSS JOIN g"""


@Q("STAT-20")
def shared_null(d):
    """One set of label permutations for three statistics: difference of means, of medians, and the correlation."""
    stats = f"avg(CASE WHEN y = 1 THEN p END) - avg(CASE WHEN y = 0 THEN p END) AS mean, {d.pct('CASE WHEN y = 1 THEN p END', '0.5e0')} - {d.pct('CASE WHEN y = 0 THEN p END', '0.5e0')} AS median_, corr(CAST(y AS DOUBLE), p) AS rho"
    return f"""WITH {scored(d)}, t AS (SELECT id, y, p, row_number() OVER (PARTITION BY stratum ORDER BY id) AS at_, stratum FROM scored), b AS (SELECT {d.explode(d.seq(0, 40))} AS b),
    q AS (SELECT b, stratum, p, CASE WHEN b = 0 THEN at_ ELSE row_number() OVER (PARTITION BY b, stratum ORDER BY {draw(d, 'shared', 'b', 'id')}, id) END AS at_ FROM b CROSS JOIN t), s AS (SELECT q.b, {stats.replace('THEN p', 'THEN q.p').replace(', p)', ', q.p)')} FROM q JOIN t ON t.stratum = q.stratum AND t.at_ = q.at_ GROUP BY q.b), o AS (SELECT * FROM s WHERE b = 0)
    SELECT {', '.join(f"{r(f'max(o.{x})')} AS {x}, {p_value(f'abs(s.{x}) >= abs(o.{x}) - 1e-12', 40)} AS {x}_p" for x in ('mean', 'median_', 'rho'))} FROM s CROSS JOIN o WHERE s.b > 0"""


@Q("STAT-21")
def two_source_weights(d):
    """Least-squares weights of two sources, the share lost when one is dropped, and intervals over columns drawn again."""
    w = lambda p="": (f"(sum({p}ay) * sum({p}bb) - sum({p}by_) * sum({p}ab)) / nullif(sum({p}aa) * sum({p}bb) - sum({p}ab) * sum({p}ab), 0e0)", f"(sum({p}by_) * sum({p}aa) - sum({p}ay) * sum({p}ab)) / nullif(sum({p}aa) * sum({p}bb) - sum({p}ab) * sum({p}ab), 0e0)")
    return f"""WITH t AS (SELECT l_suppkey % 24 AS col_, l_quantity AS a, l_discount * 100 AS b, l_extendedprice / 1000e0 AS y FROM lineitem), s AS (SELECT col_, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab, sum(a * y) AS ay, sum(b * y) AS by_, sum(y * y) AS yy FROM t GROUP BY col_),
    k AS (SELECT *, row_number() OVER (ORDER BY col_) - 1 AS pos, count(*) OVER () AS m FROM s), {boots(d, 200)}, g AS (SELECT b, {draw(d, 'cols', 'b', 'pos')} % m AS pick FROM b CROSS JOIN k), z AS (SELECT g.b, {w()[0]} AS wa, {w()[1]} AS wb FROM g JOIN k ON k.pos = g.pick GROUP BY g.b),
    e AS (SELECT {ci(d, 'wa', 'wa')}, {ci(d, 'wb', 'wb')} FROM z), o AS (SELECT {w()[0]} AS wa, {w()[1]} AS wb, sum(ay) / sum(aa) AS alone, sum(ay) AS say, sum(by_) AS sby, sum(aa) AS saa, sum(yy) AS syy FROM s)
    SELECT {r('wa')} AS wa, {r('wb')} AS wb, {r('alone')} AS alone, {r('(syy - say * say / saa) / nullif(syy - wa * say - wb * sby, 0e0) - 1e0')} AS drop_share, wa_lo, wa_hi, wb_lo, wb_hi FROM o CROSS JOIN e"""


@Q("STAT-24")
def ladder_slopes(d):
    """Slopes of each strand's ladder, real (first polarity) against sham (second), and the difference over all strands by sign-flips."""
    return f"""WITH m AS (SELECT o_orderpriority AS strand, o_custkey % 8 AS part_, o_orderkey % 2 AS pol, year(o_orderdate) AS k, avg(o_totalprice) AS v FROM orders GROUP BY o_orderpriority, o_custkey % 8, o_orderkey % 2, year(o_orderdate)),
    s AS (SELECT strand, part_, regr_slope(CASE WHEN pol = 0 THEN v END, CASE WHEN pol = 0 THEN CAST(k AS DOUBLE) END) AS real_, regr_slope(CASE WHEN pol = 1 THEN v END, CASE WHEN pol = 1 THEN CAST(k AS DOUBLE) END) AS sham FROM m GROUP BY strand, part_), {boots(d, 200)},
    t AS (SELECT b, avg(CASE WHEN {draw(d, 'slope', 'b', 'strand', 'part_')} % 2 = 0 THEN real_ - sham ELSE sham - real_ END) AS t FROM b CROSS JOIN s GROUP BY b), o AS (SELECT avg(real_ - sham) AS t FROM s), p AS (SELECT max(o.t) AS t, {p_value('t.t >= o.t', 200)} AS p FROM t CROSS JOIN o)
    SELECT strand, part_, {r('real_', 3)} AS real_slope, {r('sham', 3)} AS sham_slope, {r('real_ - sham', 3)} AS diff, {r('t', 3)} AS mean_diff, p AS p_value FROM s CROSS JOIN p"""


@Q("STAT-53")
def hold_primaries(d):
    """Three clauses over the cells of acts and holds: acts where the best is to act, none where cells are empty, and fewer as costs rise."""
    return f"""WITH {runlog(d)}, c AS (SELECT user_id % 12 AS ladder, attempt % 10 AS rung, CAST(power(3, user_id % 3) AS BIGINT) AS cost, avg(CASE WHEN status = 'ok' THEN 1e0 ELSE 0e0 END) AS act, count(*) AS n FROM runlog GROUP BY user_id % 12, attempt % 10, CAST(power(3, user_id % 3) AS BIGINT)),
    s AS (SELECT ladder, avg(CASE WHEN rung >= 5 THEN act END) AS best, avg(CASE WHEN rung = 0 THEN act END) AS empty_, regr_slope(act, CAST(rung AS DOUBLE)) AS rise, avg(CASE WHEN cost = 1 THEN act END) AS cheap, avg(CASE WHEN cost = 9 THEN act END) AS dear, sum(n) AS n FROM c GROUP BY ladder)
    SELECT ladder, CAST(n AS BIGINT) AS n, {r('best')} AS act_when_best, {r('empty_')} AS act_when_empty, {r('rise')} AS rise, coalesce(best >= 0.5e0, false) AS clause_1, coalesce(empty_ <= 0.5e0, false) AS clause_2, cheap IS NULL OR dear IS NULL OR cheap >= dear AS clause_3 FROM s"""


@Q("STAT-54")
def rung_differences(d):
    """Named against walked at each rung, with a bootstrap interval and an equivalence band."""
    return f"""WITH o AS (SELECT year(o_orderdate) AS rung, o_custkey % 30 AS cl, avg(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END) - avg(CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice END) AS diff FROM orders GROUP BY year(o_orderdate), o_custkey % 30),
    k AS (SELECT rung, diff, row_number() OVER (PARTITION BY rung ORDER BY cl) - 1 AS pos, count(*) OVER (PARTITION BY rung) AS m FROM o WHERE diff IS NOT NULL), {boots(d, 80)}, g AS (SELECT b, rung, {draw(d, 'rung', 'b', 'rung', 'pos')} % m AS pick FROM b CROSS JOIN k),
    t AS (SELECT g.b, g.rung, avg(diff) AS diff FROM g JOIN k ON k.rung = g.rung AND k.pos = g.pick GROUP BY g.b, g.rung), e AS (SELECT rung, {d.pct('diff', '0.025e0')} AS lo, {d.pct('diff', '0.975e0')} AS hi FROM t GROUP BY rung), a AS (SELECT rung, avg(diff) AS diff FROM k GROUP BY rung)
    SELECT CAST(a.rung AS BIGINT) AS rung, {r('diff', 2)} AS diff, {r('lo', 2)} AS lo, {r('hi', 2)} AS hi, CASE WHEN lo > -20000e0 AND hi < 20000e0 THEN 'EQUIVALENT' WHEN lo > 0e0 OR hi < 0e0 THEN 'DIFFERENT' ELSE 'UNCLEAR' END AS reading FROM a JOIN e ON e.rung = a.rung"""


@Q("STAT-55")
def path_effect(d):
    """Total variation between histories that lead to one request, over the floor of identical requests repeated."""
    tv = lambda on: f"SELECT a.q, 1e0 - sum(least(a.p, z.p)) AS tv FROM t a JOIN t z ON z.q = a.q AND z.v = a.v AND {on} GROUP BY a.q"
    return f"""WITH c AS (SELECT c_nationkey AS q, CASE WHEN c_custkey % 4 < 2 THEN 'history' ELSE 'cold' END AS path_, c_custkey % 2 AS rep, c_mktsegment AS v, count(*) AS n FROM customer GROUP BY c_nationkey, CASE WHEN c_custkey % 4 < 2 THEN 'history' ELSE 'cold' END, c_custkey % 2, c_mktsegment),
    t AS (SELECT q, path_, rep, v, n / CAST(sum(n) OVER (PARTITION BY q, path_, rep) AS DOUBLE) AS p FROM c), e AS ({tv("a.path_ = 'history' AND z.path_ = 'cold' AND a.rep = z.rep AND a.rep = 0")}), f AS ({tv("a.path_ = z.path_ AND a.path_ = 'cold' AND a.rep = 0 AND z.rep = 1")})
    SELECT e.q, {r('e.tv')} AS effect, {r('f.tv')} AS floor_, {r('e.tv - f.tv')} AS over_floor FROM e JOIN f ON f.q = e.q"""


@Q("STAT-56 STAT-59")
def bar_primaries(d):
    """Readings of each subset against a reference bar, in the order of the branches, by a first and a second reader of the same items."""
    return f"""WITH {scored(d)}, m AS (SELECT grp, stratum, CAST(y AS DOUBLE) AS first_, CASE WHEN p >= 0.3e0 THEN 1e0 ELSE 0e0 END AS second_ FROM scored), u AS (SELECT 'all' AS subset_, first_, second_ FROM m UNION ALL SELECT concat('group ', grp), first_, second_ FROM m UNION ALL SELECT concat('stratum ', stratum), first_, second_ FROM m WHERE stratum IS NOT NULL),
    s AS (SELECT subset_, count(*) AS n, avg(first_) AS f, avg(second_) AS s, avg(CASE WHEN first_ = second_ THEN 1e0 ELSE 0e0 END) AS agree, stddev_pop(first_) / sqrt(count(*)) AS se FROM u GROUP BY subset_)
    SELECT subset_, n, {r('f')} AS first_reader, {r('s')} AS second_reader, {r('agree')} AS agreement, CASE WHEN n < 20 THEN 'TOO FEW' WHEN f + 1.96e0 * se <= 0.6e0 THEN 'UNDER BAR' WHEN f - 1.96e0 * se > 0.6e0 AND s > 0.6e0 THEN 'BOTH OVER' WHEN f - 1.96e0 * se > 0.6e0 THEN 'FIRST OVER' ELSE 'UNCLEAR' END AS branch FROM s"""


@Q("STAT-57")
def presence_rows(d):
    """By dose: reports of presence, the AUROC of each dose against none, how often the dose whose mean is nearest is a row's own, and whether both halves of the rows report on the same side of a half."""
    return f"""WITH {scored(d)}, t AS (SELECT id, card AS dose, p, y, id % 2 AS half FROM scored), base_ AS (SELECT p FROM t WHERE dose = 0),
    a AS (SELECT t.dose, avg(z.below / CAST(z.n AS DOUBLE) + z.ties / (2e0 * z.n)) AS auroc FROM t JOIN (SELECT q.p, sum(CASE WHEN base_.p < q.p THEN 1 ELSE 0 END) AS below, sum(CASE WHEN base_.p = q.p THEN 1 ELSE 0 END) AS ties, count(*) AS n FROM (SELECT DISTINCT p FROM t) q CROSS JOIN base_ GROUP BY q.p) z ON z.p = t.p GROUP BY t.dose),
    mean_ AS (SELECT dose AS name_, avg(p) AS m FROM t GROUP BY dose), near AS (SELECT id, dose, name_, row_number() OVER (PARTITION BY id ORDER BY round(abs(p - m), 12), name_) AS place FROM t CROSS JOIN mean_),
    own AS (SELECT dose, {share('name_ = dose')} AS nearest_share FROM near WHERE place = 1 GROUP BY dose), h AS (SELECT dose, avg(CASE WHEN half = 0 THEN CAST(y AS DOUBLE) END) AS h0, avg(CASE WHEN half = 1 THEN CAST(y AS DOUBLE) END) AS h1 FROM t GROUP BY dose)
    SELECT t.dose, count(*) AS n, {r('avg(CAST(y AS DOUBLE))')} AS present_, {r('max(auroc)')} AS auroc, {r('max(nearest_share)')} AS nearest_share, {r('max(h0 - h1)')} AS half_diff, max(CASE WHEN (h0 > 0.5e0) = (h1 > 0.5e0) THEN 1 ELSE 0 END) = 1 AS halves_agree
    FROM t JOIN a ON a.dose = t.dose JOIN own ON own.dose = t.dose JOIN h ON h.dose = t.dose GROUP BY t.dose"""


@Q("STAT-61")
def secondaries(d):
    """One measure under several readings: like for like, by choice, by wording, by nation and by sham, each beside the primary."""
    base = "SELECT 'primary' AS kind, '' AS level_, v0 - v1 AS diff FROM wide WHERE v0 IS NOT NULL AND v1 IS NOT NULL"
    return f"""WITH {cells(d)}, u AS ({base} UNION ALL SELECT 'like for like', arm, v0 - v1 FROM wide WHERE v0 IS NOT NULL AND v1 IS NOT NULL AND n >= 4 UNION ALL SELECT 'choice', CASE WHEN i % 2 = 0 THEN 'asked first' ELSE 'asked second' END, v0 - v1 FROM wide WHERE v0 IS NOT NULL AND v1 IS NOT NULL
      UNION ALL SELECT 'nation', CAST(i % 5 AS STRING), v0 - v1 FROM wide WHERE v0 IS NOT NULL AND v1 IS NOT NULL UNION ALL SELECT 'sham', arm, CASE WHEN i % 2 = 0 THEN v0 - v1 ELSE v1 - v0 END FROM wide WHERE v0 IS NOT NULL AND v1 IS NOT NULL)
    SELECT kind, level_, count(*) AS n, {r('avg(diff)', 3)} AS mean, {r('stddev_pop(diff) / sqrt(count(*))', 3)} AS se, {r(share('diff > 0'))} AS positive FROM u GROUP BY kind, level_"""


@Q("STAT-65")
def bar_cards(d):
    """Features of a bar and its card under two rules: the largest share, and the first share over a half."""
    return f"""WITH {concepts(d)}, t AS (SELECT id, {', '.join(f'abs({k}) / (abs(x) + abs(y) + abs(z) + 1e-12) AS s{k}' for k in CORE)} FROM concepts)
    SELECT id, {', '.join(r(f's{k}') + f' AS share_{k}' for k in CORE)}, {r('sx * sx + sy * sy + sz * sz')} AS peak, CASE WHEN sx >= sy AND sx >= sz THEN 'x' WHEN sy >= sz THEN 'y' ELSE 'z' END AS largest, CASE WHEN sx > 0.5e0 THEN 'x' WHEN sy > 0.5e0 THEN 'y' WHEN sz > 0.5e0 THEN 'z' ELSE 'none' END AS over_half FROM t"""


@Q("STAT-67")
def stimuli(d):
    """Stimuli by hash: Gaussian arrays (sums of twelve draws), candidates a stated distance apart, ladders of evidence, and how far the halves of an array agree over all of them."""
    gauss = " + ".join(d.rand(f"concat('g{i}|', CAST(k AS STRING), '|', CAST(j AS STRING))") for i in range(12))
    return f"""WITH s AS (SELECT s_suppkey AS k FROM supplier), j AS (SELECT {d.explode(d.seq(0, 7))} AS j), g AS (SELECT k, j, ({gauss}) - 6e0 + (k % 7 - 3) / 3e0 AS v FROM s CROSS JOIN j),
    a AS (SELECT k, avg(v) AS mean, stddev_pop(v) AS sd, sum(CASE WHEN v > 0 THEN 1 ELSE 0 END) AS positive, avg(CASE WHEN j % 2 = 0 THEN v END) AS even_, avg(CASE WHEN j % 2 = 1 THEN v END) AS odd_ FROM g GROUP BY k),
    near AS (SELECT x.k, min(abs(x.mean - y.mean)) AS gap FROM a x JOIN a y ON y.k <> x.k AND y.k % 3 = x.k % 3 GROUP BY x.k), rel AS (SELECT corr(even_, odd_) AS c FROM a)
    SELECT a.k, {r('mean')} AS mean, {r('sd')} AS sd, CAST(positive AS BIGINT) AS rung, {r('gap')} AS gap, gap >= 0.05e0 AS apart, {r('2e0 * c / (1e0 + c)')} AS reliability FROM a JOIN near ON near.k = a.k CROSS JOIN rel"""


@Q("STAT-70 STAT-74")
def integrity_gates(d):
    """Gates over tables: keys that no plan row has, captures that are complete, norms of unit vectors, a direction whose halves have one sign, pinned row counts, rows present by model; reasons of each failed gate."""
    unit = " + ".join(f"({k} / sqrt({dot('', '', ESSENCE + FUNCTION)})) * ({k} / sqrt({dot('', '', ESSENCE + FUNCTION)}))" for k in ESSENCE + FUNCTION)
    half = lambda n: ", ".join(f"avg(CASE WHEN c1 % 2 = {n} THEN q.{k} - p.{k} END) AS {k}{n}" for k in ESSENCE)
    along = lambda a, b: " + ".join(f"{k}{a} * {k}{b}" for k in ESSENCE)
    return f"""WITH {concepts(d)}, {relations(d)}, g AS (SELECT 'order keys' AS gate, CAST(count(*) AS DOUBLE) AS value, 0e0 AS least, 0e0 AS most FROM lineitem l LEFT JOIN orders o ON o_orderkey = l_orderkey WHERE o_orderkey IS NULL
      UNION ALL SELECT 'unit norms', max(abs({unit} - 1e0)), 0e0, 1e-9 FROM concepts WHERE {dot('', '', ESSENCE + FUNCTION)} > 0e0 UNION ALL SELECT 'edges of each concept', CAST(min(n) AS DOUBLE), 1e0, 1e9 FROM (SELECT me, count(*) AS n FROM (SELECT c1 AS me FROM relations UNION ALL SELECT c2 FROM relations) z GROUP BY me) y
      UNION ALL SELECT 'cents', max(abs(l_extendedprice * 100 - round(l_extendedprice * 100))), 0e0, 1e-3 FROM lineitem UNION ALL SELECT 'turns in a row', CAST(max(last_ + 1 - n) AS DOUBLE), 0e0, 0e0 FROM (SELECT conv_id, max(turn) AS last_, count(*) AS n FROM conversations GROUP BY conv_id) x
      UNION ALL SELECT concat('rows of ', coalesce(lang, 'no language')), CAST(count(*) AS DOUBLE), 10e0, 1e18 FROM documents GROUP BY lang UNION ALL SELECT 'pinned regions', CAST(count(*) AS DOUBLE), 5e0, 5e0 FROM region UNION ALL SELECT 'pinned nations', CAST(count(*) AS DOUBLE), 25e0, 25e0 FROM nation
      UNION ALL SELECT 'direction of both halves', ({along(0, 1)}) / nullif(sqrt({along(0, 0)}) * sqrt({along(1, 1)}), 0e0), 0e0, 1e0 FROM (SELECT {half(0)}, {half(1)} FROM relations JOIN concepts p ON p.id = c1 JOIN concepts q ON q.id = c2) dir_)
    SELECT gate, {r('value', 3)} AS value, value BETWEEN least AND most AS passed, CASE WHEN value < least THEN concat(gate, ': too low') WHEN value > most THEN concat(gate, ': too high') ELSE '' END AS reason FROM g"""


@Q("STAT-72 SET-07")
def disjoint_split(d):
    """Pairs split by held words: both ends held, one held, or neither (training); held words are drawn under exclusion of the class of their partner, and pins are deranged."""
    held = lambda x: f"{draw(d, 'held', x)} % 5 = 0"
    return f"""WITH {concepts(d)}, {relations(d)}, {undirected(d)}, ok AS (SELECT c.id FROM concepts c JOIN und u ON u.me = c.id JOIN concepts o ON o.id = u.other GROUP BY c.id HAVING min(CASE WHEN o.trigram = c.trigram THEN 1 ELSE 0 END) = 0), held AS (SELECT id FROM ok WHERE {held('id')}), n AS (SELECT count(*) AS n FROM held),
    pin AS (SELECT h.id, row_number() OVER (ORDER BY h.id) - 1 AS pos FROM held h), dr AS (SELECT a.id, z.id AS pinned FROM pin a CROSS JOIN n JOIN pin z ON z.pos = (a.pos + 1) % n)
    SELECT c1, c2, rel_type, CASE WHEN a.id IS NOT NULL AND z.id IS NOT NULL THEN 'both held' WHEN a.id IS NOT NULL OR z.id IS NOT NULL THEN 'any held' ELSE 'train' END AS part_, a.pinned AS pin1, z.pinned AS pin2 FROM relations LEFT JOIN dr a ON a.id = c1 LEFT JOIN dr z ON z.id = c2"""


def shuffled_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(b, s1, s2, ones, n): for each draw the sums of both scores' ranks over the rows of label 1, their number and that of all."""
    t = rows(spark, sf_dir, f"WITH {scored(SPARK)} SELECT id, stratum, y, p, p + (toxic + 1) * card / 7e0 AS both_ FROM scored")
    t = ordered.mean_ranks(ordered.mean_ranks(t, [], "p", "r1"), [], "both_", "r2").where("stratum IS NOT NULL").select("stratum", "id", "y", "r1", "r2")
    one = lambda k: F.sum(F.when(F.col("t.y") == 1, F.col(k)).otherwise(0.0))
    return _shuffled(t, "inc").groupBy("b").agg(one("q.r1").alias("s1"), one("q.r2").alias("s2"), F.sum("t.y").alias("ones"), F.count("*").alias("n"))


@Q("STAT-04", shuffled_sums=shuffled_sums)
def incremental_auroc(d):
    """What a second score adds to a first one's AUROC, against labels permuted within strata."""
    if d.name == "spark":
        area = lambda k: f"({k} - ones * (ones + 1) / 2e0) / nullif(CAST(ones * (n - ones) AS DOUBLE), 0e0)"
        return f"""WITH s AS (SELECT b, {area('s1')} AS a1, {area('s2')} AS a2 FROM shuffled_sums), o AS (SELECT * FROM s WHERE b = 0)
        SELECT {r('max(o.a1)')} AS first_, {r('max(o.a2)')} AS second_, {r('max(o.a2 - o.a1)')} AS gain, {p_value('s.a2 - s.a1 >= o.a2 - o.a1 - 1e-12', DRAWS)} AS p_value FROM s CROSS JOIN o WHERE s.b > 0"""
    au = lambda k: f"(sum(CASE WHEN t.y = 1 THEN {k} ELSE 0e0 END) - sum(t.y) * (sum(t.y) + 1) / 2e0) / nullif(CAST(sum(t.y) * (count(*) - sum(t.y)) AS DOUBLE), 0e0)"
    return f"""WITH {scored(d)}, t AS (SELECT id, stratum, y, {avg_rank('p')} AS r1, {avg_rank('p + (toxic + 1) * card / 7e0')} AS r2, row_number() OVER (PARTITION BY stratum ORDER BY id) AS at_ FROM scored), b AS (SELECT {d.explode(d.seq(0, 40))} AS b),
    q AS (SELECT b, stratum, r1, r2, CASE WHEN b = 0 THEN at_ ELSE row_number() OVER (PARTITION BY b, stratum ORDER BY {draw(d, 'inc', 'b', 'id')}, id) END AS at_ FROM b CROSS JOIN t),
    s AS (SELECT q.b, {au('q.r1')} AS a1, {au('q.r2')} AS a2 FROM q JOIN t ON t.stratum = q.stratum AND t.at_ = q.at_ GROUP BY q.b), o AS (SELECT * FROM s WHERE b = 0)
    SELECT {r('max(o.a1)')} AS first_, {r('max(o.a2)')} AS second_, {r('max(o.a2 - o.a1)')} AS gain, {p_value('s.a2 - s.a1 >= o.a2 - o.a1 - 1e-12', 40)} AS p_value FROM s CROSS JOIN o WHERE s.b > 0"""

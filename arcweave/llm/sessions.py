"""Gap sessionisation of clicks: Arrow groups of hashed clients, each worked through by an embedded DuckDB.

A client's time is cut into cells of some hours, and (client, cell) pairs are
hashed to groups, so that a client with a third of all clicks is spread over very many
groups. Each cell also sees the clicks just before it (one gap, enough to
know every hard break) and just after it (one session and one gap, enough to see
every session that starts in the cell to its end). In a group, windows find the hard breaks, a
recursive CTE follows the length cuts from each start to the next, and an ASOF
JOIN gives late clicks to sessions.

Length cuts depend on where the session before began. A chain of cuts that runs over
a cell's border without meeting a hard break leaves an *exit*: the click with
which the next cell's first own session starts. Cells without any hard break give, for every
click at which they can be entered, the exit it leads to; these *hops* are
composed by doubling, in Spark joins, and yield all entries at once however
long such a run of cells is. The clicks before a cell's first break (its
head) then go through the same program with the entry as their start.

What is left is one row for each cell of a client: its last session, and the
late clicks before its first one. A window over these rows (their number is
bounded by the client's time, not by its clicks) hands late clicks to the last session of an earlier
cell and tells whether a later session follows.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

MINUTE = 60_000_000
#: Fixed values, in microseconds.
GAP, LENGTH, LATE, FINAL_VALUE, FINAL_KINDS = 15 * MINUTE, 60 * MINUTE, 15 * MINUTE, 60, ("purchase", "signup")
#: Hours of a cell; at least two, so that a session reaches into one more cell at most. Results do not depend on it.
CELL_HOURS = 6

_SESSION = "client_id long, session_id long, start_us long, end_us long, n_clicks long, n_late long, value_cents long, closed_by string, path_sha256 string"
_OUT = f"kind string, {_SESSION}, cell long, lead long, click_id long, us long, final boolean, cents long, why string, own boolean, late boolean, to_cell long, to_click long"
_ARROW = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
_SCHEMA = pa.schema([(n, _ARROW[t]) for n, t in (x.split(" ") for x in _OUT.split(", "))])

#: Clicks of a group by cell in order; ``why``: the hard break with which a click begins.
_BREAKS = f"""
CREATE TEMP TABLE c AS
SELECT *, row_number() OVER w AS pos,
       CASE WHEN lag(final) OVER w THEN 'end' WHEN us - lag(us) OVER w < {GAP} THEN NULL ELSE 'gap' END AS why
FROM g WHERE NOT late WINDOW w AS (PARTITION BY client_id, cell ORDER BY us, click_id)"""

#: The same of clicks whose breaks are known.
_KNOWN = "CREATE TEMP TABLE c AS SELECT *, row_number() OVER (PARTITION BY client_id, cell ORDER BY us, click_id) AS pos FROM g WHERE NOT late AND kind = 'head'"

#: ``nxt``: where the next session starts if one starts here: at a hard break, or over an hour later.
_NEXT = f"""
CREATE TEMP TABLE n AS
WITH t AS (SELECT client_id, cell, us, min(pos) AS pos FROM c GROUP BY ALL),
b AS (SELECT *, min(CASE WHEN why IS NOT NULL THEN pos END) OVER (PARTITION BY client_id, cell ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS hard FROM c)
SELECT b.*, least(hard, t.pos) AS nxt FROM b ASOF LEFT JOIN t ON t.client_id = b.client_id AND t.cell = b.cell AND b.us + {LENGTH} < t.us"""

#: Every start reached from ``roots`` by length cuts inside the cell, and where the chain of ``root`` goes on.
_CHAINS = """
CREATE TEMP TABLE {name} AS
WITH RECURSIVE s AS (
    SELECT n.client_id, n.cell, n.pos AS root, n.pos, n.nxt FROM n WHERE own AND ({roots})
    UNION ALL
    SELECT n.client_id, n.cell, s.root, n.pos, n.nxt FROM s JOIN n ON n.client_id = s.client_id AND n.cell = s.cell AND n.pos = s.nxt WHERE n.own AND n.why IS NULL)
SELECT s.*, m.click_id AS to_click FROM s LEFT JOIN n m ON m.client_id = s.client_id AND m.cell = s.cell AND m.pos = s.nxt AND NOT m.own AND m.why IS NULL"""

#: Sessions of the starts in ``s``, each with the late clicks of its cell that it has; ``last``: the cell's last one.
_SESSIONS = """
CREATE TEMP TABLE r AS
WITH k AS (SELECT n.*, s.pos AS spos, s.nxt AS until FROM n ASOF JOIN s ON s.client_id = n.client_id AND s.cell = n.cell AND n.pos >= s.pos),
a AS (SELECT client_id, cell, spos, until, count(*) AS n_clicks, min(us) AS start_us, max(us) AS end_us, CAST(sum(cents) AS BIGINT) AS value_cents, first(click_id ORDER BY pos) AS session_id,
             last(final ORDER BY pos) AS final, sha256(string_agg(CAST(click_id AS VARCHAR), ',' ORDER BY pos)) AS path_sha256
      FROM k WHERE until IS NULL OR pos < until GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY client_id, cell, start_us ORDER BY spos DESC) AS same FROM a),
l AS (SELECT o.client_id, o.cell, o.spos, count(*) AS n FROM g ASOF JOIN (SELECT * FROM o WHERE same = 1) o ON o.client_id = g.client_id AND o.cell = g.cell AND g.us >= o.start_us WHERE g.late GROUP BY ALL)
SELECT a.client_id, a.session_id, start_us, end_us, n_clicks, coalesce(l.n, 0) AS n_late, value_cents,
       CASE WHEN a.final THEN 'end' WHEN m.pos IS NULL THEN 'gap' ELSE coalesce(m.why, 'length') END AS closed_by, path_sha256, a.cell,
       row_number() OVER (PARTITION BY a.client_id, a.cell ORDER BY a.spos DESC) = 1 AS last
FROM a LEFT JOIN l USING (client_id, cell, spos) LEFT JOIN n m ON m.client_id = a.client_id AND m.cell = a.cell AND m.pos = a.until"""

#: For each cell, the late clicks before its first session.
_LEADS = """
WITH f AS (SELECT client_id, cell, min(start_us) AS first FROM r GROUP BY ALL)
SELECT g.client_id, g.cell, count(*) FILTER (g.late AND (f.first IS NULL OR g.us < f.first)) AS lead FROM g LEFT JOIN f USING (client_id, cell) {which} GROUP BY ALL"""

#: Cells with timely clicks of their own: the first hard break, and whether clicks before it go on from an earlier cell.
_HEADS = """
CREATE TEMP TABLE h AS
SELECT client_id, cell, min(pos) FILTER (why IS NOT NULL) AS hard, min(us) FILTER (why IS NOT NULL) AS hard_us, min(pos) IS DISTINCT FROM min(pos) FILTER (why IS NOT NULL) AS open
FROM c WHERE own GROUP BY ALL"""

_LAST = "(SELECT * EXCLUDE (last) FROM r WHERE last)"


@functools.cache
def _duck():
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": "", "preserve_insertion_order": False})


def _group(table: pa.Table, first: bool, cell_us: int) -> pa.Table:
    """What a group of cells gives, told apart by ``kind``.

    ``session``: whole sessions but each cell's last; ``cell``: that one, if any, and the late clicks before
    the cell's first; and, of the first round, ``head``: clicks up to the first hard break of a cell that goes on
    from before, ``exit`` and ``hop``: where chains of length cuts leave a cell.
    """
    con, outs = _duck(), []

    def out(kind: str, sql: str) -> None:
        got = con.sql(sql).to_arrow_table()
        if n := got.num_rows:
            cols = {f.name: got.column(f.name).cast(f.type) if f.name in got.column_names else pa.nulls(n, f.type) for f in _SCHEMA}
            outs.append(pa.table({**cols, "kind": pa.array([kind] * n)}, schema=_SCHEMA))

    con.register("g", table)
    con.execute(_BREAKS if first else _KNOWN)
    con.execute(_NEXT)
    con.execute(_CHAINS.format(name="s", roots="n.why IS NOT NULL" if first else "(client_id, cell, click_id) IN (SELECT client_id, cell, click_id FROM g WHERE kind = 'entry')"))
    con.execute(_SESSIONS)
    out("session", "SELECT * EXCLUDE (last) FROM r WHERE NOT last")
    if first:
        con.execute(_HEADS)
        ahead = f"us >= (cell + 1) * {cell_us}"
        out("cell", f"SELECT * FROM ({_LEADS.format(which='ANTI JOIN (SELECT * FROM h WHERE open) h USING (client_id, cell)')}) LEFT JOIN {_LAST} USING (client_id, cell) WHERE lead > 0 OR session_id IS NOT NULL")
        out("cell", f"SELECT 0 AS lead, r.* FROM {_LAST} r SEMI JOIN (SELECT * FROM h WHERE open) h USING (client_id, cell)")
        out("head", f"SELECT c.* FROM c JOIN h USING (client_id, cell) WHERE open AND (own OR {ahead}) AND (hard IS NULL OR pos <= hard)")
        out("head", "SELECT g.* FROM g JOIN h USING (client_id, cell) WHERE open AND late AND (hard_us IS NULL OR us < hard_us)")
        out("exit", "SELECT client_id, cell + 1 AS to_cell, to_click FROM s WHERE to_click IS NOT NULL")
        con.execute(_CHAINS.format(name="p", roots=f"us < cell * {cell_us} + {LENGTH + GAP} AND (client_id, cell) IN (SELECT client_id, cell FROM h WHERE hard IS NULL)"))
        out("hop", "SELECT p.client_id, p.cell, n.click_id, p.cell + 1 AS to_cell, p.to_click FROM p JOIN n ON n.client_id = p.client_id AND n.cell = p.cell AND n.pos = p.root WHERE p.to_click IS NOT NULL")
    else:
        out("cell", f"SELECT * FROM ({_LEADS.format(which='')}) LEFT JOIN {_LAST} USING (client_id, cell) WHERE lead > 0 OR session_id IS NOT NULL")
    for t in ("c", "n", "s", "r", "h", "p"):
        con.execute(f"DROP TABLE IF EXISTS {t}")
    con.unregister("g")
    return pa.concat_tables(outs) if outs else _SCHEMA.empty_table()


def _micros(df: DataFrame, col: str):
    """Microseconds since 1970 of a time with or without a zone, whatever the session's zone."""
    if dict(df.dtypes)[col] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{col}`)")
    return F.unix_micros(F.col(f"`{col}`").cast("timestamp"))


def _dealt(rows: DataFrame, buckets: int, first: bool, cell_us: int) -> DataFrame:
    bucket = F.pmod(F.xxhash64("client_id", "cell"), F.lit(buckets)).cast("int")
    return rows.withColumn("b", bucket).groupBy("b").applyInArrow(lambda t: _group(t, first, cell_us), _OUT)


def _entries(exits: DataFrame, hops: DataFrame) -> DataFrame:
    """All (client_id, cell, click_id) reached from ``exits`` by any number of hops: paths double in length each round."""
    key = ["client_id", "cell", "click_id"]
    known, hops = common.stage(exits, "entries"), common.stage(hops, "hops")
    while hops.limit(1).count():
        near = known.join(hops.hint("merge"), key).select("client_id", F.col("to_cell").alias("cell"), F.col("to_click").alias("click_id"))
        more = common.stage(known.unionByName(near).distinct(), "entries")
        far = common.again(hops).select("client_id", *[F.col(c).alias(f"to_{n}") for c, n in (("cell", "cell"), ("click_id", "click"))], F.col("to_cell").alias("far_cell"), F.col("to_click").alias("far_click"))
        twice = hops.join(far.hint("merge"), ["client_id", "to_cell", "to_click"]).select(*key, F.col("far_cell").alias("to_cell"), F.col("far_click").alias("to_click"))
        twice = common.stage(twice, "hops")
        common.discard(known, hops)
        known, hops = more, twice
    common.discard(hops)
    return known


def sessions(clicks: DataFrame, click: str = "click_id", time: str = "ts", arrived: str = "arrived_at", client: str = "client_id", kind: str = "kind", value: str = "value", cell_hours: int = CELL_HOURS) -> DataFrame:
    """(client_id, session_id, start_us, end_us, n_clicks, n_late, value_cents, closed_by, path_sha256) of every session.

    Rows without an id, a client or a time take no part. Of rows that share an id the least by
    time, client, lateness and value counts. A click without an arrival is timely. Clicks of one time go by
    id; where sessions start at the same time, late clicks from then on are the last one's. Late clicks
    before a client's first session, or of a client without timely clicks, are nobody's. A value
    that is null or not finite counts 0; NaN is above 60, as it is above all numbers in SQL. No rows give no sessions. Other columns are not read.

    Memory of a task: a group of cells, and of one client what falls into ``cell_hours`` and an hour and a half.
    """
    if cell_hours * 60 * MINUTE < LENGTH + GAP:
        raise ValueError("a session and a gap have to fit into a cell")
    cell_us = cell_hours * 60 * MINUTE
    v = F.col(f"`{value}`").cast("double")
    final = F.coalesce((v >= FINAL_VALUE) & F.col(f"`{kind}`").isin(*FINAL_KINDS), F.lit(False))
    cents = F.when(F.abs(v) < float("inf"), F.floor(100 * v + 0.5)).otherwise(0)
    us = _micros(clicks, time)
    all_ = clicks.select(F.col(f"`{click}`").cast("long").alias("click_id"), us.alias("us"), F.col(f"`{client}`").cast("long").alias("client_id"), F.coalesce(_micros(clicks, arrived) - us > LATE, F.lit(False)).alias("late"), final.alias("final"), cents.cast("long").alias("cents"))
    fields = ["us", "client_id", "late", "final", "cents"]
    once = all_.where("click_id IS NOT NULL AND us IS NOT NULL AND client_id IS NOT NULL").groupBy("click_id").agg(F.min(F.struct(*fields)).alias("x")).select("click_id", "x.*")

    home = F.expr(f"(us - pmod(us, {cell_us}L)) div {cell_us}L")
    at = once.withColumn("home", home)
    before, after = ~F.col("late") & (F.col("us") > (F.col("home") + 1) * cell_us - GAP), ~F.col("late") & (F.col("us") < F.col("home") * cell_us + LENGTH + GAP)
    seen = at.select("*", F.explode(F.array(F.col("home"), F.when(before, F.col("home") + 1), F.when(after, F.col("home") - 1))).alias("cell")).where("cell IS NOT NULL")
    seen = seen.select("client_id", "click_id", "us", "late", "final", "cents", "cell", (F.col("cell") == F.col("home")).alias("own"))
    buckets = max(4 * common.parts(clicks.sparkSession), common.buckets(clicks, 8 << 20))
    one = common.stage(_dealt(seen, buckets, True, cell_us), "cells")

    exits = one.where("kind = 'exit'").select("client_id", F.col("to_cell").alias("cell"), F.col("to_click").alias("click_id"))
    entries = _entries(exits, one.where("kind = 'hop'").select("client_id", "cell", "click_id", "to_cell", "to_click"))
    cols = ["kind", "client_id", "cell", "click_id", "us", "final", "cents", "why", "own", "late"]
    two = common.stage(_dealt(one.where("kind = 'head'").select(*cols).unionByName(entries.withColumn("kind", F.lit("entry")), allowMissingColumns=True), buckets, False, cell_us), "heads")
    common.discard(entries)

    names = [x.split(" ")[0] for x in _SESSION.split(", ")]
    back = Window.partitionBy("client_id").orderBy(F.desc("cell"), F.desc("round")).rowsBetween(Window.unboundedPreceding, -1)
    cells = one.where("kind = 'cell'").withColumn("round", F.lit(1)).unionByName(two.where("kind = 'cell'").withColumn("round", F.lit(0)))
    cells = cells.select(*names, "cell", "round", "lead").withColumn("later", F.coalesce(F.sum("lead").over(back), F.lit(0)))
    # late clicks after this session's cell up to and with the next session's are this one's
    cells = cells.withColumn("next", F.last(F.when(F.col("session_id").isNotNull(), F.col("later")), ignorenulls=True).over(back)).where("session_id IS NOT NULL")
    closed = F.when((F.col("closed_by") == "gap") & F.col("next").isNull(), "none").otherwise(F.col("closed_by"))
    lasts = cells.withColumn("n_late", F.col("n_late") + F.col("later") - F.coalesce("next", F.lit(0))).withColumn("closed_by", closed).select(*names)
    return one.where("kind = 'session'").select(*names).unionByName(two.where("kind = 'session'").select(*names)).unionByName(lasts)

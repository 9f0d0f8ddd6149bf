"""Line dedup with a log-template tree.

A line's fields are its white-space separated tokens; a token that holds a
digit is a variable field. The tree has a fixed depth: token count, then the
first three tokens (variable ones as one symbol), then a leaf. In a leaf the
masked lines form templates: in order of frequency, a line that agrees with no
earlier lead, and that enough lines may agree with by the counts of its tokens,
leads a template. A line joins the first lead that it agrees with in at least
``SIMILAR`` of the positions behind the first three, by equal fixed tokens that
are not mere punctuation; positions that differ are variable.
A template found in ``min_docs`` or more different texts is recurring; its
lines are dropped from all documents, except for the first one of the corpus,
so that no content is lost altogether.

Lines are assigned to templates first; then the different texts of a template
are counted by aggregation, so that a text counts once whatever number of a
template's lines and variants it holds, and so do its exact copies. Only the distinct masked lines of a leaf meet in one task; a leaf
with more than ``LEAF`` of them is worked off in rounds over many tasks, to the
same templates.

Defined cases: null and empty texts have no line and come back empty (null in
the pipeline's stage); blank lines and lines whose variable fields stand beside
no fixed word are never dropped; lines end at ``\\n`` and other characters are
kept as they are; lines that are equally frequent lead in the order of their
masked hash; rows that share an id count as one document, and of such a row
only lines go that recur themselves; a row without an id is kept whole; texts of
any length are read whole; an empty table gives no rows; other columns pass
unchanged, whatever their names.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

MIN_DOCS, DEPTH, SIMILAR, LEAF = 10, 3, 0.6, 512
_FIELD = re.compile(rb"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*")
_WORD = re.compile(rb"[A-Za-z\x80-\xff]")
WILD = b"<*>"


def mask(line: bytes) -> list[bytes]:
    """Tokens of a line, with variable fields as one symbol."""
    return _FIELD.sub(WILD, line).split()


def _fixed(token: bytes) -> bool:
    """Tokens that count as agreement: neither variable nor mere punctuation."""
    return token != WILD and _WORD.search(token) is not None


def _long(data: bytes) -> int:
    x = xxhash.xxh3_64_intdigest(data)
    return x - (1 << 64) if x >> 63 else x


def _rows(batches):
    """Every line that can recur: doc, line, masked hash, leaf, text hash."""
    for b in batches:
        out: tuple[list, ...] = ([], [], [], [], [])
        for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if i is None:
                continue
            whole = _long(text)
            for k, line in enumerate(text.split(b"\n")):
                tokens = mask(line)
                if tokens and (WILD not in tokens or any(map(_fixed, tokens))):
                    leaf = _long(b"%d " % len(tokens) + b" ".join(tokens[:DEPTH]))
                    for o, v in zip(out, (i, k, _long(b" ".join(tokens)), leaf, whole)):
                        o.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc", "line", "m", "leaf", "whole"])


def _need(n: int) -> int:
    """Positions that must agree of ``n``."""
    return math.ceil(SIMILAR * n - 1e-9)


def _agree(leads: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    """For every line of ``table``, the place of the first lead that it agrees with, or -1."""
    out = np.full(len(table), -1)
    need = _need(table.shape[1])
    for k, lead in enumerate(leads):
        free = np.flatnonzero(out < 0)
        if not len(free):
            break
        out[free[((table[free] == lead) & (lead != 0)).sum(axis=1) >= need]] = k
    return out


def _leads(table: np.ndarray) -> list[int]:
    """Lines that agree with no earlier lead, in the order of ``table``."""
    out: list[int] = []
    open_ = np.ones(len(table), bool)
    for k in range(len(table)):
        if open_[k]:
            out.append(k)
            open_[k:] &= _agree([table[k]], table[k:]) < 0
    return out


def _may_lead(docs: np.ndarray, table: np.ndarray, min_docs: int) -> np.ndarray:
    """Lines that ``min_docs`` lines may agree with, as far as the counts of their tokens tell."""
    sums = np.zeros(len(table), np.int64)
    for p in range(table.shape[1]):
        _, at = np.unique(table[:, p], return_inverse=True)
        v = np.bincount(at, weights=docs)[at].astype(np.int64)
        sums += np.where(table[:, p] != 0, np.minimum(v, min_docs), 0)
    return sums >= _need(table.shape[1]) * min_docs


def _templates(rows: list[tuple[int, int, np.ndarray]], min_docs: int):
    """(m, template) of one leaf's masked lines that agree with a lead; a template is named by its lead."""
    rows.sort(key=lambda r: (-r[1], r[0]))
    table = np.stack([r[2] for r in rows])
    may = np.flatnonzero(_may_lead(np.array([r[1] for r in rows]), table, min_docs))
    leads = may[_leads(table[may])]
    of = _agree([table[k] for k in leads], table)
    return [(rows[k][0], rows[leads[t]][0]) for k, t in enumerate(of) if t >= 0]


def recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(staged lines, masked lines of recurring templates with the template's first place)."""
    spark = docs.sparkSession
    common.small_batches(spark)
    base = common.texts(docs, id_col, text_col)
    lines = common.stage(base.mapInArrow(_rows, "doc long, line int, m long, leaf long, whole long"), "lines")
    # the distinct texts of a masked line: summed in two steps, so that a very common line is spread by text
    per = lines.groupBy("m", "leaf", "whole").agg(F.min(F.struct("doc", "line")).alias("at"))
    masked = common.stage(per.groupBy("m", "leaf").agg(F.count("*").alias("docs"), F.min("at").alias("at")), "masked")
    leaves = masked.groupBy("leaf").agg(F.sum("docs").alias("leaf_docs"), F.count("*").alias("variants")).where(F.col("leaf_docs") >= min_docs)
    leaves = common.stage(leaves, "leaves")

    def fields(batches):
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            for doc, text, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                own = text.split(b"\n")
                for w in wanted:
                    tokens = mask(own[w["line"]]) if w["line"] < len(own) else []
                    if _long(b" ".join(tokens)) != w["m"]:
                        continue  # another row of the same id
                    data = np.array([xxhash.xxh32_intdigest(t) | 1 if _fixed(t) else 0 for t in tokens[DEPTH:]], "<u4").tobytes()
                    for o, v in zip(out, (w["m"], w["leaf"], w["docs"], doc, w["line"], w["variants"], data)):
                        o.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types)], names=["m", "leaf", "docs", "doc", "line", "variants", "fields"])

    # (joins with the texts are sort-merge joins at every size, so that costs follow the input)
    # a text is read once, for all of its lines that stand for a masked line
    several = common.again(masked).join(common.again(leaves).where("variants > 1").select("leaf", "variants"), "leaf")
    several = several.groupBy(F.col("at.doc").alias("_doc")).agg(F.collect_list(F.struct(F.col("at.line").alias("line"), "m", "leaf", "docs", "variants")).alias("_wanted"))
    several = base.join(several.hint("merge"), base._id == several._doc).select("_id", "_text", "_wanted")
    several = several.mapInArrow(fields, "m long, leaf long, docs long, doc long, line int, variants long, fields binary")
    several = common.stage(several.dropDuplicates(["m"]), "fields")
    common.release(spark)

    def small(key, table):
        by: dict[int, list] = {}
        for m, leaf, n, data in zip(*(table.column(c).to_pylist() for c in ("m", "leaf", "docs", "fields"))):
            by.setdefault(leaf, []).append((m, n, np.frombuffer(data, "<u4")))
        out = [row for leaf in sorted(by) for row in _templates(by[leaf], min_docs)]
        cols = list(zip(*out)) or [()] * 2
        return pa.table({"m": pa.array(list(cols[0]), pa.int64()), "template": pa.array(list(cols[1]), pa.int64())})

    buckets = 4 * common.parts(spark)
    bounded = several.where(F.col("variants") <= LEAF).withColumn("b", F.pmod(F.xxhash64("leaf"), F.lit(buckets)))
    near = bounded.groupBy("b").applyInArrow(small, "m long, template long")

    crowded = several.where(F.col("variants") > LEAF).select("m", "leaf", "docs", "variants", "fields")
    found = _found(lines, masked, near.unionByName(_crowded(crowded, min_docs)), min_docs)
    common.discard(masked, leaves, several)
    return lines, found


def _crowded(rows: DataFrame, min_docs: int) -> DataFrame:
    """(m, template) as of :func:`_templates`, for leaves that are too large for one task.

    Each round takes a leaf's next ``LEAF`` lines that may lead, finds the leads among
    them and compares all lines that are left with these, spread over tasks.
    """
    schema = "m long, leaf long, docs long, variants long, fields binary"
    found = rows.select("m", F.col("m").alias("template")).where("false")

    def spread(batches):
        for b in batches:
            data = [np.frombuffer(x, "<u4") for x in b.column("fields").to_pylist()]
            at = np.repeat(np.arange(len(data)), [len(x) for x in data])
            pos = np.concatenate([np.arange(len(x)) for x in data]) if data else np.array([], int)
            need = np.array([_need(len(x)) for x in data], np.int64)[at]
            token = np.concatenate(data).astype(np.int64) if data else np.array([], np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(at)) for k in ("m", "leaf", "docs")), pa.array(pos, pa.int32()), pa.array(token), pa.array(need)], names=["m", "leaf", "docs", "pos", "token", "need"])

    def first(table):
        rows = table.sort_by([("docs", "descending"), ("m", "ascending")])
        data = np.stack([np.frombuffer(x, "<u4") for x in rows.column("fields").to_pylist()])
        leads = _leads(data)
        return rows.take(pa.array(leads)).append_column("place", pa.array(range(len(leads)), pa.int32())).select(["leaf", "m", "fields", "place", "variants"])

    def meet(own, leads):
        leads = leads.sort_by("place")
        data = [np.frombuffer(x, "<u4") for x in own.column("fields").to_pylist()]
        names = np.array(leads.column("m").to_pylist(), np.int64)
        of = _agree([np.frombuffer(x, "<u4") for x in leads.column("fields").to_pylist()], np.stack(data)) if data else np.array([], int)
        template = pa.array(names[of] if len(names) else np.zeros(len(of), np.int64), pa.int64(), mask=of < 0)
        return own.select(["m", "leaf", "docs", "variants", "fields", "may"]).append_column("template", template)

    rows = common.stage(rows, "crowded")
    if not rows.limit(1).count():
        return found
    tokens = common.stage(common.again(rows).mapInArrow(spread, "m long, leaf long, docs long, pos int, token long, need long").where("token <> 0"), "tokens")
    votes = tokens.groupBy("leaf", "pos", "token").agg(F.least(F.sum("docs"), F.lit(min_docs)).alias("v"))
    may = common.again(tokens).join(votes, ["leaf", "pos", "token"]).groupBy("m").agg((F.sum("v") >= F.first("need") * min_docs).alias("may"))
    left = common.stage(common.again(rows).join(may, "m", "left").select(*rows.columns, F.coalesce("may", F.lit(False)).alias("may")), "left")
    common.discard(tokens, rows)
    while left.where("may").limit(1).count():
        order = Window.partitionBy("leaf").orderBy(F.desc("docs"), "m")
        seeds = common.again(left).where("may").withColumn("k", F.row_number().over(order)).where(F.col("k") <= LEAF).drop("k", "may")
        leads = common.stage(seeds.groupBy("leaf").applyInArrow(first, "leaf long, m long, fields binary, place int, variants long"), "leads")
        # as many groups of a leaf as it has LEAF lines
        groups = F.ceil(F.col("variants") / LEAF).cast("long")
        own = common.again(left).withColumn("s", F.pmod(F.xxhash64("m"), groups))
        them = common.again(leads).withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), groups - 1)))
        step = own.groupBy("leaf", "s").cogroup(them.groupBy("leaf", "s")).applyInArrow(meet, schema + ", may boolean, template long")
        step = common.stage(step, "step")
        found = found.unionByName(step.where("template IS NOT NULL").select("m", "template"))
        rest = common.stage(common.again(step).where("template IS NULL").drop("template"), "left")
        common.discard(left, leads)
        left = rest
    return found


def _found(lines: DataFrame, masked: DataFrame, assigned: DataFrame, min_docs: int) -> DataFrame:
    """(m, first_doc, first_line) of the templates found in ``min_docs`` different texts; lines that are not assigned are templates of their own."""
    place = (F.col("at.doc").alias("first_doc"), F.col("at.line").alias("first_line"))
    assigned = common.stage(assigned, "assigned")
    sizes = assigned.groupBy("template").agg(F.count("*").alias("members")).where("members > 1").select("template")
    shared = common.stage(common.again(assigned).join(sizes, "template").select("m", "template"), "shared")
    # a text counts once, with however many lines and variants of the template it holds
    per = common.again(lines).select("m", "whole", "doc", "line").join(common.again(shared), "m").groupBy("template", "whole").agg(F.min(F.struct("doc", "line")).alias("at"))
    many = per.groupBy("template").agg(F.count("*").alias("docs"), F.min("at").alias("at")).where(F.col("docs") >= min_docs)
    several = common.again(shared).join(many, "template").select("m", *place)
    own = common.again(masked).where(F.col("docs") >= min_docs).join(common.again(shared).select("m"), "m", "left_anti").select("m", *place)
    out = common.stage(own.unionByName(several), "recurring")
    common.discard(assigned, shared)
    return out


def _gone(docs: DataFrame, id_col: str, text_col: str, min_docs: int) -> DataFrame:
    """(doc, gone): the places and masked hashes of the lines that go, by document."""
    lines, found = recurring(docs, id_col, text_col, min_docs)
    gone = common.again(lines).select("doc", "line", "m").join(found, "m").where("doc <> first_doc OR line <> first_line").select("doc", "line", "m")
    gone = common.stage(gone.groupBy("doc").agg(F.collect_set(F.struct("line", "m")).alias("gone")), "gone")
    common.discard(lines, found)
    common.release(docs.sparkSession)
    return gone


def cut(text: bytes, gone: list) -> tuple[bytes, int]:
    """The text without the named lines, and their number; a line whose masked hash is another one belongs to another row of the id and stays."""
    named = {(g["line"], g["m"]) for g in gone}
    places = {k for k, _ in named}
    own = text.split(b"\n")
    kept = [x for k, x in enumerate(own) if k not in places or (k, _long(b" ".join(mask(x)))) not in named]
    return b"\n".join(kept), len(own) - len(kept)


def drop_recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """(_id, _text bytes, _lines, _dropped) of every document, without recurring lines."""
    gone = _gone(docs, id_col, text_col, min_docs)

    def change(columns, values):
        text, n, dropped = [], [], []
        for t, g in zip(columns[1].to_pylist(), values):
            n.append(t.count(b"\n") + 1 if t else 0)
            t, k = cut(t, g) if g else (t, 0)
            text.append(t)
            dropped.append(k)
        return [columns[0], pa.array(text, pa.binary()), pa.array(n, pa.int64()), pa.array(dropped, pa.int64())]

    none = F.lit(0).cast("long")
    base = common.texts(docs, id_col, text_col).withColumns({"_lines": none, "_dropped": none})
    return common.beside(base, "_id", gone, "doc", "gone", change)


def line_query(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, text of every document."""
    out = drop_recurring(docs)
    return out.select(F.col("_id").alias("doc_id"), F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), F.col("_text").cast("string").alias("text"))


def without_recurring(docs: DataFrame) -> DataFrame:
    """``docs`` with recurring lines cut from ``text`` and ``n_chars`` counted anew; all rows and other columns stay."""
    gone = _gone(docs, "doc_id", "text", MIN_DOCS)
    at, count = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def change(columns, values):
        if any(values):
            text = columns[at].to_pylist()
            new = [cut(t.encode(), g)[0].decode() if g and t is not None else t for t, g in zip(text, values)]
            columns[at] = pa.array(new, columns[at].type)
            if count is not None:
                columns[count] = pa.array([len(t) if g and t is not None else c for t, g, c in zip(new, values, columns[count].to_pylist())], columns[count].type)
        return columns

    common.small_batches(docs.sparkSession)
    return common.beside(docs, "doc_id", gone, "doc", "gone", change)

"""Benchmark decontamination: a prefix-filtered set join of item windows with whole documents.

A window is a run of ``size`` words of an item, or all words of a shorter one.
Seen as a set of shingles (runs of three words, fewer in a shorter window), a
window can only lie in a text that holds *all* its shingles, so the rarest of
them is a sufficient prefix: windows whose rarest shingle occurs nowhere are out
at once, and the others are looked for only where that shingle stands. Its
place in the text and in the window gives the only possible start; the start
and the window's length are checked against the text's bounds, and then the
words themselves are compared.

All of it is built-in functions. Windows are broadcast in blocks of bounded size,
so a benchmark of any size costs more passes over the texts, not more memory;
the texts are never shuffled, only occurrences are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Words are ASCII letters and digits and everything beyond ASCII, after A-Z became a-z.
#: The class lists its characters one by one, which Java's regular expressions look up in a bit set.
WORD = "[^" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum() or c < 91 and c > 64) + "]+"
SHINGLE = 3
#: Bytes of windows in one broadcast.
BLOCK_BYTES = 32 << 20


def words(text: Column) -> Column:
    """Words of a text; only A-Z change their case, as ``lower`` does where all is ASCII."""
    text = F.coalesce(text, F.lit(""))
    upper = "".join(map(chr, range(65, 91)))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def _runs(w: Column, n: Column, k: int, value) -> Column:
    """``value(i)`` for the start i (from 1) of every run of ``k`` words."""
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), value)).otherwise(F.array())


def _hash(w: Column, i: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *[F.element_at(w, (i + j).cast("int")) for j in range(k)])


def _shingles(w: Column, n: Column, k: int) -> Column:
    return _runs(w, n, k, lambda i: _hash(w, i, k))


def _spread(texts: DataFrame, kinds: list[int]) -> DataFrame:
    """``texts`` with a row for each place: i, and the hash g of the shingle that starts there; place 0 stands for the text itself.

    One stage of generated code from the scan to whatever joins the rows. The
    explosion is an outer one, as Spark would else split every text a second
    time to test that there is a place.
    """
    out = texts.select("*", F.explode_outer(F.sequence(F.lit(0), F.col("n"))).alias("i"))
    hashes = [F.when(F.col("i") > 0, F.xxhash64(F.lit(k), *[F.get("w", F.col("i") + (j - 1)) for j in range(k)])) for k in kinds]
    if len(hashes) == 1:
        return out.withColumn("g", hashes[0])
    return out.withColumn("g", F.explode_outer(F.when(F.col("i") > 0, F.array(*hashes))))


def windows(items: DataFrame, item_id: str, item_text: str, size: int) -> DataFrame:
    """(wid, win, k, owner): the distinct windows of all items; windows of the same items share an ``owner``."""
    w = items.select(F.col(f"`{item_id}`").cast("string").alias("item"), words(F.col(f"`{item_text}`")).alias("w")).withColumn("n", F.size("w"))
    runs = F.when(F.col("n") >= size, _runs(F.col("w"), F.col("n"), size, lambda i: F.slice("w", i, size))).when(F.col("n") > 0, F.array("w")).otherwise(F.array())
    one = w.select("item", F.explode_outer(runs).alias("win")).where("win IS NOT NULL").groupBy("win").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return one.select(F.monotonically_increasing_id().alias("wid"), "win", F.size("win").alias("k"), "items", F.sha2(F.concat_ws(",", "items"), 256).alias("owner"))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`").cast("string")
    out = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.unhex(F.md5(F.col(f"`{text_col}`").cast("binary"))).alias("own"), words(text).alias("w"))
    return out.withColumn("n", F.size("w"))


def _blocks(table: DataFrame, size: Column) -> int:
    return max(1, -(-int(table.agg(F.sum(size + 96)).first()[0] or 0) // BLOCK_BYTES))


def _part(table: DataFrame, key: str, block: int, blocks: int) -> DataFrame:
    """One block of a table whose blocks have at most about BLOCK_BYTES."""
    return F.broadcast(table.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == block) if blocks > 1 else table)


def occurrences(docs: DataFrame, wins: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, own, n, first, at, k, owner): every occurrence of a window, and one row with ``first`` for each document.

    ``own`` is the digest of the text; ``at`` counts words from 1. ``wins`` is a
    staged table of :func:`windows`.
    """
    kinds = sorted(r[0] for r in wins.select(F.least("k", F.lit(SHINGLE)).alias("s")).distinct().collect()) or [SHINGLE]  # at most SHINGLE numbers
    of = reduce(lambda e, s: F.when(F.least("k", F.lit(SHINGLE)) == s, F.transform(_shingles(F.col("win"), F.col("k"), s), lambda g, i: F.struct(g.alias("g"), i.cast("int").alias("off")))).otherwise(e), kinds, F.array().cast("array<struct<g:bigint,off:int>>"))
    parts = common.stage(wins.select("wid", F.inline(of)), "shingles")
    texts = _texts(docs, id_col, text_col)

    # how often each shingle of the benchmark occurs in all texts
    vocabulary = parts.select(F.col("g").alias("v")).distinct()
    seen = _spread(texts, kinds).select("g")
    blocks = _blocks(vocabulary, F.lit(8))
    met = [seen.join(_part(vocabulary, "v", b, blocks), F.col("g") == F.col("v"), "left_semi") for b in range(blocks)]
    counts = common.stage(reduce(DataFrame.union, met).groupBy("g").agg(F.count("*").alias("df")), "counts")

    # the necessary prefix of a window: its rarest shingle, if all of them occur
    ranked = parts.join(counts, "g", "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "g", "off")).alias("r")).where("r.df > 0")
    prefix = common.stage(ranked.join(wins, "wid").select("r.g", "r.off", "k", "win", "owner"), "prefix").withColumnRenamed("g", "key")
    common.discard(parts, counts)

    spread = _spread(texts, kinds)
    at = F.col("i") - F.col("off")
    fits = (at >= 1) & (at + F.col("k") - 1 <= F.col("n"))
    same = F.slice("w", F.when(fits, at).otherwise(1), "k") == F.col("win")
    out, blocks = [], _blocks(prefix, F.length(F.concat_ws(" ", "win")) + 16 * F.col("k"))
    for b in range(blocks):
        both = spread.join(_part(prefix, "key", b, blocks), (F.col("g") == F.col("key")), "left")
        first = (F.col("i") == 0) if b == 0 else F.lit(False)
        out.append(both.where(first | (F.col("key").isNotNull() & fits & same)).select("doc", "own", "n", (F.col("i") == 0).alias("first"), at.alias("at"), "k", "owner"))
    return reduce(DataFrame.union, out)


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of ``docs``.

    A word is hit if it lies in any occurrence of a window of ``size``
    item words; an item of fewer words is one window. Null texts and texts
    without words have no hits; items without words have no window. Rows that
    share an id, and repeated rows, are each done by their own text. Item rows
    that share an id are one item; windows of items without an id make words
    hit, but no id is listed for them. Texts of any length are taken whole. Without
    documents the result is empty; without items nothing is hit. Other columns
    are not read, whatever their names.
    """
    wins = common.stage(windows(items, item_id, item_text, size), "windows")
    found = occurrences(docs, wins, id_col, text_col)
    spans = F.collect_set(F.when(~F.col("first"), F.struct("at", "k")))
    each = found.groupBy("doc", "own").agg(F.sum(F.col("first").cast("int")).alias("rows"), F.max("n").alias("n"), spans.alias("spans"), F.collect_set("owner").alias("owners"))
    # spans by start: what reaches beyond the furthest end so far is new
    start, new = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(1).alias("end")), lambda s, x: F.greatest(x["at"] + x["k"] - F.greatest(s["end"], x["at"]), F.lit(0))
    covered = F.aggregate(F.array_sort("spans"), start, lambda s, x: F.struct((s["sum"] + new(s, x)).alias("sum"), F.greatest(s["end"], x["at"] + x["k"]).alias("end")), lambda s: s["sum"])
    each = each.select("doc", "own", "rows", "n", covered.alias("hit"), F.explode_outer("owners").alias("owner"))
    owners = wins.select("owner", F.explode("items").alias("item")).distinct()
    owners = F.broadcast(owners) if _blocks(owners, F.length("owner") + F.length("item")) == 1 else owners.hint("merge")
    listed = each.join(owners, "owner", "left").groupBy("doc", "own", "rows", "n", "hit").agg(F.array_sort(F.collect_set("item")).alias("items"))
    again = F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int")))
    listed = listed.select("doc", "n", "hit", "items", again.alias("copy"))
    return listed.select(
        F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_words"), F.col("hit").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("hit") > 0).alias("contaminated"),
    )

"""Repeated passages by de Bruijn compaction over word windows.

A window of ``K`` words is an edge between its first and last ``K - 1`` words.

1.  Anchors. Each window names its least 6-word gram. Equal windows name equal
    grams, so only windows whose gram is named twice or more can repeat; about
    an eighth of all positions is shuffled to find those.
2.  Edges. The windows that remain are grouped by hash. A repeated edge keeps
    its first source coordinate (document, start), its count and three sums
    over its occurrences from which a shift by one word can be told.
3.  Paths. Along the document that an edge first occurs in, the next edge
    continues a path without a branch exactly if its occurrences are the same
    ones, one word further on. Such runs compact to their head and a length,
    first inside blocks of ``SPLIT`` words; runs that end at a block's border
    are joined to those that go on behind it, by doubling Spark joins.
4.  Spans. Each head takes a 128-bit digest of the path's words at its source
    coordinate, from that document's text. Heads are joined back to the windows:
    every other occurrence is a span, and it is removed if the digest of its
    own words, read from its own text, is the source's.

Hot keys. A sample of the texts names the grams and windows that occur very
often. Such a gram is known to be repeated, so its places need not meet; such a
window's occurrences are spread over tasks, which hand on sums, and its heads go
to all of these. The sample changes where work is done, never a result.

Defined cases: null and empty texts, and those of fewer than ``K`` words, keep
all; spans inside one document count too; texts of any length are read whole, in
blocks; rows that share an id count as one document at the words they have in
common, and lose only words that recur; a row without an id is kept whole; an
empty table gives no rows; other columns pass unchanged, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .shingles import PACKED, WordHashes, mix, pack, packed_rows, unpack, windows

K, GRAM = 20, 6
#: Words of a source document whose edges compact in one task.
SPLIT = 8192
#: One text in ``SAMPLE`` tells hot keys: those that occur once per ``SHARE`` sampled texts or more, and ``LEAST`` times at least.
SAMPLE, SHARE, LEAST = 64, 4096, 32
#: Occurrences of a hot window in one task, about.
SPREAD = 16_384
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")

ANCHOR = np.dtype([("g0", "<u4"), ("g1", "<u2"), ("pos", "<u4"), ("doc", "<i8")])
PLACE = np.dtype([("doc", "<i8"), ("pos", "<u4")])
WINDOW = np.dtype([("h1", "<u8"), ("h2", "<u4"), ("pos", "<u4"), ("doc", "<i8")])
EDGE = np.dtype([("h1", "<u8"), ("h2", "<u4"), ("doc", "<i8"), ("pos", "<u4"), ("count", "<u4"), ("a", "<u8"), ("b", "<u4"), ("c", "<u4")])
HEAD = np.dtype([("h1", "<u8"), ("h2", "<u4"), ("doc", "<i8"), ("pos", "<u4"), ("edges", "<u4")])
SOURCE = np.dtype([*[(n, HEAD[n]) for n in HEAD.names], ("v1", "<u8"), ("v2", "<u8")])
SPAN = np.dtype([("doc", "<i8"), ("pos", "<u4"), ("words", "<u4"), ("v1", "<u8"), ("v2", "<u8")])
#: A run at a block's border: its head and the sums of its first and last edge.
SUMS = ("count", "a", "b", "c")
RUN = np.dtype([*[(n, HEAD[n]) for n in HEAD.names], *[(f"{e}_{n}", EDGE[n]) for e in ("first", "last") for n in SUMS]])


def _bucket(x: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(np.ascontiguousarray(x).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def anchors(h: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hashes, the gram that each window names, the distinct ones in order)."""
    g = windows(h, GRAM)
    width = k - GRAM + 1
    if len(h) < k:
        return g, np.zeros(0, np.int64), np.zeros(0, np.int64)
    named = np.lib.stride_tricks.sliding_window_view(g, width).argmin(axis=1) + np.arange(len(h) - k + 1)
    return g, named, named[np.r_[True, named[1:] != named[:-1]]]


def _is_hot(x: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(x), bool)
    return hot[np.minimum(np.searchsorted(hot, x), len(hot) - 1)] == x


def hot_keys(base: DataFrame, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(grams, windows, tasks of each window) that occur very often in sampled texts; ``SHARE`` times the mean number of words at most."""

    def count(batches):
        hashes, own = WordHashes(), ([], [])

        def out():
            t, n = zip(*[np.unique(np.concatenate(x), return_counts=True) if x else (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for x in own])
            kind = np.repeat([0, 1], [len(x) for x in t]).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate(t).astype(np.int64)), pa.array(np.concatenate(n).astype(np.int64))], names=["kind", "t", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                h = hashes.of(text.split())
                if len(h) >= k:
                    g, _, at = anchors(h, k)
                    own[0].append(g[at] & MASK)
                    own[1].append(windows(h, k))
            if sum(map(len, own[1])) > 500_000:
                yield out()
                own = ([], [])
        yield out()

    least = max(LEAST, base.count() // (SAMPLE * SHARE))
    counts = base.where(F.pmod(F.xxhash64("_text"), F.lit(SAMPLE)) == 0).select("_text").mapInArrow(count, "kind int, t long, n long")
    got = counts.groupBy("kind", "t").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect()
    pick = lambda kind: np.array(sorted((r.t % (1 << 64), r.n) for r in got if r.kind == kind), np.uint64).reshape(-1, 2)
    w = pick(1)
    return pick(0)[:, 0], w[:, 0], np.maximum(2, -(-w[:, 1].astype(np.int64) * SAMPLE // SPREAD))


MASK = np.uint64(0xFFFFFFFFFFFF)


def _spread(h1: np.ndarray, part: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of one part of a hot window."""
    return _bucket(h1 + (part.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), buckets)


def _anchor_rows(buckets: int, k: int, hot):
    """Documents to anchors by gram (kind 1); those of hot grams as repeated places by document (kind 2)."""

    def flush(part, grams):
        table = np.concatenate(part)
        key = table["g0"].astype(np.uint64) | table["g1"].astype(np.uint64) << np.uint64(32)
        known = _is_hot(key, grams)
        yield packed_rows(1, *pack(_bucket(key[~known], buckets), table[~known]))
        if known.any():
            places = np.zeros(int(known.sum()), PLACE)
            places["doc"], places["pos"] = table["doc"][known], table["pos"][known]
            yield packed_rows(2, *pack(_bucket(places["doc"], buckets), places))

    def run(batches):
        hashes, part, size = WordHashes(), [], 0
        grams = hot.value[0]
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = hashes.of(text.split())
                if i is None or len(h) < k:
                    continue
                g, _, at = anchors(h, k)
                t = np.zeros(len(at), ANCHOR)
                g = g[at]
                t["g0"], t["g1"] = (g & np.uint64(0xFFFFFFFF)).astype(np.uint32), (g >> np.uint64(32) & np.uint64(0xFFFF)).astype(np.uint16)
                t["pos"], t["doc"] = at, i
                part.append(t)
                size += len(t)
            if size > 200_000:
                yield from flush(part, grams)
                part, size = [], 0
        if part:
            yield from flush(part, grams)

    return run


def _table(names, payloads, kind: int = 1) -> pa.Table:
    return pa.table({"kind": pa.array([kind] * len(names), pa.int32()), "b": pa.array(names, pa.int32()), "payload": pa.array(payloads, pa.binary())})


def _parted(table: pa.Table, *dtypes) -> list[np.ndarray]:
    """The records of kinds 1, 2, ... of a packed table."""
    kind = table.column("kind").to_numpy()
    return [unpack(table.filter(pa.array(kind == k)).column("payload"), t) for k, t in enumerate(dtypes, 1)]


def _repeated_anchors(buckets: int):
    """One bucket of anchors: the places of grams named twice or more, dealt by document."""

    def run(key, table):
        t, known = _parted(table, ANCHOR, PLACE)
        g = t["g0"].astype(np.uint64) | t["g1"].astype(np.uint64) << np.uint64(32)
        by = np.argsort(g, kind="stable")
        g, t = g[by], t[by]
        same = g[1:] == g[:-1]
        t = t[np.r_[False, same] | np.r_[same, False]] if len(t) else t
        out = np.zeros(len(t), PLACE)
        out["doc"], out["pos"] = t["doc"], t["pos"]
        out = np.concatenate([out, known])
        out = out[np.lexsort((out["pos"], out["doc"]))]
        return _table(*pack(_bucket(out["doc"], buckets), out))

    return run


def _by_doc(dtype, fields):
    """One bucket of records with a ``doc`` field: a row per document, its records as bytes."""
    body = np.dtype([(n, dtype[n]) for n in fields])

    def run(key, table):
        t = unpack(table.column("payload"), dtype)
        t = t[np.lexsort((t["pos"], t["doc"]))]
        first = np.flatnonzero(np.r_[True, t["doc"][1:] != t["doc"][:-1]]) if len(t) else np.zeros(0, np.int64)
        rest = np.zeros(len(t), body)
        for n in fields:
            rest[n] = t[n]
        ends = np.r_[first[1:], len(t)]
        return pa.table({"_of": pa.array(np.ascontiguousarray(t["doc"][first])), "_places": pa.array([rest[a:b].tobytes() for a, b in zip(first.tolist(), ends.tolist())], pa.binary())})

    return run


def _window_rows(buckets: int, k: int, hot):
    """Documents with their repeated anchors to windows by hash (kind 1); hot ones by hash and document (kind 2)."""

    def flush(part, often, tasks):
        table = np.concatenate(part)
        known = _is_hot(table["h1"], often)
        yield packed_rows(1, *pack(_bucket(table["h1"][~known], buckets), table[~known]))
        if known.any():
            t = table[known]
            own = mix(t["doc"].astype(np.uint64) + np.uint64(3)) % tasks[np.searchsorted(often, t["h1"])].astype(np.uint64)
            yield packed_rows(2, *pack(_spread(t["h1"], own, buckets), t))

    def run(batches):
        hashes, part, size = WordHashes(), [], 0
        _, often, tasks = hot.value
        for b in batches:
            for i, text, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                h = hashes.of(text.split())
                if i is None or len(h) < k:
                    continue
                _, named, _ = anchors(h, k)
                hit = np.flatnonzero(np.isin(named, np.frombuffer(places, "<u4").astype(np.int64)))
                t = np.zeros(len(hit), WINDOW)
                t["h1"], t["h2"] = windows(h, k)[hit], windows(mix(h), k, salt=1)[hit] >> np.uint64(32)
                t["pos"], t["doc"] = hit, i
                part.append(t)
                size += len(t)
                if size > 120_000:
                    yield from flush(part, often, tasks)
                    part, size = [], 0
        if part:
            yield from flush(part, often, tasks)

    return run


def _starts(t: np.ndarray) -> np.ndarray:
    """Where the records of another window begin; ``t`` is in order of (h1, h2)."""
    return np.flatnonzero(np.r_[True, (t["h1"][1:] != t["h1"][:-1]) | (t["h2"][1:] != t["h2"][:-1])]) if len(t) else np.zeros(0, np.int64)


def _summed(t: np.ndarray) -> np.ndarray:
    """Edges of windows: count, first place and sums."""
    t = t[np.lexsort((t["pos"], t["doc"], t["h2"], t["h1"]))]
    if len(t):
        t = t[np.r_[True, (t[1:] != t[:-1])]]
    start = _starts(t)
    out = np.zeros(len(start), EDGE)
    if len(start):
        d, p = mix(t["doc"].astype(np.uint64)), t["pos"].astype(np.uint64)
        for name, v in (("a", d), ("b", d * p), ("c", d * p * p)):
            out[name] = np.add.reduceat(v, start).astype(EDGE[name])  # the low bits
        for name in ("h1", "h2", "doc", "pos"):
            out[name] = t[name][start]
        out["count"] = np.diff(np.r_[start, len(t)])
    return out


def _added(e: np.ndarray) -> np.ndarray:
    """Edges of parts of windows: the sums of their sums, the first of their places."""
    e = e[np.lexsort((e["pos"], e["doc"], e["h2"], e["h1"]))]
    start = _starts(e)
    out = e[start]
    for name in SUMS:
        if len(start):
            out[name] = np.add.reduceat(e[name], start, dtype=EDGE[name])
    return out


def _deal_edges(e: np.ndarray, buckets: int):
    """Repeated edges, by the block of the document that they first occur in."""
    e = e[e["count"] > 1]
    return _table(*pack(_bucket(e["doc"].astype(np.uint64) + (e["pos"] // np.uint32(SPLIT)).astype(np.uint64) * np.uint64(0xD1342543DE82EF95), buckets), e))


def _paths(buckets: int):
    """One bucket of edges by first place: paths without a branch, as heads dealt by source document (kind 1) or runs at a border (2)."""

    def run(key, table):
        (e,) = _parted(table, EDGE)
        e = e[np.lexsort((e["pos"], e["doc"]))]
        if not len(e):
            return _table([], [])
        x, y = e[:-1], e[1:]
        goes_on = (y["doc"] == x["doc"]) & (y["pos"] == x["pos"] + np.uint32(1)) & (y["count"] == x["count"]) & (y["pos"] % np.uint32(SPLIT) != 0)
        a = x["a"].astype(np.uint32)
        goes_on &= (y["a"] == x["a"]) & (y["b"] == x["b"] + a) & (y["c"] == x["c"] + x["b"] + x["b"] + a)
        start = np.flatnonzero(np.r_[True, ~goes_on])
        last = np.r_[start[1:], len(e)] - 1
        out = np.zeros(len(start), RUN)
        for name in ("h1", "h2", "doc", "pos"):
            out[name] = e[name][start]
        out["edges"] = last - start + 1
        for name in SUMS:
            out[f"first_{name}"], out[f"last_{name}"] = e[name][start], e[name][last]
        border = (out["pos"] % np.uint32(SPLIT) == 0) & (out["pos"] > 0) | ((out["pos"] + out["edges"]) % np.uint32(SPLIT) == 0)
        own = np.zeros(int((~border).sum()), HEAD)
        for name in HEAD.names:
            own[name] = out[name][~border]
        return pa.concat_tables([_table(*pack(_bucket(own["doc"], buckets), own)), _table(*pack(_bucket(out["doc"][border], buckets), out[border]), kind=2)])

    return run


def _runs(batches):
    """Packed runs as rows."""
    for b in batches:
        t = unpack(b.column(0), RUN)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(t[n]).astype(np.int64)) for n in RUN.names], names=list(RUN.names))


def _compact(runs: DataFrame) -> DataFrame:
    """(h1, h2, doc, pos, edges) of whole paths: runs joined to those that go on behind a block's border, twice as far each round."""
    low = lambda x: F.col(x).bitwiseAND(F.lit(0xFFFFFFFF))
    runs = common.stage(runs, "runs")
    ends = runs.select("doc", (F.col("pos") + F.col("edges")).alias("at"), F.col("pos").alias("from"), *[F.col(f"last_{n}").alias(n) for n in SUMS])
    behind = common.again(runs).select("doc", F.col("pos").alias("at"), *[f"first_{n}" for n in SUMS])
    same = (F.col("count") == F.col("first_count")) & (F.col("a") == F.col("first_a")) & (F.col("first_b") == (F.col("b") + low("a")).bitwiseAND(F.lit(0xFFFFFFFF))) & (F.col("first_c") == (F.col("c") + 2 * F.col("b") + low("a")).bitwiseAND(F.lit(0xFFFFFFFF)))
    links = common.stage(ends.join(behind, ["doc", "at"]).where(same).select("doc", F.col("from").alias("pos"), F.col("at").alias("next")), "links")
    paths = common.stage(common.again(runs).join(links, ["doc", "pos"], "left").select("h1", "h2", "doc", "pos", "edges", "next"), "paths")
    while paths.where("next IS NOT NULL").limit(1).count():
        far = common.again(paths).select("doc", F.col("pos").alias("next"), F.col("edges").alias("more"), F.col("next").alias("then"))
        step = paths.join(far, ["doc", "next"], "left").select("h1", "h2", "doc", "pos", (F.col("edges") + F.coalesce("more", F.lit(0))).alias("edges"), F.col("then").alias("next"))
        step = common.stage(step, "paths")
        common.discard(paths)
        paths = step
    return paths.join(common.again(links).select("doc", F.col("next").alias("pos")), ["doc", "pos"], "left_anti").select(*HEAD.names)


def _digest(words: list[bytes]) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(b" ".join(words))
    return x & 0xFFFFFFFFFFFFFFFF, x >> 64


def _sources(buckets: int, k: int, hot):
    """Documents with the heads of their paths: heads with the digest of the path's words, dealt by hash, to all tasks of a hot window."""
    body = np.dtype([(n, HEAD[n]) for n in ("pos", "h1", "h2", "edges")])

    def run(batches):
        _, often, tasks = hot.value
        for b in batches:
            part = []
            for i, text, heads in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                words, heads = text.split(), np.frombuffer(heads, body)
                heads = heads[heads["pos"].astype(np.int64) + heads["edges"] + k - 1 <= len(words)]  # others are of another row of the id
                t = np.zeros(len(heads), SOURCE)
                for name in body.names:
                    t[name] = heads[name]
                t["doc"] = i
                for j, (p, n) in enumerate(zip(heads["pos"].tolist(), heads["edges"].tolist())):
                    t["v1"][j], t["v2"][j] = _digest(words[p : p + n + k - 1])
                part.append(t)
            table = np.concatenate(part) if part else np.zeros(0, SOURCE)
            known = _is_hot(table["h1"], often)
            yield packed_rows(1, *pack(_bucket(table["h1"][~known], buckets), table[~known]))
            if known.any():
                t = table[known]
                n = tasks[np.searchsorted(often, t["h1"])]
                t, own = np.repeat(t, n), np.concatenate([np.arange(x) for x in n])
                yield packed_rows(1, *pack(_spread(t["h1"], own, buckets), t))

    return run


def _spans(buckets: int, k: int):
    """Windows and heads of one bucket: the other occurrences of each head, with the digest to verify."""

    def run(left, right):
        t, heads = unpack(left.column("payload"), WINDOW), unpack(right.column("payload"), SOURCE)
        heads = heads[np.lexsort((heads["h2"], heads["h1"]))]
        lo = np.searchsorted(heads["h1"], t["h1"], "left")
        n = np.searchsorted(heads["h1"], t["h1"], "right") - lo
        at = np.repeat(np.arange(len(t)), n)
        of = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        other = (t["h2"][at] == heads["h2"][of]) & ((t["doc"][at] != heads["doc"][of]) | (t["pos"][at] != heads["pos"][of]))
        at, of = at[other], of[other]
        out = np.zeros(len(at), SPAN)
        out["doc"], out["pos"], out["words"] = t["doc"][at], t["pos"][at], heads["edges"][of] + k - 1
        out["v1"], out["v2"] = heads["v1"][of], heads["v2"][of]
        return _table(*pack(_bucket(out["doc"], buckets), out))

    return run


def _covered(words: list[bytes], spans: bytes | None) -> np.ndarray:
    """Which of the words a span covers whose words are those of its source."""
    n = len(words)
    if not spans:
        return np.zeros(n, bool)
    step = np.zeros(n + 1, np.int64)
    for p, m, v1, v2 in np.frombuffer(spans, [(x, SPAN[x]) for x in ("pos", "words", "v1", "v2")]).tolist():
        if p + m <= n and _digest(words[p : p + m]) == (v1, v2):
            step[p] += 1
            step[p + m] -= 1
    return np.cumsum(step[:-1]) > 0


def _find(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """Repeated spans by document."""
    spark = docs.sparkSession
    common.small_batches(spark)
    buckets = common.buckets(docs)
    base = common.texts(docs, id_col, text_col)
    keys = hot_keys(base, k)
    hot = spark.sparkContext.broadcast(keys)
    named = base.mapInArrow(_anchor_rows(buckets, k, hot), PACKED)
    places = named.groupBy("b").applyInArrow(_repeated_anchors(buckets), PACKED).groupBy("b").applyInArrow(_by_doc(PLACE, ["pos"]), "_of long, _places binary")
    places = common.stage(places, "places")
    common.release(spark)
    rows = base.join(places.hint("merge"), base._id == places._of).select("_id", "_text", "_places")
    rows = common.stage(rows.mapInArrow(_window_rows(buckets, k, hot), PACKED), "windows")
    common.discard(places)
    common.release(spark)
    edges = rows.where("kind = 1").select("b", "payload").groupBy("b").applyInArrow(lambda key, t: _deal_edges(_summed(unpack(t.column("payload"), WINDOW)), buckets), PACKED)
    if len(keys[1]):
        # a hot window's parts are summed where they lie, and their sums are added
        def sums(key, t):
            e = _summed(unpack(t.column("payload"), WINDOW))
            return _table(*pack(_bucket(e["h1"], buckets), e))

        parts = common.again(rows).where("kind = 2").select("b", "payload").groupBy("b").applyInArrow(sums, PACKED)
        edges = edges.union(parts.groupBy("b").applyInArrow(lambda key, t: _deal_edges(_added(unpack(t.column("payload"), EDGE)), buckets), PACKED))
    paths = common.stage(edges.groupBy("b").applyInArrow(_paths(buckets), PACKED), "paths")
    common.release(spark)
    whole = _compact(paths.where("kind = 2").select("payload").mapInArrow(_runs, ", ".join(f"{n} long" for n in RUN.names)))

    def packed(batches):
        for b in batches:
            t = np.zeros(b.num_rows, HEAD)
            for j, n in enumerate(HEAD.names):
                t[n] = b.column(j).to_numpy().astype(HEAD[n])
            yield packed_rows(1, *pack(_bucket(t["doc"], buckets), t))

    heads = common.again(paths).where("kind = 1").union(whole.mapInArrow(packed, PACKED))
    heads = common.stage(heads.groupBy("b").applyInArrow(_by_doc(HEAD, ["pos", "h1", "h2", "edges"]), "_of long, _places binary"), "heads")
    common.discard(paths)
    sources = base.join(heads.hint("merge"), base._id == heads._of).select("_id", "_text", "_places").mapInArrow(_sources(buckets, k, hot), PACKED)
    sources = common.stage(sources, "sources")
    common.release(spark)
    again = common.again(rows).select("b", "payload")
    spans = again.groupBy("b").cogroup(sources.groupBy("b")).applyInArrow(_spans(buckets, k), PACKED)
    spans = common.stage(spans.groupBy("b").applyInArrow(_by_doc(SPAN, ["pos", "words", "v1", "v2"]), "_of long, _places binary"), "spans")
    common.discard(heads, rows, sources)
    common.release(spark)
    return spans


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: words that a window seen earlier covers are removed."""
    spans = _find(docs, id_col, text_col, k)

    def measure(batches):
        for b in batches:
            n, removed, sha = [], [], []
            for text, places in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = text.split()
                gone = _covered(words, places)
                n.append(len(words))
                removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(b" ".join([w for w, x in zip(words, gone.tolist()) if not x] if removed[-1] else words)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    base = common.texts(docs, id_col, text_col)
    return base.join(spans.hint("merge"), base._id == spans._of, "left").select("_id", "_text", "_places").mapInArrow(measure, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut(text: bytes, places: bytes | None) -> bytes:
    """The text without the covered words and the white space behind each."""
    spots = [m.span() for m in _WORD.finditer(text)]
    gone = _covered([text[lo:hi] for lo, hi in spots], places).tolist()
    out, at = [], 0
    for k, (lo, _) in enumerate(spots):
        if gone[k]:
            out.append(text[at:lo])
            at = spots[k + 1][0] if k + 1 < len(spots) else len(text)
    out.append(text[at:])
    return b"".join(out)


def without_repeats(docs: DataFrame, k: int = K) -> DataFrame:
    """``docs`` with the repeated words cut from ``text`` and ``n_chars`` counted anew; all rows and other columns stay."""
    spans = _find(docs, "doc_id", "text", k)
    at, count = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def change(columns, values):
        if any(values):
            text = columns[at].to_pylist()
            new = [cut(t.encode(), p).decode("utf-8", "replace") if p and t is not None else t for t, p in zip(text, values)]
            columns[at] = pa.array(new, columns[at].type)
            if count is not None:
                columns[count] = pa.array([len(t) if p and t is not None else c for t, p, c in zip(new, values, columns[count].to_pylist())], columns[count].type)
        return columns

    return common.beside(docs, "doc_id", spans, "_of", "_places", change)

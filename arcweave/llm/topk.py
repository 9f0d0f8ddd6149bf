"""Exact top-k search by integer inner product, with MaxScore.

A vector's integer components are the impacts of its terms (dimensions). Rows
are dealt once, evenly, and never copied; each task reads its rows in shards of
bounded size. Queries come to the rows in broadcast blocks of bounded size. Per
shard the terms of a query are split by their score bounds: terms that together
cannot lift a row to the threshold are non-essential. The postings of the
essential terms are traversed; the others are probed only for rows whose score
so far plus the bound of what is left can still reach the threshold. A query's
threshold starts at its k-th best of a fixed share of the rows (which are then
done) and rises from shard to shard; a task hands on its k best rows that reach
it, and one window per query merges them. Nothing is approximate.

Defined cases: null vectors and vectors that hold null or non-finite
components take no part, as queries or candidates, and neither do rows without
an id; vectors of another length than a query's are no candidates for it; ties
go to the smaller id; with fewer than k candidates all are returned; rows that
share an id are no candidates of each other, and a query that stands there twice
is asked once, by the first of its vectors in order; an empty table gives no
rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Rows of a shard, and queries of a broadcast block on average.
SHARD_ROWS, BLOCK_ROWS = 8192, 32_768
SCALE = 256
#: Rows scored in full for a first threshold, and non-essential terms probed at a time.
SEED, PROBE = 256, 8
#: One row in so many is searched first, for thresholds.
HEAD = 64
NONE = np.iinfo(np.int64).min


def _kth(score: np.ndarray, k: int) -> int:
    return int(np.partition(score, len(score) - k)[len(score) - k])


def maxscore(q: np.ndarray, qid: np.ndarray, known: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int):
    """Per query (ids, scores) of its k best rows of the shard that reach its ``known`` threshold; x is int64 (rows, terms).

    A term's impact is what it adds beyond the least it adds to any row of the
    shard. Non-essential are the terms, from the smallest bound on, whose
    impacts together leave a row without any other impact under the threshold.
    """
    low, high = x.min(axis=0), x.max(axis=0)
    n, d = x.shape
    cols = np.ascontiguousarray(x.T)
    for row, own, threshold in zip(q, qid, known.tolist()):
        least, most = np.minimum(row * low, row * high), np.maximum(row * low, row * high)
        order = np.argsort(least - most, kind="stable")  # largest impact first
        impact = (most - least)[order]
        rest = np.r_[np.cumsum(impact[::-1])[::-1], 0]  # impacts of the terms from i on
        floor = int(least.sum())
        if floor + int(rest[0]) < threshold:
            yield np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        alive = np.flatnonzero(xid != own)
        if len(alive) > k:
            seed = alive[:: max(1, len(alive) // SEED)]
            if len(seed) >= k:
                threshold = max(threshold, _kth(x[seed] @ row, k))
        essential = max(1, int(np.searchsorted(-(rest + floor), -threshold, side="right"))) if threshold > floor else d
        step = order[: min(d, essential)]
        # traverse the essential terms' postings
        score = floor + (row[step] @ cols[step] - least[step].sum())[alive]
        at = len(step)
        while len(alive):
            # rows that can still reach the threshold stay; it rises with what is sure
            if len(alive) > k:
                threshold = max(threshold, _kth(score, k))
            keep = score + rest[at] >= threshold
            alive, score = alive[keep], score[keep]
            if at >= d:
                break
            step = order[at : at + PROBE]
            score = score + row[step] @ cols[np.ix_(step, alive)] - least[step].sum()
            at += len(step)
        best = np.lexsort((xid[alive], -score))[:k]
        yield xid[alive][best], score[best]


class Block:
    """Queries of one length, their thresholds and the best rows that a task has found."""

    def __init__(self, q: np.ndarray, qid: np.ndarray, known: np.ndarray, k: int):
        self.q, self.qid, self.known, self.k = q, qid, known.copy(), k
        self.ids = [np.zeros(0, np.int64)] * len(qid)
        self.scores = [np.zeros(0, np.int64)] * len(qid)

    def meet(self, x: np.ndarray, xid: np.ndarray) -> None:
        for i, (ids, scores) in enumerate(maxscore(self.q, self.qid, self.known, x, xid, self.k)):
            if len(ids):
                ids, scores = np.r_[self.ids[i], ids], np.r_[self.scores[i], scores]
                best = np.lexsort((ids, -scores))[: self.k]
                self.ids[i], self.scores[i] = ids[best], scores[best]
                if len(best) == self.k:
                    self.known[i] = max(self.known[i], self.scores[i][-1])


def _search(block, k: int, shard_rows: int):
    """Rows (_id, _x) to (query_id, vec_id, score) of the block's queries."""

    def run(batches):
        queries = {d: Block(*part, k) for d, part in block.value.items()}
        ids: list[np.ndarray] = []
        vectors: list[pa.Array] = []

        def flush():
            lengths = np.concatenate([v.value_lengths().to_numpy(zero_copy_only=False) for v in vectors])
            xs, xid = pa.chunked_array(vectors), np.concatenate(ids)
            for d, b in queries.items():
                here = lengths == d
                if here.any():
                    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in xs.filter(pa.array(here)).chunks])
                    b.meet(flat.reshape(-1, d).astype(np.int64), xid[here])

        for b in batches:
            for lo in range(0, b.num_rows, shard_rows):
                part = b.slice(lo, shard_rows)
                ids.append(part.column(0).to_numpy())
                vectors.append(part.column(1))
                if sum(map(len, ids)) >= shard_rows:
                    flush()
                    ids, vectors = [], []
        if ids:
            flush()
        for b in queries.values():
            n = [len(x) for x in b.ids]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.qid, n), pa.int64()), pa.array(np.concatenate(b.ids), pa.int64()), pa.array(np.concatenate(b.scores), pa.int64())], names=["query_id", "vec_id", "score"])

    return run


def topk_search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of every row that ``is_query`` marks against all other rows."""
    spark = vectors.sparkSession
    common.small_batches(spark, min(shard_rows, 4096))
    v = F.col(f"`{vector_col}`")
    good = F.coalesce(F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) != F.lit(float("inf")))), F.lit(False))
    base = vectors.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.transform(v, lambda e: F.floor(F.lit(float(SCALE)) * e.cast("double"))).alias("_x"), F.coalesce(is_query, F.lit(False)).alias("_q"), good.alias("_good"))
    base = base.where("_good AND _id IS NOT NULL").drop("_good")
    total, asked = base.agg(F.count("*"), F.count_if("_q")).first()
    blocks = max(1, -(-asked // block_rows))
    rows = base.select("_id", "_x").repartition(max(1, min(common.parts(spark), -(-total // 1024)), -(-total // (1 << 20))))  # evenly, whatever ids repeat
    if blocks > 1:
        rows = common.stage(rows, "vectors")
    head = F.pmod(F.xxhash64("_id"), F.lit(HEAD)) == 0
    merge = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = None
    for i in range(blocks):
        # a block of queries, bounded by block_rows, passes through the driver to all rows
        got = base.where("_q").where(F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(blocks)) == i).groupBy("_id").agg(F.min("_x").alias("_x")).collect()
        by: dict[int, list] = {}
        for r in got:
            by.setdefault(len(r._x), []).append(r)
        parts = {d: (np.array([r._x for r in own], np.int64).reshape(len(own), d), np.array([r._id for r in own], np.int64)) for d, own in by.items() if d}
        none = {d: (q, qid, np.full(len(qid), NONE)) for d, (q, qid) in parts.items()}
        first = rows.where(head).mapInArrow(_search(spark.sparkContext.broadcast(none), k, shard_rows), "query_id long, vec_id long, score long")
        first = common.stage(first.withColumn("rank", F.row_number().over(merge)).where(F.col("rank") <= k), "head")
        bound = {r.query_id: r.score for r in first.where(F.col("rank") == k).select("query_id", "score").collect()}  # a number a query
        known = {d: (q, qid, np.array([bound.get(int(x), NONE) for x in qid], np.int64)) for d, (q, qid) in parts.items()}
        rest = rows.where(~head).mapInArrow(_search(spark.sparkContext.broadcast(known), k, shard_rows), "query_id long, vec_id long, score long")
        lists = common.again(first).drop("rank").union(rest)
        if blocks > 1:
            lists = common.stage(lists, "lists")
        out = lists if out is None else out.union(lists)
    return out.withColumn("rank", F.row_number().over(merge)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

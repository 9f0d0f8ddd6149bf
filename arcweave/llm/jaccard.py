"""Exact n-gram Jaccard join with token-combination prefixes.

A document is the set of its distinct 5-word shingles (tokens). Two documents
link at Jaccard 0.75 or more; the result is connected components, so equal
sets are one node from the start and links inside a known component need no
second look. No link between different sets is lost:

1.  Extended prefixes. Tokens are ordered by hash. A pair at the threshold
    shares ``alpha = ceil(0.75 n)`` tokens at least, so the first
    ``n - alpha + l`` tokens of both (``l = max(2, n // 6)``) share ``l`` or
    more. Only these prefixes are shuffled; tokens seen in one set alone fall
    away, and so does every document that shares fewer prefix tokens than any
    partner would need.
2.  Token combinations. The prefix of a remaining document is put in order of
    rising frequency. Rare tokens are indexed one by one. Frequent ones fall
    into classes by hash and are indexed as pairs inside their class; the
    prefix is extended by one token per class, so that a linked pair always
    shares a rare token or a pair of one class. The number of classes grows
    with the set's size, hence the index stays linear in it even where every
    token is frequent.
3.  Verification. The tokens that a candidate shares with any other candidate
    bound its overlap with each partner, which rules out most pairs of a loose
    group of copies. In each index list every member meets the one of its size
    that shares most (a star); verified links give components. Where a list's
    members then lie in several components, they are tied into a bundle, and
    the sets outside the bundle's largest component are counted against all of
    it through an inverted index, in blocks; only links between components
    come out.

Hot keys. A sample of the texts names the tokens that very many of them hold.
These are known to be shared and frequent, so they go straight to their sets
and meet in no task. Index lists of more than ``LIST`` sets are split into
sub-lists by set; all of a split list's members join one bundle, so that links
between sub-lists are found too. Copies of a set send its tokens once a task.
Neither the sample nor ``LIST`` changes a result.

Sets are compared by 64-bit shingle hashes, nodes by 96-bit digests.

Defined cases: a null or empty text, or one without words, has no shingle and
is linked with nothing; fewer than five words are one shingle; texts of any
length are read whole; equal texts link; ids that repeat keep their rows; a row
without an id has its size, no component, and is kept by :func:`keep_one`; an
empty table gives no rows; other columns are not read, and pass unchanged
through :func:`keep_one`.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .shingles import PACKED, WordHashes, mix, pack, packed_rows, set_digest, shingle_set, unpack

SHINGLE = 5
#: A token in more sets than this is frequent.
RARE = 256
#: Index lists of this many members or fewer are compared in full at once.
SMALL = 6
#: Sets of one block of a bundle, on average; a task compares two blocks.
BLOCK = 2500
#: Index lists of more sets are split into sub-lists of about this size.
LIST = 16_384
#: One text in ``SAMPLE`` tells hot tokens: those in one of ``SHARE`` sampled texts or more, and in ``LEAST`` at least.
SAMPLE, SHARE, LEAST = 64, 4096, 32

TOKEN = np.dtype([("d1", "<i8"), ("d2", "<u4"), ("n", "<u4"), ("t0", "<u4"), ("t1", "<u2")])
SHARED = np.dtype([("d1", "<i8"), ("d2", "<u4"), ("n", "<u4"), ("df", "<u4"), ("t", "<u8")])
DOC = np.dtype([("id", "<i8"), ("d1", "<i8"), ("d2", "<i8"), ("n", "<i8")])
ENTRY = np.dtype([("sig", "<u8"), ("d1", "<i8"), ("d2", "<u4"), ("n", "<u4")])
NODE = np.dtype([("d1", "<i8"), ("d2", "<u4")])
ASK = np.dtype([("d1", "<i8"), ("d2", "<u4"), ("b", "<u4")])
LABEL = np.dtype([("d1", "<i8"), ("d2", "<u4"), ("c", "<i8")])
KNOWN = np.dtype([("d1", "<i8"), ("d2", "<u4"), ("n", "<u4"), ("c", "<i8"), ("rep", "<i8")])
TIE = np.dtype([("a", "<i8"), ("b", "<i8")])
OWNED = np.dtype([("d1", "<i8"), ("d2", "<u4"), ("t", "<u8")])
PAIR = np.dtype([("a1", "<i8"), ("a2", "<i8"), ("b1", "<i8"), ("b2", "<i8")])


def alpha(n):
    """The least overlap with any partner of a set of ``n``."""
    return (3 * n + 3) // 4


def extra(n):
    """``l``: prefix tokens that two sets of this size share at least."""
    return np.maximum(2, n // 6)


def prefix_length(n):
    return np.minimum(n, n - alpha(n) + extra(n))


def needed(n):
    """Prefix tokens that a set of ``n`` shares with any partner, whose size may be as small as alpha(n)."""
    return extra(alpha(n))


def classes(n: int) -> int:
    """Classes of frequent tokens: the largest power of two up to n / 16, fewer than ``needed`` of any partner."""
    return 1 << max(0, (n // 16).bit_length() - 1)


def hot_tokens(base: DataFrame) -> np.ndarray:
    """Mixed hashes, in order, of the tokens that very many sampled texts hold; ``SHARE`` times the mean set size at most."""

    def count(batches):
        hashes, seen, own = WordHashes(), set(), []

        def out():
            t, n = np.unique(mix(np.concatenate(own)), return_counts=True) if own else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            return pa.RecordBatch.from_arrays([pa.array(t.astype(np.int64)), pa.array(n.astype(np.int64))], names=["t", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                s = shingle_set(hashes.of(text.lower().split()), SHINGLE)
                d = set_digest(s)
                if d not in seen:
                    seen.add(d)
                    own.append(s)
            if sum(map(len, own)) > 500_000:
                yield out()
                seen, own = set(), []
        yield out()

    least = max(LEAST, base.count() // (SAMPLE * SHARE))
    counts = base.where(F.pmod(F.xxhash64("_text"), F.lit(SAMPLE)) == 0).select("_text").mapInArrow(count, "t long, n long")
    got = counts.groupBy("t").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("t").collect()
    return np.sort(np.array([r.t for r in got], np.int64).astype(np.uint64))


#: Words of the filter of wanted ids, at most (16 MB); more ids only let more texts pass in vain.
WORDS = 1 << 21


def _place(ids: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The word and the bit of each id."""
    h = mix(ids.astype(np.uint64))
    return (h >> np.uint64(6)) % np.uint64(words), np.uint64(1) << (h & np.uint64(63))


def _bits(wanted: DataFrame) -> np.ndarray:
    """A bit set for each ``_id`` of ``wanted``, in about half a word an id; some three in a hundred others share one."""
    words = max(1, min(WORDS, wanted.count() // 2))

    def run(batches):
        for b in batches:
            word, bit = _place(b.column(0).to_numpy(), words)
            at, back = np.unique(word, return_inverse=True)
            out = np.zeros(len(at), np.uint64)
            np.bitwise_or.at(out, back, bit)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(out.view(np.int64))], names=["word", "bits"])

    got = wanted.select("_id").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(words, np.uint64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return out


def _marked(ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    word, bit = _place(ids, len(bits))
    return bits[word] & bit > 0


def _is_hot(t: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(t), bool)
    return hot[np.minimum(np.searchsorted(hot, t), len(hot) - 1)] == t


def _prefixes(buckets: int, hot):
    """Documents to packed prefix tokens (kind 1), hot ones by set (2), and document rows (0)."""

    def flush(rows, tokens, hot):
        if rows:
            docs = np.array(rows, DOC)
            by = mix(docs["id"].astype(np.uint64) + np.arange(len(docs), dtype=np.uint64))  # a repeated id is spread
            yield packed_rows(0, *pack((by % np.uint64(buckets)).astype(np.int64), docs))
        if tokens:
            size = [len(t) for _, t in tokens]
            t = np.concatenate([t for _, t in tokens])
            head = {name: np.repeat(np.array(values, np.int64), size) for name, values in zip(("d1", "d2", "n"), zip(*[h for h, _ in tokens]))}
            known = _is_hot(t, hot)
            table, shared = np.zeros(int((~known).sum()), TOKEN), np.zeros(int(known.sum()), SHARED)
            for name, v in head.items():
                table[name], shared[name] = v[~known], v[known]
            shared["df"], shared["t"] = 1 << 31, t[known] & np.uint64(0xFFFFFFFFFFFF)
            t = t[~known]
            table["t0"] = (t & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            table["t1"] = (t >> np.uint64(32) & np.uint64(0xFFFF)).astype(np.uint16)
            yield packed_rows(1, *pack((mix(t) % np.uint64(buckets)).astype(np.int64), table))
            if len(shared):
                yield packed_rows(2, *pack(_set_bucket(shared["d1"], buckets), shared))

    def run(batches):
        hashes, seen, hot_ = WordHashes(), set(), hot.value
        rows, tokens, size = [], [], 0
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = shingle_set(hashes.of(text.lower().split()), SHINGLE)
                n = len(s)
                d = set_digest(s) if n else (0, 0)
                rows.append((i, *d, n))
                if n > 2 and d not in seen:  # smaller sets link with equal ones alone
                    seen.add(d)
                    # order by a hash of the hash: the low tokens of a set are a random choice
                    p = int(prefix_length(n))
                    s = mix(s)
                    tokens.append(((*d, n), np.partition(s, p - 1)[:p] if p < n else s))
                    size += p
            if size > 250_000 or len(rows) > 100_000:
                yield from flush(rows, tokens, hot_)
                rows, tokens, size = [], [], 0
                if len(seen) > 200_000:
                    seen.clear()
        yield from flush(rows, tokens, hot_)

    return run


def _shared(buckets: int):
    """One token bucket: tokens in two or more different sets, with their frequency, dealt by set."""

    def run(key, table):
        kind = table.column("kind").to_numpy()
        docs = table.filter(pa.array(kind == 0)).select(["kind", "b", "payload"])
        hot = table.filter(pa.array(kind == 2))
        hot = _packed(hot.column("b").to_pylist(), hot.column("payload").to_pylist())
        t = unpack(table.filter(pa.array(kind == 1)).column("payload"), TOKEN)
        names, payloads = [], []
        if len(t):
            token = t["t0"].astype(np.uint64) | t["t1"].astype(np.uint64) << np.uint64(32)
            by = np.lexsort((t["d2"], t["d1"], token))
            t, token = t[by], token[by]
            fresh = np.r_[True, (token[1:] != token[:-1]) | (t["d1"][1:] != t["d1"][:-1]) | (t["d2"][1:] != t["d2"][:-1])]
            t, token = t[fresh], token[fresh]
            first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            df = np.repeat(np.diff(np.r_[first, len(token)]), np.diff(np.r_[first, len(token)]))
            keep = df > 1
            out = np.zeros(int(keep.sum()), SHARED)
            for name in ("d1", "d2", "n"):
                out[name] = t[name][keep]
            out["df"], out["t"] = df[keep], token[keep]
            by = np.lexsort((out["d2"], out["d1"]))  # runs of one set compress
            out = out[by]
            names, payloads = pack((mix(out["d1"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), out)
        got = pa.table({"kind": pa.array([1] * len(names), pa.int32()), "b": pa.array(names, pa.int32()), "payload": pa.array(payloads, pa.binary())})
        return pa.concat_tables([got, hot, docs])

    return run


def signatures(n: int, token: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Index keys of one set of ``n`` tokens from the shared tokens of its prefix."""
    p, s = int(prefix_length(n)), int(needed(n))
    if len(token) < s:
        return np.zeros(0, np.uint64)
    by = np.lexsort((token, np.where(df > RARE, df, 0)))  # rare ones first, in any fixed order; then by frequency
    token, frequent = token[by], df[by] > RARE
    alone = p - len(token)  # tokens of no other set come first and need no entry
    must = p - s + 1
    rare = token[~frequent]
    out = [mix(rare[: max(0, must - alone)])]
    if alone + len(rare) < must:
        rest = token[frequent]
        # classes of the finest partition that any partner uses decide how far the prefix goes
        finest, own = classes(4 * n // 3), classes(n)
        kind = (mix(rest + np.uint64(1)) % np.uint64(finest)).astype(np.int64)
        seen, have, end = set(), alone + len(rare), len(rest)
        for k, c in enumerate(kind.tolist()):
            have += c in seen
            seen.add(c)
            if have >= must:
                end = k + 1
                break
        rest, group = rest[:end], kind[:end] % own
        for c in np.unique(group):
            x = np.sort(rest[group == c])
            i, j = np.triu_indices(len(x), 1)
            out.append(mix(x[i] * np.uint64(0x9E3779B97F4A7C15) + mix(x[j])))
    return np.concatenate(out)


def _index(buckets: int):
    """One bucket of sets: survivors' index entries, dealt by key (kind 1); document rows pass (kind 0)."""

    def run(key, table):
        kind = table.column("kind").to_numpy()
        docs = table.filter(pa.array(kind == 0)).select(["kind", "b", "payload"])
        t = unpack(table.filter(pa.array(kind == 1)).column("payload"), SHARED)
        names, payloads = [], []
        if len(t):
            t = t[np.lexsort((t["t"], t["d2"], t["d1"]))]
            t = t[np.r_[True, t[1:] != t[:-1]]]  # copies of a set bring its hot tokens more than once
            edges = np.flatnonzero(np.r_[True, (t["d1"][1:] != t["d1"][:-1]) | (t["d2"][1:] != t["d2"][:-1]), True])
            sizes = np.diff(edges)
            n = t["n"][edges[:-1]].astype(np.int64)
            parts, heads = [], []
            for k in np.flatnonzero(sizes >= needed(n)).tolist():
                lo, hi = edges[k], edges[k + 1]
                got = signatures(int(n[k]), t["t"][lo:hi], t["df"][lo:hi])
                if len(got):
                    parts.append(got)
                    heads.append(lo)
            if parts:
                size = [len(x) for x in parts]
                out = np.zeros(sum(size), ENTRY)
                out["sig"] = np.concatenate(parts) & ~np.uint64(1)
                for name in ("d1", "d2", "n"):
                    out[name] = np.repeat(t[name][heads], size)
                names, payloads = pack(_list_bucket(out["sig"], buckets), out)
        got = pa.table({"kind": pa.array([1] * len(names), pa.int32()), "b": pa.array(names, pa.int32()), "payload": pa.array(payloads, pa.binary())})
        return pa.concat_tables([got, docs])

    return run


def _list_bucket(sig: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(sig) % np.uint64(buckets)).astype(np.int64)


#: A split list's entries carry an odd key: the list's own upper bits, and the sub-list's number in the lower 16.
SUB = np.uint64(0x1FFFF)


def hot_lists(index: DataFrame, sets: int) -> dict[int, int]:
    """Sub-lists to make of each list that is too long; a million lists at most, as a list counts as long from a millionth of all entries on."""

    def count(batches):
        for b in batches:
            sig, n = np.unique(unpack(b.column(0), ENTRY)["sig"], return_counts=True)
            sig, n = sig[n > 1], n[n > 1]
            yield pa.RecordBatch.from_arrays([pa.array(sig.astype(np.int64)), pa.array(n.astype(np.int64))], names=["sig", "n"])

    least = max(LIST, 20 * sets >> 20)
    got = index.where("kind = 1").select("payload").mapInArrow(count, "sig long, n long").groupBy("sig").agg(F.sum("n").alias("n")).where(F.col("n") > least).collect()
    return {r.sig: min(1 << 16, -(-r.n // least)) for r in got}


def _split(buckets: int, hot):
    """Packed entries, those of long lists dealt anew by sub-list."""

    def run(batches):
        parts = hot.value
        sigs = np.sort(np.array(list(parts), np.int64).astype(np.uint64))
        salts = np.array([parts[int(x)] for x in sigs.astype(np.int64)], np.uint64)
        for b in batches:
            names, payloads = [], []
            for bucket, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                e = unpack(pa.array([payload], pa.binary()), ENTRY)
                known = _is_hot(e["sig"], sigs)
                if known.any():
                    k = e[known]
                    own = mix(k["d1"].astype(np.uint64) + np.uint64(5)) % salts[np.searchsorted(sigs, k["sig"])]
                    k["sig"] = k["sig"] & ~SUB | own << np.uint64(1) | np.uint64(1)
                    more = pack(_list_bucket(k["sig"], buckets), k)
                    names += more[0]
                    payloads += more[1]
                    e = e[~known]
                    (payload,) = pack(np.full(len(e), bucket), e)[1] or [None]
                if payload is not None:
                    names.append(bucket)
                    payloads.append(payload)
            yield packed_rows(1, names, payloads)

    return run


def _lists(entries: np.ndarray):
    """(entries sorted by key and size, list borders) of the lists with two or more sets."""
    by = np.lexsort((entries["d2"], entries["d1"], entries["n"], entries["sig"]))
    e = entries[by]
    edges = np.flatnonzero(np.r_[True, e["sig"][1:] != e["sig"][:-1], True]) if len(e) else np.zeros(1, np.int64)
    size = np.diff(edges)
    keep = np.repeat(size > 1, size)
    e = e[keep]
    size = size[size > 1]
    return e, np.r_[0, np.cumsum(size)]


def _pair_table(e: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distinct unordered pairs of sets."""
    out = np.zeros(len(i), PAIR)
    a, b = e[i], e[j]
    swap = (a["d1"] > b["d1"]) | (a["d1"] == b["d1"]) & (a["d2"] > b["d2"])
    out["a1"], out["a2"] = np.where(swap, b["d1"], a["d1"]), np.where(swap, b["d2"], a["d2"])
    out["b1"], out["b2"] = np.where(swap, a["d1"], b["d1"]), np.where(swap, a["d2"], b["d2"])
    return np.unique(out)


def _admissible(n: np.ndarray, c: np.ndarray, i, j):
    """Whether a pair can reach the threshold: both share enough tokens with any other set.

    Jaccard 0.75 needs an overlap of 3/7 of both sizes together, and no overlap
    is larger than the tokens that either set shares with others at all.
    """
    return 7 * np.minimum(c[i], c[j]) >= 3 * (n[i] + n[j])


def _stars(e: np.ndarray, edges: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Each member of a list paired with the one of its size that shares most; short lists in full."""
    left, right = [], []
    n = e["n"].astype(np.int64)
    size = np.diff(edges)
    for k in np.flatnonzero(size > SMALL).tolist():
        rest = np.arange(edges[k], edges[k + 1])
        while len(rest) > 1:
            pivot = rest[int(np.argmax(c[rest] / n[rest]))]
            near = (3 * n[rest] <= 4 * n[pivot]) & (3 * n[pivot] <= 4 * n[rest])
            own = rest[near]
            own = own[(own != pivot) & _admissible(n, c, pivot, own)]
            left.append(np.full(len(own), pivot))
            right.append(own)
            rest = rest[~near]
    for s in range(2, SMALL + 1):
        at = edges[:-1][size == s]
        for x in range(s):
            for y in range(x + 1, s):
                ok = (3 * n[at + y] <= 4 * n[at + x]) & _admissible(n, c, at + x, at + y)
                left.append(at[ok] + x)
                right.append(at[ok] + y)
    if not left:
        return np.zeros(0, PAIR)
    return _pair_table(e, np.concatenate(left).astype(np.int64), np.concatenate(right).astype(np.int64))


def _packed(names: list[int], payloads: list[bytes], kind: int = 1) -> pa.Table:
    return pa.table({"kind": pa.array([kind] * len(names), pa.int32()), "b": pa.array(names, pa.int32()), "payload": pa.array(payloads, pa.binary())})


def _set_bucket(d1: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(d1.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _open_lists(key, table):
    """One index bucket: its lists of two or more sets, in order."""
    e, _ = _lists(unpack(table.column("payload"), ENTRY))
    names, payloads = pack(np.full(len(e), key[0].as_py()), e)
    return _packed(names, payloads)


def _asks(buckets: int):
    """One index bucket: the sets in its lists of two or more, with the bucket's number, dealt by set."""

    def run(key, table):
        e, _ = _lists(unpack(table.column("payload"), ENTRY))
        node = np.zeros(len(e), NODE)
        node["d1"], node["d2"] = e["d1"], e["d2"]
        node = np.unique(node)
        ask = np.zeros(len(node), ASK)
        ask["d1"], ask["d2"], ask["b"] = node["d1"], node["d2"], key[0].as_py()
        return _packed(*pack(_set_bucket(ask["d1"], buckets), ask))

    return run


def _nodes(key, table):
    """One bucket of sets: those that are asked for."""
    asked = unpack(table.column("payload"), ASK)
    node = np.zeros(len(asked), NODE)
    node["d1"], node["d2"] = asked["d1"], asked["d2"]
    node = np.unique(node)
    return pa.table({n: pa.array(node[n].astype(np.int64), pa.int64()) for n in ("d1", "d2")})


def _counted(part: np.ndarray) -> np.ndarray:
    """(d1, d2, c): the records of each set."""
    node = np.zeros(len(part), NODE)
    node["d1"], node["d2"] = part["d1"], part["d2"]
    node, count = np.unique(node, return_counts=True)
    out = np.zeros(len(node), LABEL)
    out["d1"], out["d2"], out["c"] = node["d1"], node["d2"], count
    return out


def _set_tokens(buckets: int, hot):
    """Token sets as packed tokens (kind 1); hot tokens count as shared at once (2, by set)."""

    def flush(part):
        table = np.concatenate(part)
        t = mix(table["t"])
        known = _is_hot(t, hot.value)
        yield packed_rows(1, *pack((t[~known] % np.uint64(buckets)).astype(np.int64), table[~known]))
        if known.any():
            own = _counted(table[known])
            yield packed_rows(2, *pack(_set_bucket(own["d1"], buckets), own))

    def run(batches):
        part, size = [], 0
        for b in batches:
            for d1, d2, tokens in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                s = np.frombuffer(tokens, np.uint64)
                t = np.zeros(len(s), OWNED)
                t["d1"], t["d2"], t["t"] = d1, d2, s
                part.append(t)
                size += len(t)
                if size > 200_000:
                    yield from flush(part)
                    part, size = [], 0
        if part:
            yield from flush(part)

    return run


def _shared_counts(buckets: int):
    """One token bucket: how many of its tokens each set shares with another, dealt by set."""

    def run(key, table):
        kind = table.column("kind").to_numpy()
        hot = table.filter(pa.array(kind == 2))
        t = unpack(table.filter(pa.array(kind == 1)).column("payload"), OWNED)
        t = t[np.argsort(t["t"], kind="stable")]
        same = t["t"][1:] == t["t"][:-1]
        t = t[np.r_[False, same] | np.r_[same, False]] if len(t) else t
        out = _counted(t)
        got = _packed(*pack(_set_bucket(out["d1"], buckets), out))
        return pa.concat_tables([got, _packed(hot.column("b").to_pylist(), hot.column("payload").to_pylist())])

    return run


def _first_pairs(buckets: int):
    """One index bucket and the shared counts of its sets that can have a partner: star pairs."""

    def run(left, right):
        known = unpack(right.column("payload"), LABEL)
        e, at = _present(unpack(left.column("payload"), ENTRY), known)
        c = known["c"][at]
        size = np.diff(np.flatnonzero(np.r_[True, e["sig"][1:] != e["sig"][:-1], True])) if len(e) else np.zeros(0, np.int64)
        keep = np.repeat(size > 1, size)
        pairs = _stars(e[keep], np.r_[0, np.cumsum(size[size > 1])], c[keep])
        return _packed(*pack((mix(pairs["a1"].astype(np.uint64) ^ mix(pairs["b1"].astype(np.uint64))) % np.uint64(buckets)).astype(np.int64), pairs))

    return run


def _present(e: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of known sets, by list and size, and each one's place in ``known``."""
    at = _find(e, known)
    e, at = e[at >= 0], at[at >= 0]
    by = np.lexsort((e["d2"], e["d1"], e["n"], e["sig"]))
    return e[by], at[by]


def _find(e: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The place in ``known`` of each entry's set, or -1."""
    of = {k: i for i, k in enumerate(zip(known["d1"].tolist(), known["d2"].tolist()))}
    return np.array([of.get(k, -1) for k in zip(e["d1"].tolist(), e["d2"].tolist())], np.int64)


def _unique(dtype, names: str):
    """One bucket of packed records: the distinct ones as rows."""

    def run(key, table):
        got = np.unique(unpack(table.column("payload"), dtype))
        return pa.table({n: pa.array(np.ascontiguousarray(got[n]), pa.int64()) for n in names.split()})

    return run


def _verify(pairs: DataFrame, sets: DataFrame, buckets: int) -> DataFrame:
    """(a, b) representatives of the pairs (a1, a2, b1, b2) that reach the threshold.

    A pair travels with the second set; the first one is sent once to each
    bucket that asks for it. A set in very many pairs is spread over several
    buckets, by the number of its pairs.
    """
    pairs = common.stage(pairs, "pairs")
    degree = pairs.groupBy("a1", "a2").agg((F.floor(F.count("*") / 256) + 1).alias("salts"))
    spread = F.pmod(F.xxhash64("a1", "a2", F.pmod(F.col("b1"), F.col("salts"))), F.lit(buckets)).cast("int")
    right = pairs.join(degree, ["a1", "a2"]).withColumn("w", spread)
    right = common.stage(right.select("a1", "a2", "b1", "b2", "w"), "spread")
    need = common.again(right).select("a1", "a2", "w").distinct()
    # the token sets are shuffled at every size, so that costs follow the input
    left = need.hint("merge").join(sets.select(F.col("d1").alias("a1"), F.col("d2").alias("a2"), F.col("rep").alias("a_rep"), F.col("tokens").alias("a_tokens")), ["a1", "a2"])
    right_sets = right.hint("merge").join(common.again(sets).select(F.col("d1").alias("b1"), F.col("d2").alias("b2"), F.col("rep").alias("b_rep"), F.col("tokens").alias("b_tokens")), ["b1", "b2"])

    def compare(l: pa.Table, r: pa.Table) -> pa.Table:
        have = {(x, y): (rep, t) for x, y, rep, t in zip(l.column("a1").to_pylist(), l.column("a2").to_pylist(), l.column("a_rep").to_pylist(), l.column("a_tokens").to_pylist())}
        a_out, b_out = [], []
        for x, y, rep, t in zip(r.column("a1").to_pylist(), r.column("a2").to_pylist(), r.column("b_rep").to_pylist(), r.column("b_tokens").to_pylist()):
            a_rep, a = have[x, y]
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(t, np.uint64)
            if len(a) > len(b):
                a, b = b, a
            both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
            if 100 * both >= 75 * (len(a) + len(b) - both):
                a_out.append(a_rep)
                b_out.append(rep)
        return pa.table({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})

    links = left.groupBy("w").cogroup(right_sets.groupBy("w")).applyInArrow(compare, "a long, b long")
    links = common.stage(links, "links")
    common.discard(pairs, right)
    return links


def _answers(dtype):
    """One bucket of sets: what index buckets ask for, dealt by the asking bucket.

    The right side holds shared counts by token bucket (kind 1) and the sets
    themselves (2). A set that shares under three quarters of its tokens with
    all others has no partner and gets no answer.
    """

    def run(left, right):
        asked = unpack(left.column("payload"), ASK)
        kind = right.column("kind").to_numpy()
        part, known = (unpack(right.filter(pa.array(kind == k)).column("payload"), t) for k, t in ((1, LABEL), (2, KNOWN)))
        at = _find(part, known)
        c = np.bincount(at[at >= 0], part["c"][at >= 0], minlength=len(known)).astype(np.int64)
        at = _find(asked, known)
        if len(known):
            at = np.where((at >= 0) & (4 * c[at] >= 3 * known["n"][at]), at, -1)
        ok = at >= 0
        out = np.zeros(int(ok.sum()), dtype)
        for name in dtype.names:
            out[name] = known[name][at[ok]]
        if dtype is LABEL:
            out["c"] = c[at[ok]]
        return _packed(*pack(asked["b"][ok].astype(np.int64), out))

    return run


def _torn():
    """Index lists with the components and representatives of the members that can have a partner.

    Where a list's members lie in several components they are tied into one
    bundle: a star of edges, not pairs. The members of a split list are tied to
    a node that stands for the list, as no task sees it whole.
    """

    def run(left, right):
        known = unpack(right.column("payload"), KNOWN)
        e, at = _present(unpack(left.column("payload"), ENTRY), known)
        of_list = np.cumsum(np.r_[True, e["sig"][1:] != e["sig"][:-1]]) if len(e) else np.zeros(0, np.int64)
        split = e["sig"] & np.uint64(1) == 1
        whole = np.zeros(int(split.sum()), TIE)
        whole["a"], whole["b"] = (e["sig"][split] & ~SUB).astype(np.int64), known["rep"][at[split]]
        long = (np.bincount(of_list)[of_list] > SMALL) & ~split if len(e) else np.zeros(0, bool)  # the others were compared in full
        of_list, at = of_list[long], at[long]
        n, label, rep = e["n"][long].astype(np.int64), known["c"][at], known["rep"][at]
        out = np.zeros(0, TIE)
        if len(n) > 1:
            # members further apart in size than 3 to 4 start another star
            start = np.flatnonzero(np.r_[True, (of_list[1:] != of_list[:-1]) | (3 * n[1:] > 4 * n[:-1])])
            size = np.diff(np.r_[start, len(n)])
            torn = np.repeat(np.minimum.reduceat(label, start) != np.maximum.reduceat(label, start), size)
            head = np.repeat(rep[start], size)
            out = np.zeros(int(torn.sum()), TIE)
            out["a"], out["b"] = head[torn], rep[torn]
            out = out[out["a"] != out["b"]]
        out = _spanning(np.unique(np.concatenate([out, whole])))
        return pa.table({"a": pa.array(np.ascontiguousarray(out["a"])), "b": pa.array(np.ascontiguousarray(out["b"]))})

    return run


def _spanning(ties: np.ndarray) -> np.ndarray:
    """As few ties as connect the same members."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in zip(ties["a"].tolist(), ties["b"].tolist()):
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return np.array([(find(x), x) for x in list(root) if find(x) != x], TIE)


def _forest(key, table):
    """A part of all ties, thinned."""
    ties = np.zeros(table.num_rows, TIE)
    ties["a"], ties["b"] = table.column("a").to_numpy(), table.column("b").to_numpy()
    out = _spanning(ties)
    return pa.table({"a": pa.array(np.ascontiguousarray(out["a"])), "b": pa.array(np.ascontiguousarray(out["b"]))})


#: Ties that one task thins, on average.
TIES = 1 << 20


def _thinned(ties: DataFrame) -> DataFrame:
    """Ties that connect the same members: parts of bounded size are thinned, in as many levels as it takes until one part is left or a level brings little."""
    ties = common.stage(ties, "ties")
    left = ties.count()
    while left:
        parts = -(-left // TIES)
        fewer = common.stage(ties.withColumn("g", F.pmod(F.xxhash64("a", "b"), F.lit(parts))).groupBy("g").applyInArrow(_forest, "a long, b long"), "ties")
        common.discard(ties)
        ties, before, left = fewer, left, fewer.count()
        if parts == 1 or left > 0.8 * before:
            break
    return ties


def _bundle_links(cells: pa.Table) -> pa.Table:
    """Cells of two blocks of a bundle: the sets of the left one against those of the right one; links to other components."""
    a_out, b_out = [], []
    bundle, block = cells.column("bundle").to_numpy(), cells.column("block").to_numpy()
    order = np.lexsort((cells.column("rep").to_numpy(), block, bundle))
    edges = np.flatnonzero(np.r_[True, (bundle[order][1:] != bundle[order][:-1]) | (block[order][1:] != block[order][:-1]), True]) if len(order) else np.zeros(1, np.int64)
    data = cells.column("tokens")
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
        at = pa.array(order[lo:hi])
        sets = [np.frombuffer(t, np.uint64) for t in data.take(at).to_pylist()]
        rep, comp, left, right = (cells.column(c).take(at).to_numpy(zero_copy_only=False) for c in ("rep", "component", "is_left", "is_right"))
        asked, held = np.flatnonzero(left), np.flatnonzero(right)
        if not len(asked) or not len(held):
            continue
        n = np.array([len(x) for x in sets])
        token, back, df = np.unique(np.concatenate([sets[k] for k in held]), return_inverse=True, return_counts=True)
        posting = np.repeat(np.arange(len(held)), n[held])[np.argsort(back, kind="stable")]
        ends = np.cumsum(df)
        for x in asked.tolist():
            mine = np.minimum(np.searchsorted(token, sets[x]), len(token) - 1)
            mine = mine[token[mine] == sets[x]]
            if right[x]:
                mine = mine[df[mine] > 1]
            if not len(mine):
                continue
            both = np.bincount(np.concatenate([posting[ends[t] - df[t] : ends[t]] for t in mine.tolist()]), minlength=len(held))
            hit = np.flatnonzero((100 * both >= 75 * (n[x] + n[held] - both)) & (comp[held] != comp[x]))
            if len(hit):
                hit = held[hit[np.unique(comp[held[hit]], return_index=True)[1]]]  # one link to each other component
                a_out += [rep[x]] * len(hit)
                b_out += rep[hit].tolist()
    return pa.table({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})


#: Times the members that the cells of one part hold, about.
COPIES = 2
#: Bundles of several components whose plan may be broadcast; beyond, the plan is joined by shuffling.
PLANS = 200_000


def _bundled(kept: DataFrame, groups: DataFrame, ties: DataFrame, buckets: int) -> DataFrame:
    """Links between components inside the bundles that ``ties`` connect.

    Sets of a bundle's largest component need to meet the others only, not each
    other. They and the rest are dealt into blocks of bounded size; each block of
    the rest meets every block in a task of its own, where tokens are counted
    through one inverted index. A bundle of one component has nothing to find.
    """
    bundles = components(ties)
    label = groups.select(F.col("node").alias("rep"), "component")
    members = kept.join(bundles.select(F.col("node").alias("rep"), F.col("component").alias("bundle")).hint("merge"), "rep").join(label.hint("merge"), "rep", "left").select("rep", "tokens", "bundle", F.coalesce("component", "rep").alias("component"))
    members = common.stage(members, "members")
    sizes = common.stage(members.groupBy("bundle", "component").agg(F.count("*").alias("n")), "sizes")
    plan = sizes.groupBy("bundle").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    plan = common.stage(plan.select("bundle", F.col("top.component").alias("main"), blocks(F.col("n") - F.col("top.n")).alias("rows"), blocks(F.col("top.n")).alias("cols")), "plan")
    rest, h = F.col("component") != F.col("main"), F.xxhash64("rep")
    own = F.when(rest, F.pmod(h, F.col("rows"))).otherwise(F.col("rows") + F.pmod(h, F.col("cols"))).cast("int")
    last = F.when(rest, F.col("rows") + F.col("cols")).otherwise(F.col("rows")) - 1
    small = plan.count() <= PLANS
    both = F.col("rows") + F.col("cols")
    # copies of sets that all cells hold, against the sets: where bundles are large, cells are made in parts, so that a part is about as large as the members
    copies, one = common.again(plan).join(common.again(sizes).hint("merge"), "bundle").agg(F.sum(F.col("n") * F.when(F.col("component") != F.col("main"), both).otherwise(F.col("rows"))), F.sum("n")).first()
    parts = max(1, -(-(copies or 0) // (COPIES * (one or 1))))
    found = []
    for part in range(parts):
        cells = common.again(members).join(F.broadcast(common.again(plan)) if small else common.again(plan).hint("merge"), "bundle")
        cells = cells.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
        cells = cells.withColumn("block", F.least("own", "other").cast("long") * both + F.greatest("own", "other"))
        if parts > 1:
            cells = cells.where(F.pmod(F.xxhash64("block", "bundle"), F.lit(parts)) == part)
        cells = cells.select("bundle", "block", "rep", "component", "tokens", (F.col("own") <= F.col("other")).alias("is_left"), (F.col("own") >= F.col("other")).alias("is_right"), F.pmod(F.xxhash64("bundle", "block"), F.lit(buckets)).cast("int").alias("w"))
        found.append(common.stage(cells.groupBy("w").applyInArrow(_bundle_links, "a long, b long"), "bundle-links"))
        if parts > 1:
            common.release(members.sparkSession)
    links = found[0]
    if parts > 1:
        links = common.stage(functools.reduce(DataFrame.union, found), "bundle-links")
        common.discard(*found)
    common.discard(members, sizes, plan, bundles)
    return links


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    spark = docs.sparkSession
    common.small_batches(spark)
    every = common.texts(docs, id_col, text_col)
    base = every.where("_id IS NOT NULL")
    buckets = common.buckets(docs)  # a bucket is taken whole into memory
    hot = spark.sparkContext.broadcast(hot_tokens(base))
    by_token = base.mapInArrow(_prefixes(buckets, hot), PACKED)
    by_set = by_token.groupBy("b").applyInArrow(_shared(buckets), PACKED)
    index = common.stage(by_set.groupBy("b").applyInArrow(_index(buckets), PACKED), "index")
    common.release(spark)

    def open_docs(batches):
        for b in batches:
            t = unpack(b.column(0), DOC)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(t[n])) for n in ("id", "d1", "d2", "n")], names=["doc_id", "d1", "d2", "n"])

    rows = common.stage(index.where("kind = 0").select("payload").mapInArrow(open_docs, "doc_id long, d1 long, d2 long, n long"), "rows")
    sets = common.stage(rows.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "sets")
    entered = index.where("kind = 1").select("b", "payload")
    long_lists = hot_lists(index, rows.count())
    if long_lists:
        entered = entered.mapInArrow(_split(buckets, spark.sparkContext.broadcast(long_lists)), PACKED).select("b", "payload")
    lists = common.stage(entered.groupBy("b").applyInArrow(_open_lists, PACKED), "lists")

    common.discard(index)

    def entries():
        return common.again(lists).select("b", "payload")

    asks = common.stage(entries().groupBy("b").applyInArrow(_asks(buckets), PACKED), "asks")
    nodes = asks.select("b", "payload").groupBy("b").applyInArrow(_nodes, "d1 long, d2 long")
    wanted = common.stage(nodes.join(sets, ["d1", "d2"]).select(F.col("rep").alias("_id"), "d1", "d2"), "wanted")
    bits = spark.sparkContext.broadcast(_bits(wanted))

    def tokens(batches):
        hashes, have = WordHashes(), bits.value
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [])
            b = b.filter(pa.array(_marked(b.column(0).to_numpy(), have)))
            for i, t in zip(*(c.to_pylist() for c in b.columns)):
                s = shingle_set(hashes.of(t.lower().split()), SHINGLE)
                for o, v in zip(out, (i, *set_digest(s), s.tobytes())):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(o, pa.int64()) for o in out[:3]), pa.array(out[3], pa.binary())], names=["_id", "d1", "d2", "tokens"])

    # texts do not travel, only token sets; another row of a repeated id may have another set, which is not wanted
    found = base.select("_id", "_text").mapInArrow(tokens, "_id long, d1 long, d2 long, tokens binary")
    kept = common.again(wanted).hint("merge").join(found, ["_id", "d1", "d2"]).select("d1", "d2", F.col("_id").alias("rep"), "tokens")
    kept = common.stage(kept, "tokens")
    common.release(spark)
    shared = kept.select("d1", "d2", "tokens").mapInArrow(_set_tokens(buckets, hot), PACKED).groupBy("b").applyInArrow(_shared_counts(buckets), PACKED)
    shared = common.stage(shared, "shared")

    def known(table):
        """(d1, d2, n, c, rep) rows, packed by set."""

        def run(batches):
            for b in batches:
                t = np.zeros(b.num_rows, KNOWN)
                for k, name in enumerate(KNOWN.names):
                    t[name] = b.column(k).to_numpy()
                yield packed_rows(2, *pack(_set_bucket(t["d1"], buckets), t))

        return table.select("d1", "d2", "n", "c", "rep").mapInArrow(run, PACKED)

    def answered(table, dtype):
        right = known(table).union(common.again(shared))
        return common.stage(common.again(asks).groupBy("b").cogroup(right.groupBy("b")).applyInArrow(_answers(dtype), PACKED), "answers")

    size = (F.length("tokens") / 8).cast("long").alias("n")
    counts = answered(common.again(kept).select("d1", "d2", size, F.lit(0).cast("long").alias("c"), "rep"), LABEL)
    common.release(spark)
    first = entries().groupBy("b").cogroup(counts.groupBy("b")).applyInArrow(_first_pairs(buckets), PACKED)
    pairs = first.groupBy("b").applyInArrow(_unique(PAIR, "a1 a2 b1 b2"), "a1 long, a2 long, b1 long, b2 long")
    links = _verify(pairs, kept, buckets)
    groups = components(links)

    # the lists meet the components of their members; each index bucket asks for the sets it holds, once
    of = common.again(kept).select("d1", "d2", size, "rep").join(groups, F.col("rep") == F.col("node"), "left").select("d1", "d2", "n", F.coalesce("component", "rep").alias("c"), "rep")
    answers = answered(of, KNOWN)
    ties = _thinned(entries().groupBy("b").cogroup(answers.groupBy("b")).applyInArrow(_torn(), "a long, b long"))
    common.release(spark)
    more = _bundled(common.again(kept).select("rep", "tokens"), groups, ties, buckets)
    common.discard(lists, asks, wanted, kept, shared, counts, answers, ties)
    final = components(links.union(more))
    of_set = common.stage(sets.join(final, sets.rep == final.node, "left").select("d1", "d2", F.coalesce("component", "rep").alias("component_id")), "of-set")
    common.discard(sets, links, more, groups, final)
    out = rows.join(of_set, ["d1", "d2"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))

    def sizes(batches):
        hashes = WordHashes()
        for b in batches:
            n = [len(shingle_set(hashes.of(t.lower().split()), SHINGLE)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), b.column(0)], names=["doc_id", "n_shingles", "component_id"])

    return out.union(every.where("_id IS NULL").mapInArrow(sizes, "doc_id long, n_shingles long, component_id long"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, unchanged, that are the first of their component; unlinked ones and those without an id all stay."""
    groups = similar_components(docs)
    first = groups.where("doc_id = component_id").select(F.col("doc_id").alias("_keep"))
    return docs.join(first, docs.doc_id == first._keep, "left_semi").union(docs.where(docs.doc_id.isNull()))

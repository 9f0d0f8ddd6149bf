"""SentencePiece BPE encoding and decoding with vectorised merge rounds.

The model file is read here (its protobuf fields are few). A normalised text
splits into segments no merge can cross: before a space that follows another
character, around characters that occur in no longer piece, and between a
letter and a character that follows a letter in no piece. New segments
of a batch become one flat numpy array of symbols; each round takes the
smallest pair rank of every segment that still has a pair, merges its leftmost
occurrences at once as long as the one-by-one order would do the same, and
compacts the array, until no pair remains. A document is the concatenation of
its segments' ids.

Defined cases: null is empty; an empty text encodes as the end id alone;
characters without a piece fall back to bytes; equal pair ranks merge from the
left; repeated rows give equal rows, and null ids stay null; texts of any length
are encoded whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import gc
import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
CACHE = 350_000
NONE = np.iinfo(np.int64).max


def _fields(data: bytes):
    """(number, value) of a protobuf message: varints, fixed32 as bytes, and byte strings."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + n]
            at += n


class PieceModel:
    """Pieces, scores and normaliser flags of a BPE model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.pieces, self.kinds, scores = [], [], []
        self.dummy_prefix, self.squeeze, self.escape, charsmap = True, True, True, b""
        for number, value in _fields(data):
            if number == 1:
                got = dict(_fields(value))
                self.pieces.append(got.get(1, b"").decode())
                scores.append(struct.unpack("<f", got[2])[0] if 2 in got else 0.0)
                self.kinds.append(got.get(3, NORMAL))
            elif number == 3:
                got = dict(_fields(value))
                charsmap = got.get(2, b"")
                self.dummy_prefix, self.squeeze, self.escape = (bool(got.get(k, 1)) for k in (3, 4, 5))
        if charsmap or self.squeeze or not self.escape or USER in self.kinds:
            raise ValueError("only models with the identity normaliser, kept spaces and no user symbols are read")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k in (NORMAL, UNUSED)}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        self.unk = self.kinds.index(UNKNOWN)
        self.end = self.pieces.index("</s>")
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in self.ids.values()}, reverse=True))}
        pairs = sorted((self.ids[p[:c]] << 32 | self.ids[p[c:]], order[scores[i]], i) for p, i in self.ids.items() for c in range(1, len(p)) if p[:c] in self.ids and p[c:] in self.ids)
        self.pair_key = np.array([x[0] for x in pairs], np.int64)
        self.pair_rank = np.array([x[1] for x in pairs], np.int64)
        self.pair_id = np.array([x[2] for x in pairs], np.int64)
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        follows = {(x, y) for p in self.ids for x, y in zip(p, p[1:])}
        after_letter = {y for x, y in follows if x.isalpha()}
        letters = "".join(map(re.escape, sorted(c for c in joined if c.isalpha())))
        ends = "".join(map(re.escape, sorted(joined - {SPACE} - after_letter)))  # no piece holds one of these behind a letter
        runs = "".join(map(re.escape, sorted((joined - {SPACE}) & after_letter)))
        inner = "".join(map(re.escape, sorted(joined - {SPACE})))
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("a piece holds a space behind another character")
        more = f"(?:[{runs}]|(?<![{letters}])[{ends}])*" if ends and letters else f"[{inner}]*"
        self.split = re.compile(f"{SPACE}+{more}|[{inner}]{more}|[^{inner}{SPACE}]")
        self.store: dict[str, tuple[int, bytes, str]] = {}
        self.old: dict[str, tuple[int, bytes, str]] = {}
        self.id_text = [str(i).encode() for i in range(len(self.pieces))]
        self.piece_text = [p.replace(SPACE, " ") for p in self.pieces]
        self.plain = [k in (NORMAL, UNUSED) for k in self.kinds]

    def _pairs(self, left: np.ndarray, right: np.ndarray):
        """Rank and merged id of pairs of symbols."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        hit = (self.pair_key[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.pair_rank[at], NONE), np.where(hit, self.pair_id[at], -1)

    def merge(self, segments: list[str]) -> list[list[int]]:
        """Symbol ids of each segment after all merges; characters without a piece are -1 - code point.

        ``rank[i]`` and ``merged[i]`` belong to the pair of symbols i and i + 1;
        after a round only the pairs beside a merged symbol are looked up again.
        """
        flat = "".join(segments)
        points = np.frombuffer(flat.encode("utf-32-le"), "<u4").astype(np.int64)
        uniq, back = np.unique(points, return_inverse=True)
        sym = np.array([self.ids.get(chr(c), -1 - int(c)) for c in uniq], np.int64)[back] if len(points) else points
        seg = np.repeat(np.arange(len(segments)), [len(s) for s in segments])
        rank, merged = np.full(len(sym), NONE), np.full(len(sym), -1)
        if len(sym) > 1:
            rank[:-1], merged[:-1] = self._pairs(sym[:-1], sym[1:])
            cut = np.flatnonzero(seg[1:] != seg[:-1])
            rank[cut] = NONE
        done_seg, done_sym = [], []
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(sym)]))
            live = best < NONE
            if not live.all():  # segments without a pair leave the array
                done_seg.append(seg[~live])
                done_sym.append(sym[~live])
                sym, seg, rank, merged, best = sym[live], seg[live], rank[live], merged[live], best[live]
                if not len(sym):
                    break
            hit = self._leftmost(np.flatnonzero(rank == best), sym, seg, best, merged)
            sym[hit] = merged[hit]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            at = (np.cumsum(keep) - 1)[hit]
            sym, seg, rank, merged = sym[keep], seg[keep], rank[keep], merged[keep]
            at = np.concatenate([at, at[at > 0] - 1])
            inside = at + 1 < len(sym)
            rank[at[~inside]] = NONE
            at = at[inside]
            r, m = self._pairs(sym[at], sym[at + 1])
            rank[at], merged[at] = np.where(seg[at] == seg[at + 1], r, NONE), m
        out: list[list[int]] = [[] for _ in segments]
        if done_sym:
            seg, sym = np.concatenate(done_seg), np.concatenate(done_sym)
            by = np.argsort(seg, kind="stable")
            seg, flat_ids = seg[by], sym[by].tolist()
            edges = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            ends = np.r_[edges[1:], len(flat_ids)].tolist()
            for s, lo, hi in zip(seg[edges].tolist(), edges.tolist(), ends):
                out[s] = flat_ids[lo:hi]
        return out

    def _leftmost(self, hit, sym, seg, best, merged):
        """The occurrences of each segment's best pair that merging one by one would also take first."""
        # overlapping runs (AAAA): every other one from the run's left end
        run = np.flatnonzero(np.r_[True, np.diff(hit) != 1])
        inside = np.arange(len(hit)) - np.repeat(run, np.diff(np.r_[run, len(hit)]))
        hit = hit[inside % 2 == 0]
        own = seg[hit]
        first = np.r_[True, own[1:] != own[:-1]]
        if first.all():
            return hit
        # an occurrence may go along only while no merge before it makes a pair as good as this one
        m, b = merged[hit], best[hit]
        left = np.where(hit > 0, hit - 1, 0)
        right = np.minimum(hit + 2, len(sym) - 1)
        has_left = (hit > 0) & (seg[left] == own)
        has_right = (hit + 2 < len(sym)) & (seg[right] == own)
        before = np.r_[False, (hit[1:] - hit[:-1] == 2) & ~first[1:]]
        options = [(np.where(before, np.r_[-1, m[:-1]], sym[left]), m, has_left), (m, sym[right], has_right), (m, m, has_right), (sym[left], m, has_left)]
        bad = np.zeros(len(hit), bool)
        for a, c, ok in options:
            key = a << 32 | c
            at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            bad |= ok & (a >= 0) & (c >= 0) & (self.pair_key[at] == key) & (self.pair_rank[at] <= b)
        start = np.flatnonzero(first)
        count = np.cumsum(bad) - bad  # bad ones strictly before, over all
        base = np.repeat(count[start], np.diff(np.r_[start, len(hit)]))
        return hit[count - base == 0]

    def learn(self, segments) -> dict[str, tuple[int, bytes, str]]:
        """The store with every one of ``segments``: (ids, ids as text, decoded text).

        Two generations bound it: a full young one becomes the old one, and
        what is still used moves back.
        """
        young, old = self.store, self.old
        missing = [s for s in segments if s not in young]
        if len(young) + len(missing) > CACHE:
            self.old, self.store = old, young = young, {}
            missing = list(segments)
        new = []
        for s in missing:
            got = old.get(s)
            if got is None:
                new.append(s)
            else:
                young[s] = got
        names, texts, kinds = self.id_text, self.piece_text, self.plain
        for lo in range(0, len(new), 4000):
            part = new[lo : lo + 4000]
            for s, sym in zip(part, self.merge(part)):
                if min(sym) >= 0 and all([kinds[i] for i in sym]):
                    young[s] = len(sym), b" ".join([names[i] for i in sym]), "".join([texts[i] for i in sym])
                    continue
                ids: list[int] = []
                for x in sym:
                    if x >= 0:
                        ids.append(x)
                    else:
                        raw = chr(-1 - x).encode("utf-8")
                        ids.extend(self.byte_ids[c] for c in raw) if self.byte_ids else ids.append(self.unk)
                young[s] = len(ids), b" ".join([names[i] for i in ids]), self.text_of(ids)
        return young

    def segments(self, text: str) -> list[str]:
        if not text:
            return []
        text = text.replace(" ", SPACE)
        return self.split.findall(SPACE + text if self.dummy_prefix else text)

    def text_of(self, ids) -> str:
        """Pieces of ``ids`` joined, byte runs as UTF-8, spaces unescaped; a leading space stays."""
        out, raw = [], bytearray()
        for i in ids:
            if i in self.bytes_of:
                raw.append(self.bytes_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if self.kinds[i] == UNKNOWN:
                out.append(" ⁇ ")
            elif self.kinds[i] != CONTROL:
                out.append(self.pieces[i].replace(SPACE, " "))
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)

    def encode(self, text: str) -> list[int]:
        segments = self.segments(text)
        store = self.learn(set(segments))
        return [int(i) for s in segments for i in store[s][1].split()] + [self.end]

    def decode(self, ids: list[int]) -> str:
        text = self.text_of(ids)
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def piece_codes(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) themselves, for use as a stage of its own."""
    common.small_batches(docs.sparkSession)

    def run(batches):
        model = PieceModel(model_path)
        for b in batches:
            ids = [model.encode(t.decode("utf-8", "replace")) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([model.decode(i) for i in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return common.texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def piece_digest(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    common.small_batches(docs.sparkSession)

    def run(batches):
        gc.set_threshold(200_000, 50, 50)  # the store is large and has no cycles
        model = PieceModel(model_path)
        end = str(model.end).encode()
        for b in batches:
            texts = b.column(1).to_pylist()
            n, enc, dec = [], [], []
            for lo in range(0, len(texts), 250):
                rows = [model.segments(t.decode("utf-8", "replace")) for t in texts[lo : lo + 250]]
                store = model.learn(set().union(*rows))
                for row in rows:
                    got = [store[s] for s in row]
                    n.append(sum([g[0] for g in got]) + 1)
                    enc.append(hashlib.sha256(b" ".join([*[g[1] for g in got], end])).hexdigest())
                    text = "".join([g[2] for g in got])
                    dec.append(hashlib.sha256((text[1:] if model.dummy_prefix and text[:1] == " " else text).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(enc, pa.string()), pa.array(dec, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return common.texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

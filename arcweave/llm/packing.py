"""Best-fit-decreasing packing of tokenised documents into fixed-length sequences.

Pass 1 tokenises whole texts (white-space separated chunks are encoded once
and remembered; the tokenizer never joins tokens across white space), appends
the end id, cuts only documents longer than the capacity, and writes one row
per piece with its local rank among the task's pieces of the same length.

Best fit decreasing looks at lengths alone, so the plan is made from the
histogram of lengths, which has ``capacity`` rows at most whatever the corpus:
a segment tree over remaining capacities finds the tightest open bin in
logarithmic time, and equal pieces that meet equal bins are placed in one
step. A step gives a run of (length, first rank) -> (first bin, offset). Pass 2
turns each piece's local rank into a global one with a prefix sum over tasks,
and a lookup in the runs gives its bin. No piece is ever gathered.

Defined cases: null and empty texts pack as the end id alone; a full piece
fills a sequence of its own; repeated rows, rows that share an id and rows
without one are separate pieces; pieces of equal length are placed in the order
of their tasks; texts of any length are encoded whole; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import gc
import string
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

CAPACITY, END_ID = 4096, 1
#: Remembered chunks of one worker and generation.
CACHE = 1_200_000
#: ASCII punctuation.
MARKS = string.punctuation.encode()


class FitTree:
    """Segment tree over remaining capacities 0..n: counts of open bins, tightest fit by descent."""

    def __init__(self, n: int):
        self.size = 1
        while self.size < n + 1:
            self.size *= 2
        self.count = [0] * (2 * self.size)

    def add(self, at: int, by: int) -> None:
        i = at + self.size
        while i:
            self.count[i] += by
            i //= 2

    def at(self, i: int) -> int:
        return self.count[i + self.size]

    def tightest(self, least: int) -> int:
        """The smallest remaining capacity of at least ``least`` that an open bin has, or -1."""
        i = least + self.size
        if self.count[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return -1


def best_fit_runs(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, count, first bin, offset) runs of best fit decreasing.

    Bins with equal remaining capacity are interchangeable, so each capacity
    keeps ranges of bin numbers; only whole ranges or their heads are moved.
    """
    tree, ranges, runs, opened = FitTree(capacity), {}, [], 0
    for length in sorted(histogram, reverse=True):
        todo, rank = histogram[length], 0
        while todo:
            room = tree.tightest(length)
            if room < 0:
                room, first, n = capacity, opened, -(-todo // (capacity // length))
                opened += n
            else:
                first, n = ranges[room].pop()
                tree.add(room, -n)
            # a bin that took a piece is the tightest one while another fits, so it takes all that fit
            per = room // length
            full, rest = divmod(min(todo, n * per), per)
            for part, bins in ((per, full), (rest, 1 if rest else 0), (0, n - full - (1 if rest else 0))):
                if not bins:
                    continue
                for slot in range(part):
                    runs.append((length, rank + slot * bins, bins, first, capacity - room + slot * length))
                left = room - part * length
                ranges.setdefault(left, []).append((first, bins))
                tree.add(left, bins)
                first += bins
                rank += part * bins
                todo -= part * bins
    return runs


def _letters(chunk: bytes) -> str:
    """Whether the tokenizer sees letters alone once it has normalised the chunk: "" or where they are from."""
    if chunk.isascii():
        return "ascii" if chunk.isalpha() else ""
    text = chunk.decode("utf-8", "replace")
    if not text.isalpha():
        return ""
    if max(text) < "\u0100":
        return "latin"
    return "any" if unicodedata.normalize("NFC", text).lower().isalpha() else ""


class Chunks:
    """Little-endian uint32 ids of white-space separated chunks, remembered in two generations."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        # the same merges without the normaliser and the pattern, for words that need neither
        ascii, latin = Tokenizer.from_file(path), Tokenizer.from_file(path)
        ascii.normalizer = latin.normalizer = None
        ascii.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        latin.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.by = {"ascii": ascii, "latin": latin, "any": self.tok}
        self.ends = np.zeros(self.tok.get_vocab_size() + 1, bool)
        for token, i in self.tok.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _encode(self, chunks: list[bytes]) -> list[bytes]:
        got = self.tok.encode_batch_fast([c.decode("utf-8", "replace") for c in chunks], add_special_tokens=False)
        return [np.asarray(e.ids, "<u4").tobytes() for e in got]

    def _words(self, words: list[bytes], kind: str) -> list[bytes]:
        """Words of letters alone, encoded as one text and cut at the tokens that end a word."""
        text = b" ".join(words).decode("utf-8", "replace")
        # ASCII and Latin letters lower one by one, as the tokenizer does it
        e = self.by[kind].encode_batch_fast([text if kind == "any" else text.lower()], add_special_tokens=False)[0]
        ids = np.asarray(e.ids, "<u4")
        ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
        if len(ends) != len(words) or ends[-1] != len(ids):
            return self._encode(words)
        raw = ids.tobytes()
        return [raw[4 * i : 4 * j] for i, j in zip([0, *ends], ends)]

    def get(self, chunks: set[bytes]) -> dict[bytes, bytes]:
        """A dictionary that holds every one of ``chunks``."""
        young, old = self.young, self.old
        missing = [c for c in chunks if c not in young]
        if len(young) + len(missing) > CACHE:
            self.old, self.young = old, young = young, {}
            missing = list(chunks)
        words: dict[str, list[bytes]] = {"ascii": [], "latin": [], "any": []}
        plain, other, tailed = words["ascii"], [], []
        for c in missing:
            got = old.get(c)
            if got is not None:
                young[c] = got
                continue
            if c.isalpha():  # ASCII letters, the usual case
                plain.append(c)
                continue
            word = c.rstrip(MARKS)
            kind = _letters(word)
            if not kind:
                other.append(c)
            elif len(word) == len(c):
                words[kind].append(c)
            else:  # marks behind a letter are a token run of their own
                tail = c[len(word) :]
                tailed.append((c, word, tail))
                if word not in young:
                    words[kind].append(word)
                if tail not in young:
                    other.append(tail)
        for kind, part in (*words.items(), ("", other)):
            part = list(dict.fromkeys(part))
            for i in range(0, len(part), 2000):
                some = part[i : i + 2000]
                young.update(zip(some, self._words(some, kind) if kind else self._encode(some)))
        for c, word, tail in tailed:
            young[c] = young[word] + young[tail]
        return young

    @staticmethod
    def split(text: bytes) -> list[bytes]:
        """Chunks; capitals A-Z are lowered first, as the tokenizer does, unless special tokens may be in the text."""
        return text.split() if b"<|" in text else text.lower().split()


def _pieces(path: str, capacity: int):
    import os

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        gc.set_threshold(200_000, 50, 50)  # the store is large and has no cycles
        memory = Chunks(path)
        ranks: dict[int, int] = {}
        from pyspark import TaskContext

        slab = TaskContext.get().partitionId()
        end = np.asarray([END_ID], "<u4").tobytes()
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            out: list[list] = [[] for _ in range(6)]
            for lo in range(0, len(ids), 1000):
                chunks = [memory.split(t) for t in texts[lo : lo + 1000]]
                store = memory.get(set().union(*chunks))
                for doc, words in zip(ids[lo : lo + 1000], chunks):
                    data = memoryview(b"".join([*map(store.__getitem__, words), end]))
                    n = len(data) // 4
                    for piece, start in enumerate(range(0, n, capacity)):
                        length = min(capacity, n - start)
                        r = ranks.get(length, 0)
                        ranks[length] = r + 1
                        for o, v in zip(out, (doc, piece, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), r)):
                            o.append(v)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))), pa.array([slab] * len(out[0]), pa.int32())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "_rank", "_slab"],
            )

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    common.small_batches(spark, 1000)
    pieces = common.texts(docs, id_col, text_col).mapInArrow(_pieces(tokenizer_path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, _rank long, _slab int")
    pieces = common.stage(pieces, "pieces")
    # (slab, length) counts; a running sum over the slabs of a length gives each slab's first rank
    counts = pieces.groupBy("_slab", "length").agg(F.count("*").alias("n"))
    w = Window.partitionBy("length").orderBy("_slab")
    first = counts.select("_slab", "length", (F.sum("n").over(w) - F.col("n")).alias("_first"))
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `capacity` rows at most
    runs = best_fit_runs(histogram, capacity)
    placed = pieces.join(first, ["_slab", "length"]).withColumn("_rank", F.col("_rank") + F.col("_first"))
    lengths = np.array([r[0] for r in runs], np.int64)
    ranks = np.array([r[1] for r in runs], np.int64)
    bins = np.array([r[3] for r in runs], np.int64)
    offsets = np.array([r[4] for r in runs], np.int64)
    by = np.lexsort((ranks, lengths))
    width = int(max(histogram.values(), default=0)) + 1
    table = spark.sparkContext.broadcast((lengths[by] * width + ranks[by], ranks[by], bins[by], offsets[by]))  # runs: bounded by the capacity, not by the corpus

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, r0, b0, off = table.value
        at = np.searchsorted(keys, length.to_numpy(np.int64) * width + rank.to_numpy(np.int64), side="right") - 1
        return pd.DataFrame({"sequence_id": b0[at] + rank.to_numpy(np.int64) - r0[at], "offset": off[at]})

    placed = placed.withColumn("_to", place("length", "_rank"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("_to.sequence_id").alias("sequence_id"), F.col("_to.offset").alias("offset"))

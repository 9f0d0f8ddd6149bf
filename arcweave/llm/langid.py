"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds its
letters' vectors by product after shifting each by its place; a text's vector
bundles (adds) the vectors of all its trigrams; a language's prototype bundles
the unit vectors of its training texts. A text gets the language whose
prototype has the largest cosine with its own vector.

Prototypes are learned from at most ``sample_rows`` labelled rows, those with
the smallest hash of the id. Texts are processed whole, in windows of
characters whose trigram counts add up, and a batch's trigram counts meet the
bound vectors of just the trigrams that occur in one matrix product.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
the score is the cosine, at least 0, rounded to 6 digits; equal cosines go to
the alphabetically first language; without any training row every text is
``und``; repeated rows give equal rows, and rows without an id are predicted too;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

DIM, SEED = 1024, 20_011
#: Letters whose vectors are remembered, and bits of a code point.
LETTERS, POINT = 20_000, 21
#: Labelled rows that prototypes are learned from, at most.
SAMPLE_ROWS = 20_000
WINDOW = 1 << 20  # characters handled at once
UNDETERMINED = "und"


def letter_vector(point: int, dim: int = DIM) -> np.ndarray:
    """The random vector of a letter; its code point is the seed."""
    return np.random.default_rng([SEED, point]).choice(np.array([-1, 1], np.int8), dim)


class Encoder:
    """Texts to sums of bound trigram vectors."""

    def __init__(self, dim: int = DIM):
        self.dim = dim
        self.letter: dict[int, np.ndarray] = {0: letter_vector(0, dim)}
        self.symbol = np.full(0x110000, -1, np.int32)

    def _symbols(self, points: np.ndarray) -> np.ndarray:
        """0 for what is no letter, else the code point."""
        got = self.symbol[points]
        if (got < 0).any():
            for c in np.unique(points[got < 0]).tolist():
                self.symbol[c] = c if chr(c).isalpha() else 0
            got = self.symbol[points]
        return got

    def _letters(self, points: np.ndarray) -> np.ndarray:
        if len(self.letter) > LETTERS:
            self.letter = {0: self.letter[0]}
        for c in points.tolist():
            if c not in self.letter:
                self.letter[c] = letter_vector(c, self.dim)
        return np.stack([self.letter[c] for c in points.tolist()])

    def vectors(self, texts: list[str]) -> np.ndarray:
        """One float32 vector per text; zeros where there is no letter."""
        out = np.zeros((len(texts), self.dim), np.float32)
        part, owner, size = [], [], 0

        def flush():
            nonlocal part, owner, size
            if part:
                self._add(out, part, owner)
            part, owner, size = [], [], 0

        for i, t in enumerate(texts):
            t = f" {t.lower()} "
            for at in range(0, max(1, len(t) - 2), WINDOW):
                piece = t[at : at + WINDOW + 2]
                part.append(piece)
                owner.append(i)
                size += len(piece)
                if size >= WINDOW:
                    flush()
        flush()
        return out

    def _add(self, out: np.ndarray, part: list[str], owner: list[int]) -> None:
        points = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), "<u4")
        of = np.repeat(np.arange(len(part)), [len(p) for p in part])
        sym = self._symbols(points).astype(np.int64)
        keep = np.r_[True, (sym[1:] != 0) | (sym[:-1] != 0) | (of[1:] != of[:-1])]
        sym, of = sym[keep], of[keep]
        if len(sym) < 3:
            return
        code = sym[:-2] << 2 * POINT | sym[1:-1] << POINT | sym[2:]
        ok = (of[:-2] == of[2:]) & (code != 0)
        if not ok.any():
            return
        grams, col = np.unique(code[ok], return_inverse=True)
        key, counts = np.unique(of[:-2][ok] * len(grams) + col, return_counts=True)
        row, col = np.divmod(key, len(grams))
        last = (1 << POINT) - 1
        points, at = np.unique(np.concatenate([grams >> 2 * POINT, grams >> POINT & last, grams & last]), return_inverse=True)
        letters = self._letters(points)
        a, b, c = at.reshape(3, -1)
        vectors = (np.roll(letters, 2, axis=1)[a] * np.roll(letters, 1, axis=1)[b] * letters[c]).astype(np.float32)
        for lo in range(0, len(part), 128):
            here = (row >= lo) & (row < lo + 128)
            if here.any():
                table = np.zeros((min(128, len(part) - lo), len(grams)), np.float32)
                table[row[here] - lo, col[here]] = counts[here]
                np.add.at(out, owner[lo : lo + 128], table @ vectors)


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n == 0, 1, n)


def learn(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, prototypes) from labelled rows; at most ``sample_rows`` of them."""
    rows = rows.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text"), F.col(f"`{lang_col}`").alias("_lang")).where("_lang IS NOT NULL AND _text IS NOT NULL")
    hashed = F.xxhash64("_id").bitwiseAND(F.lit((1 << 30) - 1))
    total = rows.select("_lang").count()
    if total > sample_rows:
        # the threshold leaves some rows fewer than the bound, so that chance does not exceed it
        rows = rows.where(hashed < int((1 << 30) * 0.97 * sample_rows / total))
    rows = rows.repartition(min(16, common.parts(rows.sparkSession)), "_id").sortWithinPartitions("_id")

    def sums(batches):
        encoder, total = Encoder(), {}
        for b in batches:
            langs = b.column(1).to_pylist()
            vectors = _unit(encoder.vectors(b.column(0).to_pylist())).astype(np.float64)
            for lang in set(langs):
                at = [i for i, x in enumerate(langs) if x == lang]
                total[lang] = total.get(lang, 0) + vectors[at].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    got = rows.select("_text", "_lang").mapInArrow(sums, "lang string, v array<double>").collect()  # 16 rows a language
    langs = sorted({r.lang for r in got})
    if not langs:
        return [], np.zeros((0, DIM))
    table = np.array([np.sum([r.v for r in got if r.lang == x], axis=0) for x in langs]).reshape(len(langs), -1)
    return langs, np.round(_unit(table), 6)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every whole text."""
    common.small_batches(docs.sparkSession)
    langs, prototypes = model
    shared = docs.sparkSession.sparkContext.broadcast((langs, prototypes.astype(np.float32)))  # languages x DIM

    def run(batches):
        encoder = Encoder()
        langs, prototypes = shared.value
        for b in batches:
            vectors = encoder.vectors([t.decode("utf-8", "replace") for t in b.column(1).to_pylist()])
            known = np.abs(vectors).any(axis=1) if len(langs) else np.zeros(len(vectors), bool)
            cos = np.round(_unit(vectors) @ prototypes.T, 6) if len(langs) else np.zeros((len(vectors), 1))
            best = cos.argmax(axis=1)
            pred = [langs[k] if ok else UNDETERMINED for k, ok in zip(best, known)]
            score = np.where(known, np.clip(cos[np.arange(len(cos)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(np.round(score.astype(np.float64), 6), pa.float64())], names=["doc_id", "lang_pred", "score"])

    return common.texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_query(docs: DataFrame, train: Column, held_out: Column) -> DataFrame:
    """Learn from the rows that ``train`` marks and predict every row; ``held_out`` is of doc_id alone."""
    model = learn(docs.where(train))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")

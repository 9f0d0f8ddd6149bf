"""Tokenisers, packing, media, top-k: against libraries and brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arcweave.llm import media, packing, pieces, topk

from .helpers import documents

ODD = [None, "", " ", "  a  b", "▁x ▁▁ y", "\x00a\tb\r\n z", "aaaa" * 300, "ab" * 500, "日本語🎉", "<s> </s> <0x0A>", "É İ Σς ﬁ", "x" * 9000, "don't, it's... 12,345!?", "<|endoftext|> a<|endoftext|>"]


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(P.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="aeinort ▁\n.=-", max_size=200)))
def test_pieces_equal_the_library(text):
    import sentencepiece

    global _M, _L
    if "_M" not in globals():
        _M, _L = pieces.PieceModel(P.path("piece_bpe_32k.model")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    ids = _M.encode(text)
    assert ids == _L.encode(text) + [2] and _M.decode(ids) == _L.decode(ids)


def test_piece_digest(spark, library):
    got = {r.doc_id: r for r in pieces.piece_digest(documents(spark, ODD), P.path("piece_bpe_32k.model")).collect()}
    for i, t in enumerate(ODD):
        ids = library.encode(t or "") + [2]
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    full = {r.doc_id: r for r in pieces.piece_codes(documents(spark, ODD), P.path("piece_bpe_32k.model")).collect()}
    assert full[3].ids == library.encode(ODD[3]) + [2] and full[3].decoded == ODD[3]


def test_packing(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rng = random.Random(2)
    texts = ODD + [" ".join(rng.choice("alpha beta, gamma 12 Éclair don't".split()) for _ in range(rng.randint(0, 200))) for _ in range(60)]
    rows = packing.pack(documents(spark, texts), P.path("word_bpe_49k.json"), capacity=64).collect()
    bins, by = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
        by[r.doc_id].append(r)
    for i, t in enumerate(texts):
        ids, at = tok.encode(t or "", add_special_tokens=False).ids + [1], 0
        for k, r in enumerate(sorted(by[i], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.length) == (k, at, min(64, len(ids) - at))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(documents(spark, ["x"]).limit(0), P.path("word_bpe_49k.json")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 12), max_size=20))
def test_runs_are_best_fit_decreasing(histogram):
    bins = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fit = min((b for b in range(len(bins)) if bins[b] >= length), key=lambda b: bins[b], default=None)
            if fit is None:
                bins.append(30 - length)
            else:
                bins[fit] -= length
    fill, seen = collections.Counter(), set()
    for length, rank, n, first, offset in packing.best_fit_runs(histogram, 30):
        for i in range(n):
            assert fill[first + i] == offset
            fill[first + i] += length
            seen.add((length, rank + i))
    assert len(seen) == sum(histogram.values()) and sorted(30 - v for v in fill.values()) == sorted(bins)


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=5000))
def test_media_round_trip(data):
    stream = media.encode(data)
    s = media.parse(stream)
    got, n = media.payload(stream, s)
    assert got[:n] == data and len(got) % 64 == 0 and len(got) >= 64 and set(got[n:]) <= {0}
    assert s.crc_bad == 0 and s.resyncs == 0 and s.vbr["frames"] == len(s.offsets) and s.duration == 1152 * len(s.offsets) / 32000


def test_media_damage():
    data = bytes(range(256)) * 40
    stream = media.encode(data)
    s = media.parse(stream)
    at = s.offsets[2]
    assert media.parse(stream[:at] + b"junk\xff\xfa" + stream[at:]).resyncs == 1
    hurt = bytearray(stream)
    hurt[at + 8] ^= 1
    bad = media.parse(bytes(hurt))
    assert bad.crc_bad == 1 and bad.samples == s.samples
    assert media.parse(b"") == media.Stream() and media.parse(b"no audio at all").offsets == []
    assert media.crc16(b"123456789") == 0xAEE7


def test_media_digest(spark):
    got = {r.doc_id: r for r in media.media_digest(documents(spark, ODD)).collect()}
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        pad = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
    assert got[0].media_sha256 == got[1].media_sha256
    assert media.media_column(documents(spark, ["a"])).first().duration_ms == 36.0


def test_topk(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(300)]
    rows += [(300 + i, rows[i][1]) for i in range(40)]  # ties
    rows += [(400, None), (401, [1.0, None] * 8), (402, [float("nan")] * 16), (403, [float("inf")] * 16), (404, [1.0] * 3), (450, [2.0] * 3)]
    v = spark.createDataFrame([(i, x, 1, "q") for i, x in rows], "vec_id long, embedding array<float>, label int, score string")
    for shards, blocks in ((8192, 512), (50, 3)):  # one block; three blocks
        got = sorted(map(tuple, topk.topk_search(v, F.col("vec_id") % 50 == 0, 5, shard_rows=shards, block_rows=blocks).collect()))
        x = {r.vec_id: [int(np.floor(256 * float(a))) for a in r.embedding] for r in v.collect() if r.vec_id < 400 or r.vec_id in (404, 450)}
        want = []
        for q in x:
            if q % 50 == 0:
                s = sorted((-sum(a * b for a, b in zip(x[q], x[c])), c) for c in x if c != q and len(x[c]) == len(x[q]))
                want += [(q, k + 1, c, -t) for k, (t, c) in enumerate(s[:5])]
        assert got == sorted(want)
    assert topk.topk_search(v.limit(0), F.lit(True)).count() == 0


def frame(version, layer, kbps, rate_index, mode=3, extension=0, protected=True, rng=random.Random(1)):
    """A frame by the standard's own rules, its CRC bit by bit."""
    v, lay = {1: 3, 2: 2, 4: 0}[version], 4 - layer
    bi = media.KBPS[min(version, 2), layer].index(kbps)
    head = bytes([0xFF, 0xE0 | v << 3 | lay << 1 | (not protected), bi << 4 | rate_index << 2, mode << 6 | extension << 4])
    rate = media.RATES[rate_index] // version
    n = 384 if layer == 1 else 576 if layer == 3 and version > 1 else 1152
    size = 4 * (12 * kbps * 1000 // rate) if layer == 1 else n // 8 * kbps * 1000 // rate
    body = bytes(rng.randrange(256) for _ in range(size - 4 - 2 * protected))
    if not protected:
        return head + body, n, rate
    h = media._decoded(*head[1:])
    bits = media._protected_bits(h, body)
    c = 0xFFFF
    for k, byte in enumerate(head[2:] + body):
        for j in range(8):
            if 8 * k + j < 16 + bits:
                c = (c << 1 & 0xFFFF) ^ (0x8005 if (byte >> 7 - j & 1) ^ c >> 15 else 0)
    return head + c.to_bytes(2, "big") + body, n, rate


@pytest.mark.parametrize("version,layer,kbps,rate,mode", [(1, 1, 384, 0, 0), (1, 1, 192, 2, 1), (1, 2, 192, 1, 0), (1, 2, 48, 0, 3), (1, 2, 384, 2, 1), (2, 2, 64, 0, 0), (1, 3, 128, 0, 1), (2, 3, 64, 1, 3), (4, 3, 32, 2, 0), (2, 1, 128, 0, 3)])
def test_all_versions_and_layers(version, layer, kbps, rate, mode):
    frames = [frame(version, layer, kbps, rate, mode, k % 2, protected=k != 3) for k in range(7)]
    data = b"".join(f for f, _, _ in frames)
    s = media.parse(b"\x00junk" + data)
    assert s.offsets == [5 + sum(len(f) for f, _, _ in frames[:k]) for k in range(7)] and s.crc_bad == 0 and s.resyncs == 1
    assert s.samples == sum(n for _, n, _ in frames) and s.rate == frames[0][2] and s.duration == s.samples / s.rate
    hurt = bytearray(data)
    hurt[7] ^= 0x80
    bad = media.parse(bytes(hurt))
    assert bad.bad == [0] and bad.offsets[0] == 0 and len(bad.offsets) == 7


def test_allocation_widths():
    h = media._decoded(*frame(1, 1, 384, 0, 0)[0][1:4])
    assert media._protected_bits(h, bytes(64)) == 256 and media._protected_bits(media._decoded(*frame(1, 1, 384, 0, 3)[0][1:4]), bytes(64)) == 128
    h = media._decoded(*frame(1, 2, 192, 1, 3)[0][1:4])  # 27 subbands: 11 of 4 bits, 12 of 3, 4 of 2
    assert media._protected_bits(h, bytes(64)) == 88 and media._protected_bits(h, b"\xff" * 64) == 88 + 54


def test_vbri_table():
    first = bytearray(frame(1, 3, 128, 0, 1, protected=False)[0])
    first[36:62] = b"VBRI" + bytes(6) + (5000).to_bytes(4, "big") + (3).to_bytes(4, "big") + (2).to_bytes(2, "big") + (4).to_bytes(2, "big") + (2).to_bytes(2, "big") + (1).to_bytes(2, "big")
    first[62:66] = (100).to_bytes(2, "big") + (150).to_bytes(2, "big")
    s = media.parse(bytes(first) + frame(1, 3, 128, 0, 1)[0] * 3)
    assert s.vbr == {"frames": 3, "bytes": 5000, "entries": [400, 600], "step": 1} and len(s.offsets) == 3


def test_tables_of_any_shape(spark):
    """Null and repeated ids, repeated rows, no rows, and long texts, for the operators that keep one row a document."""
    long = "alpha beta. " * 60_000
    docs = documents(spark, ["a b", "a b", None, long, ""], ids=[1, 1, None, 4, None])
    for run, same in ((lambda d: media.media_digest(d), "media_sha256"), (lambda d: pieces.piece_digest(d, P.path("piece_bpe_32k.model")), "ids_sha256"), (lambda d: packing.pack(d, P.path("word_bpe_49k.json"), capacity=1 << 20), "ids_crc32")):
        rows = run(docs).collect()
        assert sorted(str(r.doc_id) for r in rows) == ["1", "1", "4", "None", "None"]
        assert len({r[same] for r in rows if r.doc_id == 1}) == 1 and len({r[same] for r in rows if r.doc_id is None}) == 1
        assert run(docs.limit(0)).count() == 0


def test_topk_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [3.0, 1.0]), (1, [3.0, 1.0]), (None, [9.0, 9.0]), (50, [0.5, 0.5]), (7, [])]
    v = spark.createDataFrame([(i, x, "q", 1) for i, x in rows], "vec_id long, embedding array<float>, _id string, rank int")
    got = sorted(map(tuple, topk.topk_search(v, F.col("vec_id") % 50 == 0, 2).collect()))
    assert got == [(0, 1, 1, 327680), (0, 2, 1, 327680), (50, 1, 1, 131072), (50, 2, 1, 131072)]


def test_thresholds_carry_over(spark, monkeypatch):
    """Every row in the head, none in it, and many shards of one task: the same lists."""
    rng = np.random.default_rng(8)
    v = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)], "vec_id long, embedding array<float>")
    want = None
    for head, shard in ((64, 8192), (1, 7), (10**6, 5)):
        monkeypatch.setattr(topk, "HEAD", head)
        got = sorted(map(tuple, topk.topk_search(v, F.col("vec_id") % 10 == 0, 5, shard_rows=shard, block_rows=16).collect()))
        want = want or got
        assert got == want and len(got) == 200

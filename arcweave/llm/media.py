"""MPEG audio columns: Layer III streams that carry a payload without loss.

Writing: a text's bytes are padded to a multiple of 64 and laid into the
ancillary bytes of silent MPEG-1 Layer III frames (mono, 32 kHz, CRC
protected). The stream opens with an ID3v2.4 tag that names the unpadded and
padded lengths and a variable-bitrate table ("Xing"), and ends with an ID3v1
tag. Reading: :func:`parse` takes MPEG-1, MPEG-2 and MPEG-2.5 of Layers I, II
and III; it finds the first frame behind any tag, checks each header and
CRC-16, resynchronises where bytes were lost, reads a variable-bitrate table
("Xing", "Info" or "VBRI") and gives exact duration and the seek offset of every
frame. :func:`payload` reads the stored bytes back.

Defined cases: null and empty texts store 64 zero bytes; equal texts give equal
streams, and repeated rows equal rows; null ids stay null; texts of any length are
stored whole; an empty table gives no rows; other columns are not read. A stream
without any frame parses to zero frames; a frame whose CRC fails keeps its place
and offset and is listed in ``bad``; frames of free format (no stated bitrate) are
skipped like lost bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by index, for MPEG-1 by layer, and for the lower rates.
KBPS = {
    (1, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (1, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (2, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (2, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
#: Hz of MPEG-1 by index; MPEG-2 has half and MPEG-2.5 a quarter of it.
RATES = [44100, 48000, 32000]
#: Bits of the allocation of each Layer II subband, as (bits, subbands) runs, by table.
ALLOCATION = {"a": [(4, 11), (3, 12), (2, 4)], "b": [(4, 11), (3, 12), (2, 7)], "c": [(4, 2), (3, 6)], "d": [(4, 2), (3, 10)], "lsf": [(4, 4), (3, 7), (2, 19)]}
SAMPLES = 1152
SIDE_MONO, SIDE_STEREO = 17, 32
RATE_INDEX = 2  # 32 kHz: the largest frames
PAD = 64


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 8
        for _ in range(8):
            c = (c << 1) ^ 0x8005 if c & 0x8000 else c << 1
        out.append(c & 0xFFFF)
    return out


_CRC = _crc_table()


def crc16(data: bytes) -> int:
    c = 0xFFFF
    for b in data:
        c = ((c << 8) & 0xFFFF) ^ _CRC[(c >> 8) ^ b]
    return c


def _frame_size(bitrate_index: int, rate_index: int, padding: int) -> int:
    """Bytes of a frame of MPEG-1 Layer III."""
    return 144 * KBPS[1, 3][bitrate_index] * 1000 // RATES[rate_index] + padding


def _head(bitrate_index: int) -> bytes:
    """Header, CRC and empty side information of a silent mono frame."""
    header = bytes([0xFF, 0xFA, bitrate_index << 4 | RATE_INDEX << 2, 0xC0])
    side = bytes(SIDE_MONO)
    return header + struct.pack(">H", crc16(header[2:4] + side)) + side


HEADS = {i: _head(i) for i in range(1, 15)}
HEAD_LEN = 4 + 2 + SIDE_MONO
ROOM = {i: _frame_size(i, RATE_INDEX, 0) - HEAD_LEN for i in range(1, 15)}


def _syncsafe(n: int) -> bytes:
    return bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])


def encode(text: bytes) -> bytes:
    """An MPEG stream that holds ``text`` padded with zeros to a multiple of 64."""
    n = len(text)
    size = max(PAD, -(-n // PAD) * PAD)
    body = text + bytes(size - n)
    frames, at, top = [], 0, ROOM[14]
    while at < size:
        left = size - at
        i = 14 if left >= top else next(k for k in range(1, 15) if ROOM[k] >= left)
        chunk = body[at : at + ROOM[i]]
        frames.append(HEADS[i] + chunk + bytes(ROOM[i] - len(chunk)))
        at += ROOM[i]
    info = f"arcweave\0{n},{size}".encode()
    frame = b"\0" + info + b"\0"
    tag = b"TXXX" + _syncsafe(len(frame)) + b"\0\0" + frame
    id3 = b"ID3\x04\0\0" + _syncsafe(len(tag)) + tag
    total = sum(map(len, frames))
    first = _frame_size(9, RATE_INDEX, 0)
    toc, cum = bytearray(), [0]
    for f in frames:
        cum.append(cum[-1] + len(f))
    for p in range(100):
        toc.append(min(255, 256 * (first + cum[p * len(frames) // 100]) // (first + total)))
    xing = b"Xing" + struct.pack(">III", 7, len(frames), first + total) + bytes(toc)
    vbr = HEADS[9] + xing
    vbr += bytes(first - len(vbr))
    v1 = b"TAG" + b"arcweave".ljust(30, b"\0") + bytes(94) + b"\xff"
    return id3 + vbr + b"".join(frames) + v1


@dataclass
class Stream:
    tags: dict = field(default_factory=dict)
    vbr: dict = field(default_factory=dict)
    offsets: list = field(default_factory=list)  # seek offset of every audio frame
    sizes: list = field(default_factory=list)
    bad: list = field(default_factory=list)  # places, among the frames, of those whose CRC fails
    samples: int = 0
    rate: int = 0
    bitrate_sum: int = 0
    crc_ok: int = 0
    crc_bad: int = 0
    resyncs: int = 0

    @property
    def duration(self) -> float:
        """Exact seconds, the samples over the rate."""
        return self.samples / self.rate if self.rate else 0.0


@dataclass(frozen=True)
class Header:
    version: int  # 1 for MPEG-1, 2 for MPEG-2, 4 for MPEG-2.5: what the rates are divided by
    layer: int
    size: int
    rate: int
    kbps: int
    samples: int
    protected: bool
    mono: bool
    bound: int  # subbands of both channels under joint coding

    @property
    def side(self) -> int:
        """Bytes of the side information of Layer III."""
        if self.version == 1:
            return SIDE_MONO if self.mono else SIDE_STEREO
        return 9 if self.mono else SIDE_MONO


@lru_cache(maxsize=4096)
def _decoded(b1: int, b2: int, b3: int) -> Header | None:
    version, layer = {3: 1, 2: 2, 0: 4}.get(b1 >> 3 & 3), 4 - (b1 >> 1 & 3)
    bi, ri = b2 >> 4, b2 >> 2 & 3
    if b1 & 0xE0 != 0xE0 or version is None or layer == 4 or not 1 <= bi <= 14 or ri == 3:
        return None
    kbps, rate, padding = KBPS[min(version, 2), layer][bi], RATES[ri] // version, b2 >> 1 & 1
    if layer == 1:
        size, samples = (12_000 * kbps // rate + padding) * 4, 384
    else:
        samples = 576 if layer == 3 and version > 1 else SAMPLES
        size = samples * 125 * kbps // rate + padding
    mode = b3 >> 6
    return Header(version, layer, size, rate, kbps, samples, not b1 & 1, mode == 3, 4 * (b3 >> 4 & 3) + 4 if mode == 1 else 32)


def _header(data: bytes, at: int) -> Header | None:
    """The header of a frame at ``at``, if there is one."""
    if at + 4 > len(data) or data[at] != 0xFF:
        return None
    return _decoded(data[at + 1], data[at + 2], data[at + 3])


def _crc_bits(data: bytes, bits: int) -> int:
    """CRC-16 of the first ``bits`` bits."""
    c = crc16(data[: bits // 8])
    for k in range(bits // 8 * 8, bits):
        bit = (data[k // 8] >> 7 - k % 8 & 1) ^ c >> 15
        c = (c << 1 & 0xFFFF) ^ (0x8005 if bit else 0)
    return c


def _protected_bits(h: Header, body: bytes) -> int:
    """How many bits behind the CRC it covers: side information, or the allocation and, in Layer II, the scale factor selectors."""
    channels = 1 if h.mono else 2
    if h.layer == 3:
        return 8 * h.side
    if h.layer == 1:
        bound = min(h.bound, 32)
        return 4 * (32 if h.mono else 2 * bound + 32 - bound)
    if h.version > 1:
        table = "lsf"
    else:
        per = h.kbps // channels
        table = ("c" if h.rate != 32000 else "d") if per <= 48 else "a" if h.rate == 48000 or per <= 80 else "b"
    widths = [w for w, n in ALLOCATION[table] for _ in range(n)]
    at, used = 0, 0
    whole = int.from_bytes(body[:64].ljust(64, b"\0"), "big")
    for sb, w in enumerate(widths):
        for _ in range(channels if sb < h.bound else 1):
            used += (1 if sb < h.bound else channels) * bool(whole >> 512 - at - w & (1 << w) - 1)
            at += w
    return at + 2 * used


def _crc_holds(h: Header, data: bytes, at: int) -> bool:
    bits = _protected_bits(h, data[at + 6 : at + 70])
    if at + 6 + (bits + 7) // 8 > len(data):
        return False
    return _crc_bits(data[at + 2 : at + 4] + data[at + 6 : at + 6 + (bits + 7) // 8], 16 + bits) == data[at + 4] << 8 | data[at + 5]


def _sound(data: bytes, at: int, end: int) -> Header | None:
    """The header at ``at`` if the frame ends where the stream or another header does."""
    h = _header(data, at)
    if h is None or at + h.size > end:
        return None
    nxt = at + h.size
    return h if nxt == end or _header(data, nxt) is not None else None


def _vbr(data: bytes, at: int, h: Header) -> dict:
    """The variable-bitrate table of a first frame, or nothing."""
    body = at + (6 if h.protected else 4)
    x = body + h.side
    if h.layer == 3 and data[x : x + 4] in (b"Xing", b"Info") and x + 8 <= len(data):
        out: dict = {}
        flags, p = struct.unpack_from(">I", data, x + 4)[0], x + 8
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit and p + 4 <= len(data):
                out[name] = struct.unpack_from(">I", data, p)[0]
                p += 4
        if flags & 4:
            out["toc"] = data[p : p + 100]
        return out or {"frames": 0}
    x = at + 36  # always 32 bytes behind the header
    if h.layer == 3 and data[x : x + 4] == b"VBRI" and x + 26 <= len(data):
        size, frames, entries, scale, width, step = struct.unpack_from(">IIHHHH", data, x + 10)
        toc = [scale * int.from_bytes(data[x + 26 + width * k : x + 26 + width * (k + 1)], "big") for k in range(entries)]
        return {"frames": frames, "bytes": size, "entries": toc, "step": step}
    return {}


def parse(data: bytes) -> Stream:
    """Tags, the variable-bitrate table, and every frame of a stream.

    A frame whose CRC fails is counted and left out of the payload but keeps
    its place in time. Bytes that start no frame are skipped to the next
    header that another header, or the end, confirms.
    """
    s, at, end = Stream(), 0, len(data)
    if data[:3] == b"ID3" and end >= 10:
        z = data[6:10]
        size = z[0] << 21 | z[1] << 14 | z[2] << 7 | z[3]
        p, stop = 10, min(end, 10 + size)
        while p + 10 <= stop and data[p]:
            z = data[p + 4 : p + 8]
            n = z[0] << 21 | z[1] << 14 | z[2] << 7 | z[3]
            s.tags.setdefault(data[p : p + 4].decode("latin-1"), []).append(data[p + 10 : p + 10 + n])
            p += 10 + n
        at = min(end, 10 + size)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        s.tags["ID3v1"] = [data[end - 125 : end - 95].rstrip(b"\0")]
        end -= 128
    checked: dict[bytes, bool] = {}
    first = True
    while at < end:
        h = _sound(data, at, end)
        if h is None:
            s.resyncs += 1
            at += 1
            while at < end:
                at = data.find(b"\xff", at, end)
                if at < 0:
                    at = end
                elif _sound(data, at, end):
                    break
                else:
                    at += 1
            continue
        if first:
            first = False
            s.vbr = _vbr(data, at, h)
            if s.vbr:
                at += h.size
                continue
        ok = True
        if h.protected:
            # frames of one header, CRC and side information are checked once
            key = data[at + 1 : at + 6 + h.side] if h.layer == 3 else data[at + 1 : at + 70]
            ok = checked.get(key)
            if ok is None:
                ok = checked[key] = _crc_holds(h, data, at)
        s.crc_ok += ok
        s.crc_bad += not ok
        if not ok:
            s.bad.append(len(s.offsets))
        s.offsets.append(at)
        s.sizes.append(h.size)
        s.samples += h.samples
        s.rate = h.rate
        s.bitrate_sum += h.kbps
        at += h.size
    return s


def payload(data: bytes, s: Stream | None = None) -> tuple[bytes, int]:
    """The padded payload and the unpadded length, read from the stream's bytes."""
    s = s or parse(data)
    bad = set(s.bad)
    body = b"".join(data[o + HEAD_LEN : o + z] for k, (o, z) in enumerate(zip(s.offsets, s.sizes)) if k not in bad)
    for v in s.tags.get("TXXX", []):
        name, _, value = v[1:].rstrip(b"\0").partition(b"\0")
        if name == b"arcweave":
            n, size = map(int, value.split(b","))
            return body[:size], n
    return body, len(body)


def feature(s: Stream) -> str:
    """Exact duration in milliseconds (1152 samples at 32 kHz are 36 ms), frames, rates, checks."""
    ms = s.samples * 1000 // s.rate if s.rate else 0
    seek = zlib.crc32(struct.pack(f"<{len(s.offsets)}q", *s.offsets))
    kbps = s.bitrate_sum // len(s.offsets) if s.offsets else 0
    return f"frames={len(s.offsets)};ms={ms};kbps={kbps};crc_ok={s.crc_ok};crc_bad={s.crc_bad};resync={s.resyncs};vbr={s.vbr.get('frames', 0)};seek={seek:08x}"


MEDIA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media binary, frame_offsets array, duration_ms, feature): the stored streams themselves."""
    common.small_batches(docs.sparkSession)
    out = common.schema("doc_id long, media binary, frame_offsets array<long>, duration_ms double, feature string")

    def run(batches):
        for b in batches:
            media = [encode(t) for t in b.column(1).to_pylist()]
            read = [parse(m) for m in media]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(media, pa.binary()), pa.array([s.offsets for s in read], pa.list_(pa.int64())), pa.array([s.duration * 1000 for s in read], pa.float64()), pa.array([feature(s) for s in read], pa.string())],
                names=out.names,
            )

    return common.texts(docs, id_col, text_col).mapInArrow(run, out)


def media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest row of every document's stream: stored, read back, measured."""
    common.small_batches(docs.sparkSession)
    out = common.schema(MEDIA)

    def run(batches):
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                m = encode(t)
                s = parse(m)
                p, n = payload(m, s)
                rows.append((n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-PAD:]), len(m), hashlib.sha256(m).hexdigest(), feature(s)))
            cols = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), f.type) for c, f in zip(cols, _arrow(out)[1:]))], names=out.names)

    return common.texts(docs, id_col, text_col).mapInArrow(run, out)


def _arrow(schema) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return list(to_arrow_schema(schema))

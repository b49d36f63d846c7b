"""Media columns in Matroska (operator 10): text payloads stored as 8-bit PCM, parsed back to packets.

``store`` writes each text, padded with blanks to a positive multiple of 192 bytes, as the samples of one
audio track: EBML header, segment information, track entry, clusters of laced SimpleBlocks and cues.
``parse`` reads any such container: variable-length element ids and sizes (unknown sizes included),
SimpleBlocks and BlockGroups, the three lacings, and cues, into a packet table with tracks, timestamps and
byte ranges. ``read`` joins the packets' bytes and computes features of the samples.

Defined results: null text counts as empty and stores one frame of blanks; equal texts give equal media;
null media parse to an empty packet table; damaged media raise ValueError; repeated rows repeat their result; an empty
table gives an empty table; clashing columns are replaced."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, read_table, utf8

#: Bytes of a frame, frames of a block, blocks of a cluster; at 8,000 samples a second a frame lasts 24 ms,
#: so a cluster's relative timestamps stay far inside their 16 bits.
FRAME, LACE, BLOCKS, RATE = 192, 8, 128, 8000
FRAME_MS = FRAME * 1000 // RATE

# Element ids of the Matroska specification.
EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE1, 0x1F43B675
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, MUXING_APP, WRITING_APP, DURATION = 0x2AD7B1, 0x4D80, 0x5741, 0x4489
TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, SAMPLING, CHANNELS, BIT_DEPTH = 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xB5, 0x9F, 0x6264

PACKET = T.StructType([T.StructField("track", T.IntegerType()), T.StructField("timestamp_ms", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("keyframe", T.BooleanType()), T.StructField("cluster", T.IntegerType()), T.StructField("lace", T.IntegerType()), T.StructField("cued", T.BooleanType())])
PACKET_ARROW = pa.struct([("track", pa.int32()), ("timestamp_ms", pa.int64()), ("offset", pa.int64()), ("size", pa.int32()), ("keyframe", pa.bool_()), ("cluster", pa.int32()), ("lace", pa.int32()), ("cued", pa.bool_())])


def vint(n: int, width: int = 0) -> bytes:
    """A size as a variable-length integer of the least or the given width."""
    while not width or n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(code: int, body: bytes) -> bytes:
    return code.to_bytes((code.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(code: int, n: int) -> bytes:
    return element(code, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def laced(frames: list[bytes], lacing: str) -> tuple[int, bytes]:
    """The lacing bits of the block's flags, and the frames with their lacing header."""
    if len(frames) == 1:
        return 0, frames[0]
    sizes, count = [len(f) for f in frames], bytes([len(frames) - 1])
    if lacing == "fixed":
        if len(set(sizes)) > 1:
            raise ValueError("fixed lacing needs frames of one size")
        return 0x04, count + b"".join(frames)
    if lacing == "xiph":
        head = b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
        return 0x02, count + head + b"".join(frames)
    if lacing == "ebml":
        head = vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            d, w = b - a, 1
            while not -(1 << 7 * w - 1) < d < 1 << 7 * w - 1:
                w += 1
            head += vint(d + (1 << 7 * w - 1) - 1, w)
        return 0x06, count + head + b"".join(frames)
    raise ValueError(f"unknown lacing {lacing!r}")


def front() -> tuple[bytes, bytes]:
    head = element(EBML, number(EBML_VERSION, 1) + number(EBML_READ_VERSION, 1) + number(EBML_MAX_ID, 4) + number(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(DOC_READ_VERSION, 2))
    audio = element(AUDIO, element(SAMPLING, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    return head, element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))


def pad(body: bytes) -> bytes:
    return body.ljust(max(1, -(-len(body) // FRAME)) * FRAME, b" ")


def mux(payload: bytes, lacing: str = "fixed") -> bytes:
    """One audio track holding ``payload`` (a multiple of a frame), FRAME bytes a packet."""
    head, tracks = front()
    frames = len(payload) // FRAME
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", frames * FRAME_MS)) + element(MUXING_APP, b"meshframe") + element(WRITING_APP, b"meshframe"))
    body, cues, at = [info, tracks], [], len(info) + len(tracks)
    for c in range(0, frames, LACE * BLOCKS):
        inside = [number(TIMESTAMP, c * FRAME_MS)]
        for b in range(c, min(c + LACE * BLOCKS, frames), LACE):
            held = payload[b * FRAME : min(b + LACE, frames) * FRAME]
            if lacing == "fixed":
                n = len(held) // FRAME
                flag, data = (0x04, bytes([n - 1]) + held) if n > 1 else (0, held)
            else:
                flag, data = laced([held[i : i + FRAME] for i in range(0, len(held), FRAME)], lacing)
            inside.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", (b - c) * FRAME_MS, 0x80 | flag) + data))
        cluster = element(CLUSTER, b"".join(inside))
        cues.append(element(CUE_POINT, number(CUE_TIME, c * FRAME_MS) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(body))


def read_vint(data: bytes, at: int, marker: bool) -> tuple[int, int]:
    """The integer at ``at`` (with its marker bit for ids; -1 for an unknown size) and the place after it."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"integer cut off at byte {at}")
    n = int.from_bytes(data[at : at + width], "big")
    if not marker:
        n -= 1 << 7 * width
        n = -1 if n == (1 << 7 * width) - 1 else n
    return n, at + width


def elements(data: bytes, at: int, end: int, stops: frozenset = frozenset()) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of the elements of a body; one of unknown size runs to the next of ``stops``."""
    while at < end:
        code, p = read_vint(data, at, True)
        size, p = read_vint(data, p, False)
        if size < 0:
            q = p
            while q < end:
                inner, r = read_vint(data, q, True)
                if inner in stops and code != SEGMENT:
                    break
                n, r = read_vint(data, r, False)
                q = end if n < 0 else r + n
        else:
            q = p + size
        if q > end:
            raise ValueError(f"element {code:#x} at byte {at} runs past its parent")
        yield code, p, q
        at = q


def lace_sizes(data: bytes, p: int, q: int, flag: int) -> tuple[list[int], int]:
    """The sizes of the frames in a block and where the first begins."""
    kind = flag & 0x06
    if not kind:
        return [q - p], p
    n, p = data[p] + 1, p + 1
    if kind == 0x04:
        if (q - p) % n:
            raise ValueError("a fixed lace isn't a multiple of its frames")
        return [(q - p) // n] * n, p
    sizes: list[int] = []
    if kind == 0x02:
        for _ in range(n - 1):
            s = 0
            while data[p] == 255:
                s, p = s + 255, p + 1
            sizes.append(s + data[p])
            p += 1
    elif n > 1:
        s, p = read_vint(data, p, False)
        sizes.append(s)
        for _ in range(n - 2):
            width = 9 - data[p].bit_length()
            d, p = read_vint(data, p, False)
            s += ((1 << 7 * width) - 1 if d < 0 else d) - ((1 << 7 * width - 1) - 1)
            sizes.append(s)
    sizes.append(q - p - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("a lace is longer than its block")
    return sizes, p


def demux(data: bytes) -> list[tuple]:
    """Packets as (track, timestamp ms, offset, size, keyframe, cluster, lace, cued)."""
    out: list[tuple] = []
    uint = lambda p, q: int.from_bytes(data[p:q], "big")
    tops = frozenset((CLUSTER, CUES, INFO, TRACKS))
    for code, p, q in elements(data, 0, len(data)):
        if code != SEGMENT:
            continue
        base, scale, clusters, cued, frame_ms = p, 1_000_000, [], set(), {}
        for kind, a, b in elements(data, p, q, tops):
            if kind == INFO:
                scale = next((uint(x, y) for k, x, y in elements(data, a, b) if k == TIMESTAMP_SCALE), scale)
            elif kind == TRACKS:
                for k, x, y in elements(data, a, b):
                    if k == TRACK_ENTRY:
                        got = {k2: (x2, y2) for k2, x2, y2 in elements(data, x, y)}
                        audio = {k2: (x2, y2) for k2, x2, y2 in elements(data, *got[AUDIO])} if AUDIO in got else {}
                        if SAMPLING in audio and BIT_DEPTH in audio:
                            (s0, s1), width = audio[SAMPLING], uint(*audio[BIT_DEPTH]) // 8 * (uint(*audio[CHANNELS]) if CHANNELS in audio else 1)
                            rate = struct.unpack(">d" if s1 - s0 == 8 else ">f", data[s0:s1])[0]
                            frame_ms[uint(*got[TRACK_NUMBER])] = 1000 / (rate * max(1, width))
            elif kind == CLUSTER:
                clusters.append((a, b))
            elif kind == CUES:
                for k, x, y in elements(data, a, b):
                    for k2, x2, y2 in elements(data, x, y) if k == CUE_POINT else ():
                        if k2 == CUE_POSITIONS:
                            cued.update(uint(x3, y3) for k3, x3, y3 in elements(data, x2, y2) if k3 == CUE_CLUSTER)
        at_cluster = {read_vint(data, read_vint(data, base + c, True)[1], False)[1] for c in cued if base + c < q}
        for c, (a, b) in enumerate(clusters):
            start, is_cued = 0, a in at_cluster
            for kind, x, y in elements(data, a, b):
                if kind == TIMESTAMP:
                    start = uint(x, y)
                    continue
                key = True
                if kind == BLOCK_GROUP:
                    inside = list(elements(data, x, y))
                    key = all(k != REFERENCE for k, _, _ in inside)
                    kind, x, y = next((e for e in inside if e[0] == BLOCK), (0, 0, 0))
                if kind not in (SIMPLE_BLOCK, BLOCK):
                    continue
                track, x = read_vint(data, x, False)
                shift, flag = struct.unpack_from(">hB", data, x)
                sizes, x = lace_sizes(data, x + 3, y, flag)
                key = bool(flag & 0x80) if kind == SIMPLE_BLOCK else key
                first, behind = (start + shift) * scale / 1e6, 0
                for i, size in enumerate(sizes):
                    out.append((track, round(first + behind * frame_ms.get(track, 0)), x, size, key, c, i, is_cued and not i and kind == SIMPLE_BLOCK and not shift))
                    x, behind = x + size, behind + size
    return out


def features(samples: bytes, packets: int) -> str:
    """Shape of the signal, from its unsigned 8-bit samples."""
    s = np.frombuffer(samples, np.uint8).astype(np.int32)
    if not len(s):
        return "packets=0"
    centred = s - 128
    crossings = int(np.count_nonzero((centred[1:] >= 0) != (centred[:-1] >= 0)))
    return f"packets={packets};ms={packets * FRAME_MS};mean={int(s.sum()) / len(s):.4f};rms={(float((centred.astype(np.int64) ** 2).sum()) / len(s)) ** 0.5:.4f};min={int(s.min())};max={int(s.max())};crossings={crossings}"


def store(df: DataFrame, text_col: str = "text", media_col: str = "media", lacing: str = "fixed") -> DataFrame:
    """``df`` with ``media_col`` binary in place of the text: the padded UTF-8 bytes as a Matroska file."""
    make = lambda: lambda column: [pa.array([mux(pad(b), lacing) for b in utf8(column)], pa.binary())]
    return add_columns(df, text_col, T.StructType([T.StructField(media_col, T.BinaryType())]), make, drop_source=True)


def parse(df: DataFrame, media_col: str = "media", out_col: str = "packets") -> DataFrame:
    """``df`` with the packet table of each medium as an array of structs; explode it for rows."""

    def make() -> Callable:
        names = PACKET.fieldNames()
        return lambda column: [pa.array([[dict(zip(names, p, strict=True)) for p in demux(m)] if m else [] for m in column.to_pylist()], pa.list_(PACKET_ARROW))]

    return add_columns(df, media_col, T.StructType([T.StructField(out_col, T.ArrayType(PACKET))]), make)


def read(df: DataFrame, media_col: str = "media") -> DataFrame:
    """``df`` with ``payload`` (the packets' bytes in order), ``n_packets`` and ``feature``."""

    def make() -> Callable:
        def kernel(column: pa.Array) -> list:
            payloads, counts, shapes = [], [], []
            for m in column.to_pylist():
                packets = demux(m) if m else []
                payloads.append(b"".join([m[p[2] : p[2] + p[3]] for p in packets]))
                counts.append(len(packets))
                shapes.append(features(payloads[-1], len(packets)))
            return [pa.array(payloads, pa.binary()), pa.array(counts, pa.int64()), pa.array(shapes, pa.string())]

        return kernel

    fields = T.StructType([T.StructField("payload", T.BinaryType()), T.StructField("n_packets", T.LongType()), T.StructField("feature", T.StringType())])
    return add_columns(df, media_col, fields, make)


def op10_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    held = read(store(docs))
    tail = F.expr("substring(payload, greatest(length(payload) - 15, 1), 16)")
    return held.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", "n_packets",
    )

"""Media columns in Matroska: bytes in, packet tables out.

``packets`` reads the EBML tree of a file: variable-length ids and sizes, unknown sizes,
clusters, simple blocks and block groups, and all four kinds of lacing.  Every frame becomes a
packet with track, timestamp, cluster and byte range, so that samples can be read back
without decoding anything else.  ``write_audio`` stores 8-bit PCM samples in the same format.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamframe.plans.workers import prepared

# Element ids of the format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x2AD7B1, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, RATE, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
_PARENTS = {SEGMENT, CLUSTER, BLOCK_GROUP, TRACKS, TRACK_ENTRY, INFO, CUES, CUE_POINT, CUE_POSITIONS}
_TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1043A770, 0x1941A469, 0x1254C367}
NO_LACING, XIPH, FIXED, EBML_LACING = 0x00, 0x02, 0x04, 0x06

#: Samples of a frame, frames of a block, blocks of a cluster, samples a second.
FRAME, LACED, BLOCKS, SAMPLE_RATE = 192, 8, 128, 8000


class Packet(NamedTuple):
    """A frame: its track, time in nanoseconds, byte range in the file, place of its cluster, and lacing."""

    track: int
    timestamp: int
    offset: int
    length: int
    cluster: int
    lacing: int


class Cue(NamedTuple):
    timestamp: int
    track: int
    cluster: int


def _size(n: int, width: int = 0) -> bytes:
    """A variable-length size in as few bytes as hold it, or in ``width``."""
    while not width or n > (1 << 7 * width) - 2:
        width += 1
        if n <= (1 << 7 * width) - 2:
            break
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _id(n: int) -> bytes:
    return n.to_bytes((n.bit_length() + 7) // 8, "big")


def _element(kind: int, body: bytes) -> bytes:
    return _id(kind) + _size(len(body)) + body


def _uint(kind: int, n: int) -> bytes:
    return _element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _read_size(data: bytes, at: int) -> tuple[int | None, int, int]:
    """(value, width, next place); None is the unknown size."""
    if at >= len(data) or data[at] == 0:
        raise ValueError(f"no variable-length number at byte {at}")
    width = 9 - data[at].bit_length()
    raw = int.from_bytes(data[at : at + width], "big")
    if at + width > len(data):
        raise ValueError(f"file ends inside a number at byte {at}")
    value = raw & ((1 << 7 * width) - 1)
    return (None if value == (1 << 7 * width) - 1 else value), width, at + width


def elements(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[int, int, int, int]]:
    """(id, place of the element, place of its body, end) of the elements side by side from ``start``."""
    end = len(data) if end is None else end
    at = start
    while at < end:
        first = data[at]
        width = 9 - first.bit_length() if first else 9
        if width > 4 or at + width > end:
            raise ValueError(f"no element id at byte {at}")
        kind = int.from_bytes(data[at : at + width], "big")
        size, _, body = _read_size(data, at + width)
        stop = end if size is None else body + size
        if size is None and kind == CLUSTER:  # ends where the next top element begins
            stop = body
            for inner, place, _, after in elements(data, body, end):
                if inner in _TOP:
                    stop = place
                    break
                stop = after
        if stop > end:
            raise ValueError(f"element at byte {at} runs past its parent's end")
        yield kind, at, body, stop
        at = stop


def _laced(data: bytes, at: int, end: int, lacing: int) -> list[int]:
    """Frame sizes of a block's body at ``at``; the first item is the place of the first frame."""
    if lacing == NO_LACING:
        return [at, end - at]
    count = data[at] + 1
    at += 1
    sizes: list[int] = []
    if lacing == XIPH:
        for _ in range(count - 1):
            n = 0
            while data[at] == 255:
                n += 255
                at += 1
            sizes.append(n + data[at])
            at += 1
    elif lacing == EBML_LACING:
        for k in range(count - 1):
            value, width, at = _read_size(data, at)
            if value is None:
                value = (1 << 7 * width) - 1  # all ones is a difference here
            sizes.append(value if k == 0 else sizes[-1] + value - ((1 << 7 * width - 1) - 1))
    else:
        if (end - at) % count:
            raise ValueError("frames of fixed lacing don't fill their block")
        sizes = [(end - at) // count] * (count - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames run past their block")
    return [at, *sizes]


def packets(data: bytes, frame_ns: dict[int, int] | None = None) -> tuple[list[Packet], list[Cue]]:
    """All packets in file order, and the cues.  ``frame_ns``: by track, time between laced frames (else 0)."""
    found: list[Packet] = []
    cues: list[Cue] = []
    scale = 1_000_000
    for kind, _, body, end in elements(data):
        if kind != SEGMENT:
            continue
        for top, place, inner, stop in elements(data, body, end):
            if top == INFO:
                for k, _, b, e in elements(data, inner, stop):
                    scale = int.from_bytes(data[b:e], "big") if k == TIMESTAMP_SCALE else scale
            elif top == CLUSTER:
                base = 0
                for k, _, b, e in elements(data, inner, stop):
                    if k == CLUSTER_TIME:
                        base = int.from_bytes(data[b:e], "big")
                        continue
                    blocks = [(b, e)] if k == SIMPLE_BLOCK else [(x, y) for n, _, x, y in elements(data, b, e) if n == BLOCK] if k == BLOCK_GROUP else []
                    for x, y in blocks:
                        track, _, at = _read_size(data, x)
                        time = (base + int.from_bytes(data[at : at + 2], "big", signed=True)) * scale
                        lacing = data[at + 2] & 0x06
                        at, *sizes = _laced(data, at + 3, y, lacing)
                        step = (frame_ns or {}).get(track, 0)
                        for n, size in enumerate(sizes):
                            found.append(Packet(track, time + n * step, at, size, place - body, lacing))
                            at += size
            elif top == CUES:
                for _, _, b, e in elements(data, inner, stop):
                    time = 0
                    for k, _, x, y in elements(data, b, e):
                        if k == CUE_TIME:
                            time = int.from_bytes(data[x:y], "big") * scale
                        elif k == CUE_POSITIONS:
                            got = {n: int.from_bytes(data[p:q], "big") for n, _, p, q in elements(data, x, y)}
                            cues.append(Cue(time, got.get(CUE_TRACK, 0), got.get(CUE_CLUSTER, 0)))
    return found, cues


def _block(track: int, relative: int, frames: list[bytes], lacing: int) -> bytes:
    head = _size(track) + struct.pack(">hB", relative, 0x80 | lacing)
    if lacing == NO_LACING:
        return _element(SIMPLE_BLOCK, head + frames[0])
    laces = bytes([len(frames) - 1])
    if lacing == XIPH:
        laces += b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    elif lacing == EBML_LACING:
        laces += _size(len(frames[0]))
        for before, f in zip(frames, frames[1:-1], strict=False):
            step = len(f) - len(before)
            width = next(w for w in range(1, 9) if abs(step) < (1 << 7 * w - 1) - 1)
            laces += (step + (1 << 7 * width - 1) - 1 | 1 << 7 * width).to_bytes(width, "big")
    return _element(SIMPLE_BLOCK, head + laces + b"".join(frames))


def write_audio(samples: bytes, frame: int = FRAME, laced: int = LACED, blocks: int = BLOCKS, rate: int = SAMPLE_RATE, lacing: int = FIXED) -> bytes:
    """A Matroska file with one track of unsigned 8-bit PCM; the bytes depend on the samples alone."""
    ms = frame * 1000 // rate
    frames = [samples[k : k + frame] for k in range(0, len(samples), frame)]
    head = _element(EBML, _element(DOC_TYPE, b"matroska") + _uint(DOC_TYPE_VERSION, 4) + _uint(DOC_TYPE_READ_VERSION, 2))
    audio = _element(AUDIO, _element(RATE, struct.pack(">d", rate)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
    track = _element(TRACK_ENTRY, _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _element(CODEC_ID, b"A_PCM/INT/LIT") + audio)
    parts = [_element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000)), _element(TRACKS, track)]
    place, cues = sum(map(len, parts)), []
    for first in range(0, len(frames), laced * blocks):
        body = [_uint(CLUSTER_TIME, first * ms)]
        for k in range(first, min(first + laced * blocks, len(frames)), laced):
            group = frames[k : k + laced]
            equal = len({len(f) for f in group}) == 1
            kind = NO_LACING if len(group) == 1 else lacing if equal or lacing != FIXED else EBML_LACING
            body.append(_block(1, (k - first) * ms, group, kind))
        cluster = _element(CLUSTER, b"".join(body))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, first * ms) + _element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, place))))
        parts.append(cluster)
        place += len(cluster)
    return head + _element(SEGMENT, b"".join(parts) + _element(CUES, b"".join(cues)))


def padded(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and the text in UTF-8 with spaces up to a positive multiple of 192."""
    raw = (text or "").encode()
    return len(raw), raw + b" " * (max(1, -(-len(raw) // FRAME)) * FRAME - len(raw))


def _features(samples: np.ndarray, n_packets: int, n_cues: int) -> str:
    """Packets, cues, length, and level, spread, sign changes and eight-band histogram of the centred samples."""
    x = samples.astype(np.int64) - 128
    turns = int(np.count_nonzero(np.diff(np.signbit(x))))
    bands = np.bincount(samples >> 5, minlength=8)
    return f"packets={n_packets};cues={n_cues};samples={len(x)};sum={int(x.sum())};squares={int((x * x).sum())};turns={turns};bands=" + ",".join(map(str, bands))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            both = [padded(t.as_py()) for t in part.column("text")]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([n for n, _ in both], type=pa.int64()), pa.array([write_audio(p) for _, p in both], type=pa.binary())], ["doc_id", "n_bytes", "media"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for cell in batch.column("media"):
            media = cell.as_py()
            found, cues = packets(media, {1: FRAME * 1_000_000_000 // SAMPLE_RATE})
            payload = b"".join(media[p.offset : p.offset + p.length] for p in found)
            feature = _features(np.frombuffer(payload, dtype=np.uint8), len(found), len(cues))
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True))],
            ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )


def to_media(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: each text's padded bytes as a Matroska file.

    Null counts as empty; repeated rows get a row each, an empty table gives none, and other columns are neither read nor kept.
    """
    return prepared(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_encode, "doc_id bigint, n_bytes bigint, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Digests and features of a media column, from the samples that its packets hold.

    Input ``doc_id, n_bytes, media`` (not null); a row out per row in, an empty table gives none.
    A file that breaks the format raises ValueError with the byte at which it does.
    """
    fields = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return prepared(media).select("doc_id", "n_bytes", "media").mapInArrow(_digest, fields)


def _tables(batches: Iterator[pa.RecordBatch], frame_ns: dict[int, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if cell.as_py() is None:
                continue
            found, _ = packets(cell.as_py(), frame_ns)
            for k in range(0, len(found), 8192):
                rows = found[k : k + 8192]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(rows), type=pa.int64()), pa.array(range(k, k + len(rows)), type=pa.int64()), *(pa.array(c, type=pa.int64()) for c in columns)], ["key", "packet", *Packet._fields])


def packet_table(media: DataFrame, key: str = "doc_id", column: str = "media", frame_ns: dict[int, int] | None = None) -> DataFrame:
    """A row per packet: key, number, track, timestamp, byte range, cluster and lacing; null media have none."""
    rows = prepared(media).select(F.col(key).cast("bigint").alias("key"), F.col(column).alias("media"))
    out = rows.mapInArrow(partial(_tables, frame_ns=frame_ns or {}), ", ".join(f"{n} bigint" for n in ("key", "packet", *Packet._fields)))
    return out.withColumnRenamed("key", key)

"""Media columns: Matroska files as packet tables.

`read_packets` parses any Matroska bytes: EBML elements of variable length (unknown sizes too), clusters, simple blocks and
block groups, the three kinds of lacing, and cues. `store_samples` writes 8-bit PCM into such a file.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import id_and_text, small_batches, table

# Element ids of the public format description.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ_VERSION, MAX_ID_LENGTH, MAX_SIZE_LENGTH = 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, AUDIO = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1
SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH, DEFAULT_DURATION = 0xB5, 0x9F, 0x6264, 0x23E383
CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
CONTENT_ENCODINGS, CONTENT_ENCODING, COMPRESSION, COMPRESSION_KIND, COMPRESSION_SETTINGS = 0x6D80, 0x6240, 0x5034, 0x4254, 0x4255
HEADER_STRIPPING = 3
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

FRAME = 576  # samples in a packet; at 8,000 a second 72 ms
LACE = 8  # packets in a block
BLOCKS = 32  # blocks in a cluster
RATE = 8_000
MILLISECONDS = FRAME * 1000 // RATE


def size_field(n: int) -> bytes:
    """A variable-length size in as few bytes as hold it; all ones would mean an unknown size."""
    length = 1
    while n >= (1 << 7 * length) - 1:
        length += 1
    return (n | 1 << 7 * length).to_bytes(length, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + size_field(len(body)) + body


def unsigned(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def laced(frames: list[bytes], lacing: int) -> bytes:
    """Frames of one block behind the head of their lacing."""
    if lacing == NO_LACING:
        return frames[0]
    head = bytes([len(frames) - 1])
    sizes = list(map(len, frames))
    if lacing == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == EBML_LACING:
        head += size_field(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            length = 1
            while not -(1 << 7 * length - 1) < b - a < (1 << 7 * length - 1):
                length += 1
            head += (b - a + (1 << 7 * length - 1) - 1 | 1 << 7 * length).to_bytes(length, "big")
    return head + b"".join(frames)


def store_samples(payload: bytes) -> bytes:
    """A Matroska file with one track of unsigned 8-bit PCM that holds the payload, FRAME samples a packet."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    head = element(EBML, unsigned(EBML_VERSION, 1) + unsigned(EBML_READ_VERSION, 1) + unsigned(MAX_ID_LENGTH, 4) + unsigned(MAX_SIZE_LENGTH, 8) + element(DOC_TYPE, b"matroska") + unsigned(DOC_TYPE_VERSION, 4) + unsigned(DOC_TYPE_READ_VERSION, 2))
    info = element(INFO, unsigned(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(frames) * MILLISECONDS)) + element(MUXING_APP, b"tallyloom") + element(WRITING_APP, b"tallyloom"))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">f", RATE)) + unsigned(CHANNELS, 1) + unsigned(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, unsigned(TRACK_NUMBER, 1) + unsigned(TRACK_UID, 1) + unsigned(TRACK_TYPE, 2) + unsigned(DEFAULT_DURATION, MILLISECONDS * 1_000_000) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    body, cues, at = [info, tracks], [], len(info) + len(tracks)
    for i in range(0, len(frames), LACE * BLOCKS):
        time = i * MILLISECONDS
        blocks = [unsigned(CLUSTER_TIMESTAMP, time)]
        for j in range(i, min(len(frames), i + LACE * BLOCKS), LACE):
            own = frames[j : j + LACE]
            lacing = FIXED if len(own) > 1 else NO_LACING
            flags = 0x80 | lacing << 1
            blocks.append(element(SIMPLE_BLOCK, size_field(1) + struct.pack(">hB", j * MILLISECONDS - time, flags) + laced(own, lacing)))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, unsigned(CUE_TIME, time) + element(CUE_TRACK_POSITIONS, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER_POSITION, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(body))


@dataclass
class Media:
    """What was found: packets as (track, ticks, start, size, key frame, cluster), their times and durations in nanoseconds,
    tracks, and cues as (ticks, track, place of the cluster). A cluster is named by the byte that it starts at."""

    packets: list[tuple[int, int, int, int, bool, int]] = field(default_factory=list)
    times: list[tuple[int, int | None]] = field(default_factory=list)
    tracks: dict[int, dict] = field(default_factory=dict)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    scale: int = 1_000_000
    duration: float = 0.0
    segment: int = 0
    faults: list[str] = field(default_factory=list)


def variable(data, at: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """A variable-length integer and the place after it; None for a size that is unknown."""
    first = data[at]
    length = 9 - first.bit_length()
    if length > 8 or at + length > len(data):
        raise ValueError(f"no integer at byte {at}")
    n = int.from_bytes(data[at : at + length], "big")
    if keep_marker:
        return n, at + length
    n &= (1 << 7 * length) - 1
    return (None if n == (1 << 7 * length) - 1 else n), at + length


MASTERS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS, CONTENT_ENCODINGS, CONTENT_ENCODING, COMPRESSION}
TOP = {INFO, TRACKS, CLUSTER, CUES, SEGMENT, EBML, 0x114D9B74, 0x1254C367, 0x1941A469, 0x1043A770}  # what ends an unknown size


def elements(data, start: int, end: int, ends=frozenset()):
    """(id, body start, body end, size known, start) of the elements side by side in a range; one of `ends` ends it early."""
    at = start
    while at < end:
        ident, body = variable(data, at, True)
        if ident in ends:
            return
        size, body = variable(data, body)
        stop = end if size is None else body + size
        if stop > end:
            if ident in MASTERS:  # what is left of it is sound
                yield ident, body, end, True, at
            raise ValueError(f"element {ident:#x} at byte {at} is cut")
        yield ident, body, stop, size is not None, at
        if size is None:
            at = body
            for _, _, at, *_ in elements(data, body, end, ends_of(ident)):
                pass
        else:
            at = stop


def ends_of(ident: int) -> set[int]:
    """What ends an element of unknown size."""
    return {EBML, SEGMENT} if ident == SEGMENT else TOP


def number(data, start: int, end: int) -> int:
    return int.from_bytes(data[start:end], "big")


def real(data, start: int, end: int) -> float:
    return struct.unpack(">f" if end - start == 4 else ">d", data[start:end])[0] if end - start in (4, 8) else 0.0


def frames_of(data, start: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """(start, size) of the frames in a block's body."""
    if lacing == NO_LACING:
        return [(start, end - start)]
    count, at, sizes = data[start] + 1, start + 1, []
    if lacing == FIXED:
        if (end - at) % count:
            raise ValueError(f"fixed lacing at byte {start} doesn't divide its block")
        return [(at + i * ((end - at) // count), (end - at) // count) for i in range(count)]
    if lacing == XIPH:
        for _ in range(count - 1):
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            sizes.append(n + data[at])
            at += 1
    else:
        for i in range(count - 1):
            before = at
            n, at = variable(data, at)
            n = (1 << 7 * (at - before)) - 1 if n is None else n
            sizes.append(n if i == 0 else sizes[-1] + n - ((1 << 7 * (at - before) - 1) - 1))
    rest = end - at - sum(sizes)
    if rest < 0 or min(sizes, default=0) < 0:
        raise ValueError(f"lacing at byte {start} needs more than its block")
    out = []
    for n in [*sizes, rest]:
        out.append((at, n))
        at += n
    return out


def parse(data: bytes) -> Media:
    """Parse a file as far as it is sound; what stopped it is in faults."""
    media = Media()

    def block(start: int, end: int, time: int, cluster: int, key: bool | None, ticks: int | None = None) -> None:
        """Packets of a block. A simple block says itself whether it is a key frame. A duration is given by the block for
        all of its frames, or by the track for each."""
        track, at = variable(data, start)
        relative, flags = struct.unpack_from(">hB", data, at)
        frames = frames_of(data, at + 3, end, flags >> 1 & 3)
        each = media.tracks.get(track, {}).get("default_ns", 0)
        own = ticks * media.scale // len(frames) if ticks is not None else each or None
        for i, (s, n) in enumerate(frames):
            ns = (time + relative) * media.scale + i * (each or own or 0)
            media.packets.append((track, ns // media.scale, s, n, bool(flags & 0x80) if key is None else key, cluster))
            media.times.append((ns, own))

    def walk(start: int, end: int, ends, state: dict) -> None:
        for ident, s, e, known, at in elements(data, start, end, ends):
            if ident in MASTERS:
                inner = state
                if ident == SEGMENT:
                    media.segment = s
                elif ident == CLUSTER:
                    inner = {**state, "cluster": at, "time": 0}
                elif ident == TRACK_ENTRY:
                    inner = {**state, "entry": {}}
                elif ident == CUE_POINT:
                    inner = {**state, "cue": [0, []]}
                elif ident == CUE_TRACK_POSITIONS and "cue" in state:
                    state["cue"][1].append([0, 0])
                elif ident == BLOCK_GROUP:
                    inner = {**state, "group": {}}
                try:
                    walk(s, e, frozenset() if known else ends_of(ident), inner)
                finally:  # what was sound before a damage counts
                    if ident == BLOCK_GROUP and "block" in inner["group"]:
                        group = inner["group"]
                        block(*group["block"], state["time"], state["cluster"], "reference" not in group, group.get("duration"))
                if ident == TRACK_ENTRY:
                    media.tracks[inner["entry"].get("number", 0)] = inner["entry"]
                elif ident == CUE_POINT:
                    media.cues += [(inner["cue"][0], *place) for place in inner["cue"][1]]
            elif ident == CLUSTER_TIMESTAMP:
                state["time"] = number(data, s, e)
            elif ident == SIMPLE_BLOCK:
                block(s, e, state["time"], state["cluster"], None)
            elif ident == BLOCK and "group" in state:
                state["group"]["block"] = (s, e)
            elif ident == BLOCK_DURATION and "group" in state:
                state["group"]["duration"] = number(data, s, e)
            elif ident == REFERENCE_BLOCK and "group" in state:
                state["group"]["reference"] = True
            elif ident == TIMESTAMP_SCALE:
                media.scale = number(data, s, e) or 1_000_000
            elif ident == DURATION:
                media.duration = real(data, s, e)
            elif ident == CUE_TIME and "cue" in state:
                state["cue"][0] = number(data, s, e)
            elif ident in (CUE_TRACK, CUE_CLUSTER_POSITION) and state.get("cue", [0, []])[1]:
                state["cue"][1][-1][ident == CUE_CLUSTER_POSITION] = number(data, s, e)
            elif "entry" in state:
                entry = state["entry"]
                if ident == TRACK_NUMBER:
                    entry["number"] = number(data, s, e)
                elif ident == TRACK_TYPE:
                    entry["type"] = number(data, s, e)
                elif ident == CODEC_ID:
                    entry["codec"] = data[s:e].decode("ascii", "replace")
                elif ident == DEFAULT_DURATION:
                    entry["default_ns"] = number(data, s, e)
                elif ident == SAMPLING_FREQUENCY:
                    entry["rate"] = real(data, s, e)
                elif ident == BIT_DEPTH:
                    entry["bits"] = number(data, s, e)
                elif ident == COMPRESSION_KIND:
                    entry["compression"] = number(data, s, e)
                elif ident == COMPRESSION_SETTINGS:
                    entry["settings"] = bytes(data[s:e])

    try:
        walk(0, len(data), frozenset(), {"time": 0, "cluster": 0})
    except (ValueError, IndexError, struct.error) as e:
        media.faults.append(str(e))
    return media


PACKET = "track int, packet int, timestamp_ns long, duration_ns long, start long, size long, keyframe boolean, cluster_start long, compression int, prefix binary"
CUE = "track int, timestamp_ns long, cluster_start long"


def _exploded(media: DataFrame, key: str, column: str, schema: str, rows_of) -> DataFrame:
    """key and the rows that rows_of finds in each value of a column."""
    small_batches(media.sparkSession, 200)
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]

    def batches(it):
        for b in it:
            keys, rows = [], []
            for k, data in enumerate(b.column(1)):
                found = rows_of(parse(data.as_py() or b""))
                keys += [k] * len(found)
                rows += found
            columns = list(zip(*rows)) or [()] * len(fields)
            yield pa.record_batch([b.column(0).take(pa.array(keys, pa.int64())), *(pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields))], names=[key, *(n for n, _ in fields)])

    kind = media.schema[key].dataType.simpleString()
    return media.select(key, column).mapInArrow(batches, f"`{key}` {kind}, {schema}")


def read_packets(media: DataFrame, key: str, column: str) -> DataFrame:
    """A packet table: one row per packet of each Matroska value, with track, time, duration and byte range.

    Ranges are of the bytes as stored. compression is the track's kind of it, or null; where that is header stripping (3)
    a frame is prefix and then its bytes. Null and empty values have no packets; damaged ones have those before the damage.
    """

    def rows_of(found: Media) -> list[tuple]:
        packing = {n: (t.get("compression", 0) if "settings" in t or "compression" in t else None, t.get("settings")) for n, t in found.tracks.items()}
        packing = {n: (kind, settings if kind == HEADER_STRIPPING else None) for n, (kind, settings) in packing.items()}
        return [(t, i, ns, length, s, n, kf, c, *packing.get(t, (None, None))) for i, ((t, _, s, n, kf, c), (ns, length)) in enumerate(zip(found.packets, found.times))]

    return _exploded(media, key, column, PACKET, rows_of)


def read_cues(media: DataFrame, key: str, column: str) -> DataFrame:
    """A cue table: one row per place that a cue point names, with track, time and the byte its cluster starts at, which is
    the cluster_start of that cluster's packets."""
    return _exploded(media, key, column, CUE, lambda found: [(track, ticks * found.scale, found.segment + at) for ticks, track, at in found.cues])


def features(found: Media, data: bytes, payload: bytes) -> str:
    """Numbers of the container and of its samples, read back."""
    samples = np.frombuffer(payload, np.uint8)
    crossings = int(np.count_nonzero((samples[1:] >= 128) != (samples[:-1] >= 128)))
    sizes = [n for _, _, _, n, _, _ in found.packets]
    return (
        f"packets={len(sizes)};clusters={len({p[5] for p in found.packets})};cues={len(found.cues)};ms={found.duration:.0f};"
        f"last_ms={found.packets[-1][1]};mean={samples.mean():.6f};deviation={samples.std():.6f};peak={int(samples.max())};crossings={crossings}"
    )


def media_digests(docs: DataFrame) -> DataFrame:
    """Store each text as samples, read the stored bytes back and describe them.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature. Null and empty texts
    are one packet of padding; very long texts are stored whole; repeated rows each give a row; other columns are left
    behind whatever their names; an empty table gives an empty table.
    """
    small_batches(docs.sparkSession, 500)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def batches(it):
        for b in it:
            rows = []
            for doc, t in zip(b.column("doc_id").to_pylist(), b.column("text")):
                raw = t.as_py().encode("utf-8")
                stored = store_samples(raw + b"\xff" * (-len(raw) % FRAME or FRAME * (not raw)))
                found = parse(stored)
                back = b"".join(stored[s : s + n] for _, _, s, n, _, _ in found.packets)
                rows.append((doc, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), features(found, stored, back)))
            columns = list(zip(*rows)) or [()] * 8
            kinds = [pa.int64() if x.endswith("long") else pa.string() for x in schema.split(", ")]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in schema.split(", ")])

    return id_and_text(docs).mapInArrow(batches, schema)


def op5_matroska_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.col("feature"))

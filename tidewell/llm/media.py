"""Media columns: motion-JPEG in AVI, indexed, decoded and cut into timed clips.

Bytes are held losslessly in the format's own unit, the quantised DCT
coefficient. A coefficient of the eighth magnitude category takes 256 values and
its eight extra bits tell which, so those bits are a byte. Each 8x8 block has a
DC difference of zero, a bit of code, and 63 such coefficients of a bit of code
and eight bits, 71 bytes in all. The Huffman tables in the file say so, and any
baseline decoder reads the frames.

Null and empty texts are 192 spaces. Equal texts give equal files. Repeated rows are stored each, and texts of any
length whole. An empty table gives no rows. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import map_slices

UNIT = 192
#: Coefficients of a block that hold bytes, and bytes that a block then takes.
HELD, CODED = 63, 71
#: Blocks along and down a frame.
ACROSS, DOWN = 4, 3
PER_FRAME = ACROSS * DOWN * HELD
FRAMES_A_SECOND = 25
#: Bins of a frame's histogram; frames looked back on for the adaptive threshold.
BINS, BACK = 32, 8

#: Column and row of the coefficients in the order that JPEG stores them in.
ZIGZAG = np.array(
    sorted(range(64), key=lambda i: (s := i // 8 + i % 8, i // 8 if s % 2 else i % 8)), dtype=np.int64
)


def basis() -> np.ndarray:
    """Inverse DCT of a block as a matrix: samples from coefficients in stored order."""
    x = np.arange(8)
    one = np.cos((2 * x[:, None] + 1) * x[None, :] * np.pi / 16) * np.where(x == 0, np.sqrt(0.125), 0.5)
    return np.einsum("yv,xu->vuyx", one, one).reshape(64, 64)[ZIGZAG].astype(np.float32)


INVERSE = basis()


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def table(kind: int, codes: list[list[int]]) -> bytes:
    """A Huffman table. ``codes``: the symbols that have a code of 1, 2, ... bits."""
    lengths = bytes(len(x) for x in codes).ljust(16, b"\0")
    return segment(0xC4, bytes([kind]) + lengths + bytes(s for x in codes for s in x))


#: A quantisation of ones; one 8-bit component; category 0 of DC and eight bits after
#: no zero of AC, each by the code 0; the end of a block by 10.
HEAD = (
    b"\xff\xd8"
    + segment(0xDB, b"\0" + b"\1" * 64)
    + segment(0xC0, struct.pack(">BHHB", 8, 8 * DOWN, 8 * ACROSS, 1) + b"\1\x11\0")
    + table(0x00, [[0]])
    + table(0x10, [[8], [0]])
    + segment(0xDA, b"\1\1\0\0\x3f\0")
)


def frame(data: bytes) -> bytes:
    """A baseline JPEG whose coefficients hold ``data``, PER_FRAME bytes."""
    bits = np.zeros((len(data) // HELD, 1 + 9 * HELD), dtype=np.uint8)
    held = np.frombuffer(data, dtype=np.uint8).reshape(-1, HELD, 1)
    bits[:, 1:].reshape(-1, HELD, 9)[:, :, 1:] = np.unpackbits(held, axis=2)
    return HEAD + np.packbits(bits, axis=1).tobytes().replace(b"\xff", b"\xff\0") + b"\xff\xd9"


def coefficients(jpeg: bytes) -> np.ndarray:
    """The bytes that the coefficients of a frame hold, by block. Checks each code on the way."""
    if not jpeg.startswith(HEAD) or not jpeg.endswith(b"\xff\xd9"):
        raise ValueError("not a frame of this store")
    scan = np.frombuffer(jpeg[len(HEAD) : -2].replace(b"\xff\0", b"\xff"), dtype=np.uint8)
    bits = np.unpackbits(scan.reshape(-1, CODED), axis=1)
    codes = bits[:, 1:].reshape(-1, HELD, 9)
    if bits[:, 0].any() or codes[:, :, 0].any():
        raise ValueError("a code of this frame is not one that the store writes")
    return np.packbits(codes[:, :, 1:], axis=2).reshape(-1, HELD)


def samples(held: np.ndarray) -> np.ndarray:
    """Decoded 8-bit samples of blocks: extra bits to coefficients, inverse DCT, level shift."""
    values = held.astype(np.float32)
    values[held < 128] -= 255
    return np.clip(np.rint(values @ INVERSE[1:] + 128), 0, 255).astype(np.uint8)


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def store(payload: bytes) -> bytes:
    """An AVI of JPEG frames that holds ``payload``, with an index of the frames."""
    size = struct.pack("<Q", len(payload))
    padded = payload + b"\0" * (-len(payload) % PER_FRAME)
    frames = [frame(padded[i : i + PER_FRAME]) for i in range(0, len(padded), PER_FRAME)]
    wide, high, n = 8 * ACROSS, 8 * DOWN, len(frames)
    largest = max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // FRAMES_A_SECOND, 0, 0, 0x10, n, 0, 1, largest, wide, high, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<10I4H", 0, 0, 0, 1, FRAMES_A_SECOND, 0, n, largest, 0, 0, 0, 0, wide, high)
    form = struct.pack("<IIIHH4sIIIII", 40, wide, high, 1, 8, b"MJPG", wide * high, 0, 0, 0, 0)
    header = b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", form))
    index, body = [], [b"movi"]
    at = 4
    for x in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(x)))
        body.append(chunk(b"00dc", x))
        at += len(body[-1])
    lists = chunk(b"LIST", header) + chunk(b"LIST", b"INFO" + chunk(b"ISBJ", size))
    return chunk(b"RIFF", b"AVI " + lists + chunk(b"LIST", b"".join(body)) + chunk(b"idx1", b"".join(index)))


def chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Name, start and end of the chunks between two places; lists are named by their type."""
    while at + 8 <= end:
        name, size = struct.unpack_from("<4sI", data, at)
        if at + 8 + size > end:
            raise ValueError("a chunk ends behind its list")
        if name in (b"RIFF", b"LIST"):
            yield data[at + 8 : at + 12], at + 12, at + 8 + size
        else:
            yield name, at + 8, at + 8 + size
        at += 8 + size + size % 2


class Video(NamedTuple):
    frames: list[bytes]
    micros: int
    size: int


def parse(data: bytes) -> Video:
    """Frames by the index, microseconds a frame and the payload's size."""
    ((kind, start, end),) = chunks(data, 0, len(data))
    if kind != b"AVI ":
        raise ValueError("not an AVI")
    lists = {name: (a, b) for name, a, b in chunks(data, start, end)}
    header = {name: a for name, a, _ in chunks(data, *lists[b"hdrl"])}
    info = {name: a for name, a, _ in chunks(data, *lists[b"INFO"])}
    movi = lists[b"movi"][0] - 4
    frames = []
    for at in range(*lists[b"idx1"], 16):
        name, _, offset, size = struct.unpack_from("<4sIII", data, at)
        if data[movi + offset : movi + offset + 8] != struct.pack("<4sI", name, size):
            raise ValueError("the index doesn't fit the frames")
        frames.append(data[movi + offset + 8 : movi + offset + 8 + size])
    return Video(frames, struct.unpack_from("<I", data, header[b"avih"])[0], *struct.unpack_from("<Q", data, info[b"ISBJ"]))


class Clip(NamedTuple):
    start_ms: int
    end_ms: int
    frames: int
    brightness: float


def shots(histograms: np.ndarray) -> list[int]:
    """Frames that begin a shot: their histogram differs from the one before by more than the
    mean of the last differences and three times their spread, and by a tenth at least."""
    if not len(histograms):
        return []
    differ = np.abs(np.diff(histograms, axis=0)).sum(axis=1) / 2
    found = [0]
    for i, d in enumerate(differ):
        last = differ[max(found[-1], i - BACK) : i]
        if len(last) >= 2 and d > max(0.1, last.mean() + 3 * last.std()):
            found.append(i + 1)
    return found


def clips(decoded: list[np.ndarray], micros: int) -> list[Clip]:
    """Timed clip rows from the decoded samples of the frames."""
    if not decoded:
        return []
    wide = 256 // BINS
    histograms = np.array([np.bincount((x // wide).ravel(), minlength=BINS) / x.size for x in decoded])
    bright = [float(x.mean()) for x in decoded]
    starts = shots(histograms)
    return [
        Clip(a * micros // 1000, b * micros // 1000, b - a, sum(bright[a:b]) / (b - a))
        for a, b in zip(starts, [*starts[1:], len(decoded)], strict=True)
    ]


def read(data: bytes) -> tuple[bytes, list[Clip]]:
    """The payload and the clips of a stored file."""
    video = parse(data)
    held = [coefficients(x) for x in video.frames]
    return b"".join(x.tobytes() for x in held)[: video.size], clips([samples(x) for x in held], video.micros)


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 with spaces up to a positive multiple of UNIT, and its length without them."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b" "), len(raw)


def feature(found: list[Clip]) -> str:
    """The clips as start-end:frames:brightness in milliseconds, comma-joined."""
    return ",".join(f"{c.start_ms}-{c.end_ms}:{c.frames}:{c.brightness:.2f}" for c in found)


MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("media", pa.binary())])
DIGEST = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_sha256", pa.string()),
        ("tail_crc32", pa.int64()),
        ("media_bytes", pa.int64()),
        ("media_sha256", pa.string()),
        ("feature", pa.string()),
    ]
)
CLIPS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("clip", pa.int32()),
        ("start_ms", pa.int64()),
        ("end_ms", pa.int64()),
        ("frames", pa.int32()),
        ("brightness", pa.float64()),
    ]
)


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes and the media column with each text's AVI."""

    def make():
        def apply(rows: dict[str, list]) -> dict[str, list]:
            held = [padded(t) for t in rows["text"]]
            return {
                "doc_id": rows["doc_id"],
                "n_bytes": [n for _, n in held],
                "payload_bytes": [len(p) for p, _ in held],
                "media": [store(p) for p, _ in held],
            }

        return apply

    ddl = "doc_id long, n_bytes long, payload_bytes long, media binary"
    return map_slices(docs.select(F.col("doc_id").cast("long"), "text"), make, MEDIA, ddl)


def clip_rows(media: DataFrame) -> DataFrame:
    """The timed clip rows of a media column: doc_id, clip, start_ms, end_ms, frames, brightness."""

    def make():
        def apply(rows: dict[str, list]) -> dict[str, list]:
            found = [
                (d, i, *c) for d, m in zip(rows["doc_id"], rows["media"], strict=True) for i, c in enumerate(read(m)[1])
            ]
            columns = zip(*found, strict=True) if found else [[] for _ in CLIPS.names]
            return {n: list(v) for n, v in zip(CLIPS.names, columns, strict=True)}

        return apply

    ddl = "doc_id long, clip int, start_ms long, end_ms long, frames int, brightness double"
    return map_slices(media.select("doc_id", "media"), make, CLIPS, ddl)


def digests(media: DataFrame) -> DataFrame:
    """Digests of a media column: of the stored bytes, of the payload read back and of its clips."""

    def make():
        def apply(rows: dict[str, list]) -> dict[str, list]:
            back = [read(m) for m in rows["media"]]
            return {
                "doc_id": rows["doc_id"],
                "n_bytes": rows["n_bytes"],
                "payload_bytes": [len(p) for p, _ in back],
                "payload_sha256": [hashlib.sha256(p).hexdigest() for p, _ in back],
                "tail_crc32": [zlib.crc32(p[-16:]) for p, _ in back],
                "media_bytes": [len(m) for m in rows["media"]],
                "media_sha256": [hashlib.sha256(m).hexdigest() for m in rows["media"]],
                "feature": [feature(c) for _, c in back],
            }

        return apply

    ddl = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string"
    )
    return map_slices(media, make, DIGEST, ddl)

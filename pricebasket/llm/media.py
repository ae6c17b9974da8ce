"""Media columns: baseline JPEG files made, stored, parsed and decoded in batches; DC-only luminance thumbnails.

Storing bytes: a block of 64 payload bytes becomes the 64 quantised coefficients of one 8x8 block, in the scan's order.
Coefficients of size category 8 (-255..-128 and 128..255) stand for the 256 byte values, so each one's amplitude bits
are the byte itself and nothing is lost. Every block is a restart interval of its own; the file is a valid greyscale
baseline JPEG with its tables, and its comment segment holds the payload's length.

Reading: markers are parsed, then the scans of many images with the same tables are Huffman-decoded side by side in
numpy, one lane for each restart interval. Any baseline JPEG is read (several components, subsampling, any tables, no
restart intervals: then one lane an image). The thumbnail has one pixel a luminance block, from the DC coefficient.

Null texts are stored as empty ones: a payload of 64 zero bytes. Media that are null, cut off or no baseline JPEG give
null features and no error. Equal media give equal rows, repeated rows repeated ones, empty tables empty ones. Other
columns play no part. Images are decoded in groups of bounded size.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricebasket.llm.common import documents, map_batches, whole_text

UNIT = 64
#: Coded bytes that are decoded together, at least one image.
TOGETHER = 2_000_000
NOTE = b"payload "


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def write_jpeg(payload: bytes) -> bytes:
    """A baseline JPEG whose coefficients are the payload, of a positive multiple of 64 bytes."""
    if not payload or len(payload) % UNIT:
        raise ValueError("a payload has a positive multiple of 64 bytes")
    blocks = len(payload) // UNIT
    across = int(np.ceil(np.sqrt(blocks)))
    down = -(-blocks // across)
    if across > 8191:
        raise ValueError("too long for one image")
    samples = np.frombuffer(payload.ljust(across * down * UNIT, b"\0"), np.uint8)
    bits = np.zeros((len(samples), 9), np.uint8)  # a Huffman code of one bit, 0, then the amplitude's eight bits
    bits[:, 1:] = np.unpackbits(samples).reshape(-1, 8)
    packed, size = np.packbits(bits).tobytes(), UNIT * 9 // 8
    scan = [packed[i : i + size].replace(b"\xff", b"\xff\x00") for i in range(0, len(packed), size)]
    marks = [b"\xff" + bytes([0xD0 + k]) for k in range(8)]
    one_code = bytes([1, *[0] * 15])
    return b"".join(
        [
            b"\xff\xd8",
            _segment(0xFE, NOTE + str(len(payload)).encode()),
            _segment(0xDB, bytes([0, *[1] * 64])),
            _segment(0xC0, struct.pack(">BHHB", 8, down * 8, across * 8, 1) + bytes([1, 0x11, 0])),
            _segment(0xC4, b"\x00" + one_code + b"\x08"),
            _segment(0xC4, b"\x10" + one_code + b"\x08"),
            _segment(0xDD, struct.pack(">H", 1)),
            _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
            *(part + marks[i % 8] for i, part in enumerate(scan[:-1])),
            scan[-1],
            b"\xff\xd9",
        ]
    )


@dataclass
class Image:
    """What a file's markers say, and its scan as lanes: a lane's bytes are free of stuffing and markers."""

    width: int = 0
    height: int = 0
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, across, down, quantisation table
    order: list[tuple[int, int, int]] = field(default_factory=list)  # of the scan: part, DC table, AC table
    quantised: dict[int, bytes] = field(default_factory=dict)
    codes: dict[int, bytes] = field(default_factory=dict)
    interval: int = 0
    note: bytes = b""
    data: np.ndarray | None = None
    starts: np.ndarray | None = None

    def units(self) -> tuple[int, int]:
        """MCUs across and down."""
        h, v = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))

    def kind(self) -> tuple:
        """Images of one kind can be decoded side by side."""
        return (tuple((p[1], p[2]) for p in self.parts), tuple(self.order), tuple(sorted(self.codes.items())))


def parse_jpeg(data: bytes) -> Image:
    """Markers and lanes of a baseline JPEG with one interleaved scan; ValueError for anything else."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    image, at = Image(), 2
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        (size,) = struct.unpack_from(">H", data, at + 2)
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            image.note = body
        elif marker == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                image.quantised[body[0] & 15], body = body[1 : 1 + 64 * wide : 1] if wide == 1 else body[2 : 1 + 64 * wide : 2], body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                image.codes[body[0]], body = body[1 : 17 + n], body[17 + n :]
        elif marker == 0xC0:
            _, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            image.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            if not (image.width and image.height and n) or min(min(p[1], p[2]) for p in image.parts) < 1:
                raise ValueError("a frame without samples")
            if n == 1:
                image.parts = [(image.parts[0][0], 1, 1, image.parts[0][3])]
        elif 0xC1 <= marker <= 0xCF and marker != 0xC8:
            raise ValueError("not baseline")
        elif marker == 0xDD:
            (image.interval,) = struct.unpack(">H", body)
        elif marker == 0xDA:
            ids = [p[0] for p in image.parts]
            if body[0] != len(ids):
                raise ValueError("not one interleaved scan")
            image.order = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            if any(dc not in image.codes or ac | 16 not in image.codes or image.parts[p][3] not in image.quantised for p, dc, ac in image.order):
                raise ValueError("a table is missing")
            break
    scan = np.frombuffer(data, np.uint8, offset=at)
    marks = np.flatnonzero(scan[:-1] == 0xFF)
    after = scan[marks + 1]
    ends = marks[(after != 0) & ~((after >= 0xD0) & (after <= 0xD7))]
    if not len(ends):
        raise ValueError("no end")
    marks, after = marks[marks < ends[0]], after[marks < ends[0]]
    restarts = marks[after != 0]
    kept = np.ones(ends[0], bool)
    kept[marks + 1] = False
    kept[restarts] = False
    image.data = scan[: ends[0]][kept]
    image.starts = np.concatenate([[0], np.cumsum(kept)[restarts]]).astype(np.int64)
    return image


def _lookup(codes: bytes) -> np.ndarray:
    """For every 16 bits: the length of the code they begin with above its symbol's 8 bits; 0 where none begins so."""
    table, code, at = np.zeros(1 << 16, np.int32), 0, 16
    for length in range(1, 17):
        for _ in range(codes[length - 1]):
            table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | codes[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table


class _Bits:
    """Bit positions of many lanes in one buffer."""

    def __init__(self, data: np.ndarray, starts: np.ndarray) -> None:
        padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
        self.windows, self.last = padded[:-2] << 16 | padded[1:-1] << 8 | padded[2:], len(data)
        self.at, self.bad = starts * 8, np.zeros(len(starts), bool)

    def peek(self, at: np.ndarray) -> np.ndarray:
        return self.windows[np.minimum(at >> 3, self.last)] >> (8 - (at & 7)) & 0xFFFF

    def symbol_and_value(self, table: np.ndarray, lanes: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
        at = self.at[lanes]
        found = table[self.peek(at)]
        if not found.all():
            self.bad[lanes] |= found == 0
        at = at + (found >> 8)
        symbol = found & 255
        size = symbol & 15
        value = self.peek(at) >> (16 - size)
        self.at[lanes] = at + size
        return symbol, np.where(value < (1 << size >> 1), value - (1 << size) + 1, value)


def decode_together(images: list[Image]) -> list[list[np.ndarray] | None]:
    """For images of one kind: each part's coefficients (blocks down, blocks across, 64) in the scan's order; None where the scan is broken."""
    first, total, lanes_of, at = images[0], [], [], 0
    starts, counts = [], []
    for image in images:
        n = int(np.prod(image.units()))
        step = image.interval or n
        own = -(-n // step)
        total.append(n)
        if len(image.starts) != own:
            lanes_of.append(None)
            continue
        lanes_of.append((len(counts), own))
        starts.append(image.starts + at)
        counts += [step] * (own - 1) + [n - step * (own - 1)]
        at += len(image.data)
    good = [im for im, own in zip(images, lanes_of, strict=True) if own]
    if not good:
        return [None] * len(images)
    bits = _Bits(np.concatenate([im.data for im in good]), np.concatenate(starts))
    counts = np.array(counts)
    tables = {k: _lookup(v) for k, v in first.codes.items()}
    before = np.concatenate([[0], np.cumsum(counts)])[:-1]
    blocks = [np.zeros((int(counts.sum()), h * v, 64), np.int32) for _, h, v, _ in first.parts]
    previous = np.zeros((len(first.parts), len(counts)), np.int64)
    for unit in range(int(counts.max())):
        active = np.flatnonzero((counts > unit) & ~bits.bad)
        for part, dc, ac in first.order:
            for b in range(blocks[part].shape[1]):
                _, value = bits.symbol_and_value(tables[dc], active)
                previous[part, active] += value
                rows = before[active] + unit
                blocks[part][rows, b, 0] = previous[part, active]
                lanes, k = active, np.ones(len(active), np.int64)
                while len(lanes):
                    symbol, value = bits.symbol_and_value(tables[ac | 16], lanes)
                    k = k + (symbol >> 4)
                    if not symbol.all():
                        k = np.where(symbol == 0, 64, k)  # the block ends
                    inside = k < 64
                    if inside.all():
                        blocks[part][rows, b, k] = value
                    else:
                        blocks[part][rows[inside], b, k[inside]] = value[inside]
                    k = k + 1
                    going = (k < 64) & ~bits.bad[lanes]
                    if not going.all():
                        lanes, rows, k = lanes[going], rows[going], k[going]
    out: list[list[np.ndarray] | None] = []
    for image, own in zip(images, lanes_of, strict=True):
        if own is None or bits.bad[own[0] : own[0] + own[1]].any():
            out.append(None)
            continue
        (across, down), at = image.units(), int(before[own[0]])
        out.append([x[at : at + across * down].reshape(down, across, v, h, 64).transpose(0, 2, 1, 3, 4).reshape(down * v, across * h, 64) for x, (_, h, v, _) in zip(blocks, image.parts, strict=True)])
    return out


def thumbnail(image: Image, luminance: np.ndarray) -> np.ndarray:
    """One 8-bit pixel a luminance block: the block's mean, from its DC coefficient."""
    h, v = max(p[1] for p in image.parts), max(p[2] for p in image.parts)
    _, own_h, own_v, q = image.parts[0]
    across, down = -(-(-(-image.width * own_h // h)) // 8), -(-(-(-image.height * own_v // v)) // 8)
    return np.clip(np.rint(luminance[:down, :across, 0] * image.quantised[q][0] / 8 + 128), 0, 255).astype(np.uint8)


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits: whether a pixel is darker than its right neighbour, on 8 rows of 9 pixels."""
    small = pixels[np.arange(8) * pixels.shape[0] // 8][:, np.arange(9) * pixels.shape[1] // 9]
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def features(media: list[bytes | None]) -> list[dict | None]:
    """width, height, thumbnail, thumbnail_hash and payload (null if the file holds none) of each file."""
    out: list[dict | None] = [None] * len(media)
    waiting: dict[tuple, list[tuple[int, Image]]] = {}
    size: dict[tuple, int] = {}

    def flush(kind: tuple) -> None:
        own = waiting.pop(kind)
        for (i, image), parts in zip(own, decode_together([im for _, im in own]), strict=True):
            if parts is None:
                continue
            small = thumbnail(image, parts[image.order[0][0]])
            payload, length = None, image.note.removeprefix(NOTE)
            if image.note.startswith(NOTE) and length.isdigit():
                values = parts[0].reshape(-1)[: int(length)]
                payload = np.where(values < 0, values + 255, values).astype(np.uint8).tobytes()
            out[i] = {"width": image.width, "height": image.height, "thumbnail": small.tobytes(), "thumbnail_hash": f"{difference_hash(small)}-{hashlib.sha256(small.tobytes()).hexdigest()[:16]}", "payload": payload}

    for i, data in enumerate(media):
        try:
            image = parse_jpeg(data or b"")
        except (ValueError, IndexError, struct.error):
            continue
        kind = image.kind()
        waiting.setdefault(kind, []).append((i, image))
        size[kind] = size.get(kind, 0) + len(data)
        if size[kind] >= TOGETHER:
            flush(kind)
            size[kind] = 0
    for kind in list(waiting):
        flush(kind)
    return out


def store_media(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (binary): each text as a JPEG file."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py().encode() for t in batch.column("text")]
            media = [write_jpeg(t.ljust(max(1, -(-len(t) // UNIT)) * UNIT, b"\0")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return map_batches(df.select("doc_id", whole_text().alias("text")), run, "doc_id long, n_bytes long, media binary")


def read_media(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media, with what the stored files hold: width, height, thumbnail, thumbnail_hash, payload."""
    fields = {"width": pa.int32(), "height": pa.int32(), "thumbnail": pa.binary(), "thumbnail_hash": pa.string(), "payload": pa.binary()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = features(batch.column("media").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([x and x[k] for x in found], kind) for k, kind in fields.items())], [*batch.schema.names, *fields])

    return map_batches(df.select("doc_id", "n_bytes", "media"), run, "doc_id long, n_bytes long, media binary, width int, height int, thumbnail binary, thumbnail_hash string, payload binary")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_media(store_media(documents(spark, sf_dir)))
    return read.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -UNIT, UNIT)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(" ", F.concat_ws("x", "width", "height"), "thumbnail_hash").alias("feature"),
    )

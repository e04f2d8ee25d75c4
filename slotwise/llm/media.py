"""Media columns: baseline JPEG, its DC-only luminance thumbnails, and payloads kept in them."""

from __future__ import annotations

import functools
import re
import struct
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

#: A payload is a multiple of this; an image is so many 8 x 8 blocks wide.
UNIT = 192
#: Rows of blocks of one image; a longer payload goes on in a further image.
MOST_ROWS = 8191
#: Quantisation step of the DC coefficient: one sample value of a flat block is one step.
_STEP = 8

# The standard luminance tables, as (codes of each length 1..16, symbols).
_DC = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), bytes(range(12))
_AC = (0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125), bytes.fromhex(
    "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82 09 0a 16 17 18 19 1a "
    "25 26 27 28 29 2a 34 35 36 37 38 39 3a 43 44 45 46 47 48 49 4a 53 54 55 56 57 58 59 5a 63 64 65 66 67 68 69 6a 73 74 75 76 77 78 79 7a "
    "83 84 85 86 87 88 89 8a 92 93 94 95 96 97 98 99 9a a2 a3 a4 a5 a6 a7 a8 a9 aa b2 b3 b4 b5 b6 b7 b8 b9 ba c2 c3 c4 c5 c6 c7 c8 c9 ca "
    "d2 d3 d4 d5 d6 d7 d8 d9 da e1 e2 e3 e4 e5 e6 e7 e8 e9 ea f1 f2 f3 f4 f5 f6 f7 f8 f9 fa"
)
#: Bits of the longest flat block, rounded up to bytes; rows of blocks coded at a time.
_WIDE, _ROWS = 24, 1024


def padded(data: bytes) -> bytes:
    """``data`` with spaces up to a positive multiple of UNIT."""
    return data + b" " * (-len(data) % UNIT if data else UNIT)


def codes(counts: tuple[int, ...], symbols: bytes) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol, of a canonical Huffman table."""
    found, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            found[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return found


@functools.cache
def _words() -> tuple[np.ndarray, np.ndarray]:
    """By DC difference + 255: the bits of a flat block (code, difference, end of block) at the
    top of a 32-bit word, and their number."""
    by_size = {s: (n, c) for (n, c), s in codes(*_DC).items()}
    end, last = next(k for k, s in codes(*_AC).items() if s == 0)
    words, sizes = np.zeros(511, ">u4"), np.zeros(511, np.int64)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        n, c = by_size[s]
        sizes[d + 255] = n + s + end
        words[d + 255] = ((c << s | (d if d >= 0 else d + (1 << s) - 1)) << end | last) << 32 - n - s - end
    return words, sizes


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _scan(part: np.ndarray) -> bytes:
    """The entropy-coded rows of ``part`` (rows of UNIT samples), with a restart after each."""
    words, sizes = _words()
    out: list[bytes] = []
    for at in range(0, len(part), _ROWS):
        place = np.diff(part[at : at + _ROWS], axis=1, prepend=np.int16(0)) + 255
        size = sizes[place]
        pad = -size.sum(axis=1) % 8
        bits = np.ones((len(place), UNIT + 1, _WIDE), np.uint8)  # ones fill a row's last byte
        bits[:, :UNIT] = np.unpackbits(words[place].view(np.uint8).reshape(-1, 4)[:, :3], axis=1).reshape(-1, UNIT, _WIDE)
        size = np.concatenate([size, pad[:, None]], axis=1)
        data = np.packbits(bits[np.arange(_WIDE) < size[:, :, None]]).tobytes()
        ends = np.cumsum(size.sum(axis=1) // 8).tolist()
        out += [data[lo:hi].replace(b"\xff", b"\xff\x00") for lo, hi in zip([0, *ends], ends)]
    return b"".join(x for k, row in enumerate(out) for x in ((b"\xff%c" % (0xD0 + (k - 1) % 8), row) if k else (row,)))


def encode(payload: bytes) -> bytes:
    """Grey baseline JPEG images, end to end, in which each byte of ``payload`` is the value of
    one flat block: byte - 128 is the block's quantised DC coefficient. Each row of blocks is a
    restart interval."""
    out = []
    most = MOST_ROWS * UNIT
    for at in range(0, len(payload), most):
        part = np.frombuffer(payload, np.uint8, min(most, len(payload) - at), at).astype(np.int16).reshape(-1, UNIT) - 128
        tables = b"".join(bytes([kind << 4, *counts]) + symbols for kind, (counts, symbols) in enumerate((_DC, _AC)))
        out += [
            b"\xff\xd8",
            _segment(0xDB, b"\0" + bytes([_STEP] * 64)),
            _segment(0xC0, struct.pack(">BHHB", 8, len(part) * 8, UNIT * 8, 1) + b"\x01\x11\x00"),
            _segment(0xC4, tables),
            _segment(0xDD, struct.pack(">H", UNIT)),
            _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
            _scan(part),
            b"\xff\xd9",
        ]
    return b"".join(out)


class Image:
    """One decoded image: its size, and a sample for each 8 x 8 luminance block."""

    def __init__(self, width: int, height: int, thumbnail: np.ndarray):
        self.width, self.height, self.thumbnail = width, height, thumbnail


def decode(data: bytes) -> list[Image]:
    """The images of a stream of baseline JPEGs, decoded as far as the DC luminance. Raises
    ValueError for another kind of JPEG."""
    (found,) = decode_all([data])
    if isinstance(found, ValueError):
        raise found
    return found


def decode_all(streams: list[bytes]) -> list[list[Image] | ValueError]:
    """Of each stream its images, or what is wrong with it.

    Markers are parsed; then the scans of all images are Huffman-decoded together, with any
    tables, sampling factors and restart intervals (see ``_coefficients``).
    """
    found: list = []
    frames: list[_Frame] = []
    for data in streams:
        own, at = [], 0
        try:
            while at < len(data):
                if data[at : at + 2] != b"\xff\xd8":
                    raise ValueError(f"no image starts at {at}")
                frame, at = _image(data, at + 2)
                own.append(frame)
        except (IndexError, KeyError, struct.error) as e:
            own = ValueError(f"a segment is cut short or missing: {e}")
        except ValueError as e:
            own = e
        found.append(own)
        frames += own if isinstance(own, list) else []
    alike = defaultdict(list)
    for frame in frames:
        alike[frame.tables, frame.pattern].append(frame)
    for (tables, pattern), group in alike.items():
        _coefficients(tables, pattern, group)
    for i, own in enumerate(found):
        if isinstance(own, list):
            bad = next((f.error for f in own if f.error), None)
            found[i] = ValueError(bad) if bad else [f.image() for f in own]
    return found


class _Frame:
    """A parsed image: its geometry, tables and scan; later its DC coefficients or an error."""

    def __init__(self, width: int, height: int, components: list, tables: tuple, step: int, restart: int, scan: bytes):
        self.width, self.height, self.tables, self.step = width, height, tables, step
        one = len(components) == 1
        self.h, self.v = (1, 1) if one else (max(c[1] for c in components), max(c[2] for c in components))
        self.own_h, self.own_v = (1, 1) if one else components[0][1:3]
        self.across, self.down = -(-width // (8 * self.h)), -(-height // (8 * self.v))
        self.pattern = (0,) if one else tuple(i for i, c in enumerate(components) for _ in range(c[1] * c[2]))
        self.dc, self.error = None, None
        units = self.across * self.down
        parts = re.split(rb"\xff[\xd0-\xd7]", scan) if restart else [scan]
        self.parts = [p.replace(b"\xff\x00", b"\xff") for p in parts]
        each = restart or units
        self.units = [min(each, units - k * each) for k in range(-(-units // each))]
        if len(self.parts) != len(self.units):
            raise ValueError("the scan has another number of restart intervals")

    def image(self) -> Image:
        blocks = self.dc.reshape(self.down, self.across, self.own_v, self.own_h).transpose(0, 2, 1, 3)
        wide, high = -(-self.width * self.own_h // (8 * self.h)), -(-self.height * self.own_v // (8 * self.v))
        flat = blocks.reshape(self.down * self.own_v, self.across * self.own_h)[:high, :wide]
        return Image(self.width, self.height, np.clip(np.rint(flat * self.step / 8) + 128, 0, 255).astype(np.uint8))


def _image(data: bytes, at: int) -> tuple[_Frame, int]:
    quant: dict[int, int] = {}
    huffman: dict[tuple[int, int], tuple[tuple[int, ...], bytes]] = {}
    frame, restart = None, 0
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError(f"no marker at {at}")
        marker = data[at + 1]
        size = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = struct.unpack_from(">H" if wide else ">B", body, 1)[0]
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                counts = tuple(body[1:17])
                huffman[body[0] >> 4, body[0] & 15] = counts, bytes(body[17 : 17 + sum(counts)])
                body = body[17 + sum(counts) :]
        elif marker == 0xC0:
            depth, height, width, n = struct.unpack_from(">BHHB", body)
            if depth != 8 or not width or not height:
                raise ValueError("not 8-bit baseline")
            frame = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            if frame is None or body[0] != len(frame):
                raise ValueError("not one baseline scan of all components")
            chosen = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
            end = at
            while True:  # the scan ends at the first marker that isn't a restart
                end = data.find(b"\xff", end)
                if end < 0 or end + 1 >= len(data):
                    raise ValueError("the scan doesn't end")
                if data[end + 1] != 0 and not 0xD0 <= data[end + 1] <= 0xD7:
                    break
                end += 2
            tables = tuple((huffman[0, chosen[c][0]], huffman[1, chosen[c][1]]) for c, *_ in frame)
            if data[end + 1] != 0xD9:
                raise ValueError("more than one scan")
            return _Frame(width, height, frame, tables, quant[frame[0][3]], restart, data[at:end]), end + 2
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a baseline frame")


@functools.lru_cache(maxsize=64)
def _lookup(counts: tuple[int, ...], symbols: bytes) -> np.ndarray:
    """By the next 16 bits: the code's length * 256 + its symbol; 0 where there is no code."""
    out = np.zeros(1 << 16, np.int64)
    for (n, code), symbol in codes(counts, symbols).items():
        if code >> n:
            raise ValueError("a Huffman table has too many codes")
        out[code << 16 - n : (code + 1) << 16 - n] = n << 8 | symbol
    return out


def _coefficients(tables: tuple, pattern: tuple[int, ...], frames: list[_Frame]) -> None:
    """Gives each of ``frames``, which have the same tables and the same ``pattern`` of
    components in a unit, the quantised DC coefficients of its first component.

    Restart intervals are independent, so the intervals of all images are decoded side by
    side, one Huffman symbol of each at a time: the next 16 bits select it from a table.
    AC coefficients are read past.
    """
    try:
        lookups = [(_lookup(*dc), _lookup(*ac)) for dc, ac in tables]
    except (ValueError, IndexError) as e:
        for f in frames:
            f.error = str(e) or "a Huffman table is cut short"
        return
    parts = [p for f in frames for p in f.parts]
    blocks = np.array([n * len(pattern) for f in frames for n in f.units], np.int64)
    first = blocks // len(pattern) * pattern.count(0)
    sizes = np.array([len(p) for p in parts], np.int64)
    raw = np.frombuffer(b"".join(parts) + b"\xff" * 512, np.uint8).astype(np.int64)
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]  # 32 bits from each byte on
    order = np.argsort(-blocks, kind="stable")  # so that those not yet at their end lead
    left, end = -blocks[order], np.cumsum(sizes)[order] * 8
    at, to = end - sizes[order] * 8, (np.cumsum(first) - first)[order]
    out, bad = np.zeros(int(first.sum()), np.int64), np.zeros(len(parts), bool)
    last = np.zeros((len(tables), len(parts)), np.int64)
    place = 0
    bits = lambda p, n: window[p >> 3] >> 32 - n - (p & 7) & (1 << n) - 1
    for u in range(int(-left[0]) if len(left) else 0):
        n = int(np.searchsorted(left, -u))  # intervals of more than u blocks
        component = pattern[u % len(pattern)]
        dc, ac = lookups[component]
        p = at[:n]
        entry = dc[bits(p, 16)]
        size = np.minimum(entry & 255, 15)
        wrong = (entry == 0) | (size > 11)
        p = p + (entry >> 8)
        value = bits(p, size)
        last[component, :n] += np.where(value < 1 << size >> 1, value - (1 << size) + 1, value)
        if component == 0:
            out[to[:n] + place] = last[0, :n]
            place += 1
        p += size
        entry = ac[bits(p, 16)]
        p += entry >> 8
        wrong |= entry == 0
        more, k = np.flatnonzero(entry & 255), np.ones(n, np.int64)
        entry = entry[more]
        while len(more):
            size, run = entry & 15, entry >> 4 & 15
            wrong[more] |= (size == 0) & (run != 15)
            p[more] += size
            k[more] += run + 1
            wrong[more] |= k[more] > 64
            more = more[(k[more] < 64) & ~wrong[more]]
            entry = ac[bits(p[more], 16)]
            p[more] += entry >> 8
            wrong[more] |= entry == 0
            going = (entry & 255) > 0
            more, entry = more[going], entry[going]
        wrong |= p > end[:n]
        bad[:n] |= wrong
        at[:n] = np.minimum(p, end[:n])
    broken = np.zeros(len(parts), bool)
    broken[order] = bad
    lane = done = 0
    for f in frames:
        if broken[lane : lane + len(f.parts)].any():
            f.error = "the scan is cut short or has a code that is in no table"
        lane += len(f.parts)
        f.dc = out[done : done + f.across * f.down * f.own_h * f.own_v]
        done += len(f.dc)


def thumbnail_hash(thumbnail: np.ndarray) -> str:
    """16 hex digits: of 8 x 8 cells, which are lighter than the mean of all."""
    edges = [np.arange(8) * n // 8 for n in thumbnail.shape]
    sums = np.add.reduceat(np.add.reduceat(thumbnail, edges[0], axis=0, dtype=np.int64), edges[1], axis=1)
    sizes = [np.maximum(np.diff(e, append=n), 1) for e, n in zip(edges, thumbnail.shape)]
    cells = sums / np.outer(*sizes)
    return np.packbits(cells > cells.mean()).tobytes().hex()


def feature(images: list[Image]) -> str:
    """Dimensions and thumbnail hash of each image."""
    return ";".join(f"{x.width}x{x.height}:{thumbnail_hash(x.thumbnail)}" for x in images)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded with spaces, as JPEG images."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for part in _small(x, "t"):
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in part["t"].to_pylist()]
                media = pa.array([encode(padded(t)) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(list(map(len, texts)), pa.int64()), media], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    return arrow_map(rows, run, "doc_id long, n_bytes long, media binary")


def read_media(stored: DataFrame, media_col: str = "media") -> DataFrame:
    """``stored`` with payload (the thumbnails' samples, one byte a block), feature and error,
    all from the stored bytes alone. Null media gives nulls; other bytes than baseline JPEGs
    give nulls and, in error, what is wrong with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for part in _small(x, media_col, 4 << 20):
                column = part[media_col].to_pylist()
                decoded = iter(decode_all([m for m in column if m is not None]))
                images = [None if m is None else next(decoded) for m in column]
                right = [i if isinstance(i, list) else None for i in images]
                payload = pa.array([None if i is None else b"".join(y.thumbnail.tobytes() for y in i) for i in right], pa.binary())
                features = pa.array([None if i is None else feature(i) for i in right], pa.string())
                errors = pa.array([str(i) if isinstance(i, ValueError) else None for i in images], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, payload, features, errors], names=[*part.schema.names, "payload", "feature", "error"])

    schema = ", ".join(f"`{c}` {kind}" for c, kind in stored.dtypes)
    return arrow_map(stored, run, f"{schema}, payload binary, feature string, error string")


def _small(batch: pa.RecordBatch, column: str, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes of ``column``, a row at least."""
    step = max(1, int(batch.num_rows * most / max(most, batch[column].nbytes)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature.

    The payload is read back from the stored images: their scans are Huffman-decoded, with the
    tables that they carry. Null texts are empty (a payload of UNIT spaces); very long texts go
    on in further images. Equal texts have equal values, and nothing is ranked, so there are
    no ties. Repeated
    rows and null doc_ids come out as they come in; other columns are ignored; an empty table
    gives an empty result.
    """
    return read_media(store_texts(docs, id_col, text_col)).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, octet_length(payload) - 15, 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )

import hashlib
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from slotwise.llm import media


@pytest.mark.parametrize("data", [b"", b"a", b"\xff" * 500, bytes(range(256)) * 7, b"x" * 192, np.random.default_rng(0).bytes(media.UNIT * media.MOST_ROWS + 5)])
def test_round_trip(data):
    payload = media.padded(data)
    assert len(payload) % 192 == 0 and payload and payload.startswith(data) and set(payload[len(data) :]) <= {32}
    images = media.decode(media.encode(payload))
    assert b"".join(x.thumbnail.tobytes() for x in images) == payload
    assert all(x.width == 1536 and x.height <= 65535 for x in images)


def _bit_by_bit(data):
    """The DC values of grey images without AC coefficients, read one bit at a time."""
    found, at = [], 0
    while at < len(data):
        at += 2
        tables, blocks = {}, 0
        while data[at + 1] != 0xDA:
            size = struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            if data[at + 1] == 0xC4:
                while body:
                    n, code, k = list(body[1:17]), 0, 17
                    table = tables[body[0]] = {}
                    for length in range(1, 17):
                        for _ in range(n[length - 1]):
                            table[f"{code:0{length}b}"] = body[k]
                            code, k = code + 1, k + 1
                        code *= 2
                    body = body[k:]
            elif data[at + 1] == 0xC0:
                high, wide = struct.unpack_from(">HH", body, 1)
                blocks = high // 8 * (wide // 8)
            at += 2 + size
        at += 2 + struct.unpack_from(">H", data, at + 2)[0]
        rows, row = [], bytearray()
        while data[at : at + 2] != b"\xff\xd9":
            if data[at] == 0xFF and data[at + 1]:
                rows.append(row)
                row, at = bytearray(), at + 2
            else:
                row.append(data[at])
                at += 2 if data[at] == 0xFF else 1
        at += 2
        for row in [*rows, row]:
            bits, p, last = "".join(f"{x:08b}" for x in row), 0, 0
            for _ in range(blocks // (len(rows) + 1)):
                for kind in (0x00, 0x10):
                    q = p + 1
                    while bits[p:q] not in tables[kind]:
                        q += 1
                    size = tables[kind][bits[p:q]]
                    p = q + size
                    if kind == 0 and size:
                        last += int(bits[q:p], 2) - (0 if bits[q] == "1" else (1 << size) - 1)
                found.append(last + 128)
    return bytes(found)


@pytest.mark.parametrize("data", [b"any bytes \xff\x00\xff at all" * 20, np.random.default_rng(1).bytes(3000), bytes([0, 255]) * 300])
def test_general_decoder_agrees(data):
    stored = media.encode(media.padded(data))
    assert _bit_by_bit(stored) == media.padded(data) == media.decode(stored)[0].thumbnail.tobytes()


def test_malformed_rows_give_nulls(spark):
    good = media.encode(media.padded(b"good"))
    rows = [(1, good), (2, b"GIF89a"), (3, None), (4, good[:-40]), (5, b""), (6, good[:200] + good[230:]), (7, good.replace(b"\xff\xda", b"\xff\xe0")), (8, good[:-60] + bytes(58) + b"\xff\xd9")]
    got = {r["doc_id"]: r for r in media.read_media(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert bytes(got[1]["payload"]) == media.padded(b"good") and got[1]["error"] is None
    assert got[3]["payload"] is None and got[3]["error"] is None
    for i in (2, 4, 6, 7, 8):
        assert got[i]["payload"] is None and got[i]["feature"] is None and got[i]["error"], i


def _colour_jpeg():
    """Three components, 2 x 2 luminance sampling, restarts, and AC coefficients to read past;
    with the luminance DC values that it holds."""
    rng = np.random.default_rng(3)
    dc = (0, 0, 0, 0, 9, *[0] * 11), bytes(range(9))
    ac = (1, 0, 2, 0, *[0] * 12), bytes([0x00, 0x12, 0xF0])
    by = {s: k for k, s in media.codes(*dc).items()}, {s: k for k, s in media.codes(*ac).items()}
    out, want, bits, restart = bytearray(), np.zeros((4, 6), int), "", 2

    def put(n, value):
        nonlocal bits
        bits += f"{value:0{n}b}" if n else ""

    def flush(marker=None):
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        out.extend(int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00") if bits else b"")
        bits = ""
        if marker is not None:
            out.extend(bytes([0xFF, marker]))

    last = [0, 0, 0]
    for mcu in range(6):
        if mcu and mcu % restart == 0:
            flush(0xD0 + (mcu // restart - 1) % 8)
            last = [0, 0, 0]
        y, x = divmod(mcu, 3)
        for c, n in ((0, 4), (1, 1), (2, 1)):
            for k in range(n):
                v = int(rng.integers(-120, 120))
                d, last[c] = v - last[c], v
                s = abs(d).bit_length()
                put(*by[0][s])
                put(s, d if d >= 0 else d + (1 << s) - 1)
                if rng.random() < 0.5:
                    put(*by[1][0xF0])
                    put(*by[1][0x12])
                    put(2, 3)
                put(*by[1][0])
                if c == 0:
                    want[y * 2 + k // 2, x * 2 + k % 2] = v
    flush()
    seg = media._segment
    frame = struct.pack(">BHHB", 8, 32, 48, 3) + b"\x01\x22\x00\x02\x11\x00\x03\x11\x00"
    tables = b"\x00" + bytes(dc[0]) + dc[1] + b"\x10" + bytes(ac[0]) + ac[1]
    head = b"\xff\xd8" + seg(0xFE, b"comment") + seg(0xDB, b"\0" + bytes([8] * 64)) + seg(0xC0, frame) + seg(0xC4, tables) + seg(0xDD, struct.pack(">H", restart))
    return head + seg(0xDA, b"\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00") + bytes(out) + b"\xff\xd9", want + 128


def test_colour_with_restarts():
    data, want = _colour_jpeg()
    (image,) = media.decode(data)
    assert (image.width, image.height) == (48, 32)
    assert (image.thumbnail == want).all()


@pytest.mark.parametrize("data", [b"GIF89a", b"\xff\xd8\xff\xc2\x00\x0b\x08\x00\x08\x00\x08\x01\x01\x11\x00", media.encode(media.padded(b"cut"))[:-40]])
def test_other_bytes_fail(data):
    with pytest.raises(ValueError):
        media.decode(data)


def test_digests(hard, hard_rows, empty):
    got = media.media_digests(hard).collect()
    want = Counter()
    for i, t in hard_rows:
        raw = (t or "").encode()
        p, m = media.padded(raw), media.encode(media.padded(raw))
        want[i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), media.feature(media.decode(m))] += 1
    assert Counter(tuple(r) for r in got) == want
    assert media.media_digests(empty).count() == 0

"""JPEG: exact round trips, and a decoder that reads files of other writers."""

import hashlib
import random
import struct
import zlib

import numpy as np

from graphloom.llm import jpeg


def test_round_trip():
    rng = random.Random(1)
    payloads = [jpeg.pad(b""), jpeg.pad(bytes(range(256))), b"\xff" * 192, *[jpeg.pad(rng.randbytes(rng.randint(1, 9000))) for _ in range(20)]]
    files = [jpeg.encode(p) for p in payloads]
    assert [r["payload"] for r in jpeg.read(files)] == payloads
    assert jpeg.pad(b"") == b" " * 192 and len(jpeg.pad(b"x" * 193)) == 384
    assert all(f[:2] == b"\xff\xd8" and f[-2:] == b"\xff\xd9" for f in files)


class Writer:
    """A plain baseline encoder of given coefficients, bit by bit."""

    def __init__(self, blocks, parts, size, interval=0):
        self.bits, out = "", []
        symbols = list(range(12))
        codes = [r << 4 | s for r in range(16) for s in range(11) if s or r in (0, 15)]
        self.dc = {s: f"{k:04b}" for k, s in enumerate(symbols)}
        self.ac = {s: f"{k:08b}" for k, s in enumerate(codes)}
        before = [0] * len(parts)
        for u, unit in enumerate(blocks):
            if interval and u and u % interval == 0:
                out += [self.flush(), bytes([0xFF, 0xD0 + (u // interval - 1) % 8])]
                before = [0] * len(parts)
            for part, block in unit:
                self.number(self.dc, block[0] - before[part], 0)
                before[part], run = block[0], 0
                for v in block[1:]:
                    if v == 0:
                        run += 1
                        continue
                    while run > 15:
                        self.bits += self.ac[0xF0]
                        run -= 16
                    self.number(self.ac, v, run)
                    run = 0
                if run:
                    self.bits += self.ac[0]
        out.append(self.flush())
        seg = lambda m, b: struct.pack(">BBH", 0xFF, m, len(b) + 2) + b
        h, w = size
        frame = struct.pack(">BHHB", 8, h, w, len(parts)) + b"".join(bytes([i + 1, p, 0]) for i, p in enumerate(parts))
        table = lambda key, kind, n: bytes([key, *[len(kind) if k == n else 0 for k in range(1, 17)], *kind])
        self.file = b"\xff\xd8" + seg(0xDB, b"\x00" + bytes([3] * 64)) + seg(0xC4, table(0, self.dc, 4)) + seg(0xC4, table(0x10, self.ac, 8)) + seg(0xC0, frame)
        self.file += (seg(0xDD, struct.pack(">H", interval)) if interval else b"") + seg(0xDA, bytes([len(parts)]) + b"".join(bytes([i + 1, 0]) for i in range(len(parts))) + bytes([0, 63, 0])) + b"".join(out) + b"\xff\xd9"

    def number(self, table, v, run):
        n = abs(v).bit_length()
        self.bits += table[run << 4 | n] + (f"{v if v > 0 else v + (1 << n) - 1:0{n}b}" if n else "")

    def flush(self):
        self.bits += "1" * (-len(self.bits) % 8)
        data = int("1" + self.bits, 2).to_bytes(len(self.bits) // 8 + 1, "big")[1:] if self.bits else b""
        self.bits = ""
        return data.replace(b"\xff", b"\xff\x00")


def test_files_of_another_writer():
    rng = random.Random(7)
    block = lambda: [rng.randint(-500, 500), *[rng.choice([0, 0, 0, 0, 0, 1, -1, 7, -300, 511]) if rng.random() < 0.5 else 0 for _ in range(62)], rng.choice([0, 3])]
    for parts, interval, size, units in (([0x22, 0x11, 0x11], 0, (40, 33), 9), ([0x22, 0x11, 0x11], 2, (40, 33), 9), ([0x11], 3, (24, 17), 9), ([0x21, 0x11], 0, (16, 16), 2)):
        order = [p for p, s in enumerate(parts) for _ in range((s >> 4) * (s & 15))]
        blocks = [[(p, block()) for p in order] for _ in range(units)]
        data = Writer(blocks, parts, size, interval).file
        header = jpeg.Header(data)
        found = jpeg.decode_segments([header])[0]
        assert (found == np.array([[b for _, b in unit] for unit in blocks])).all()
        assert (header.height, header.width) == size
        small = jpeg.thumbnail(header, found)
        first = np.clip(blocks[0][0][1][0] * 3 / 8 + 128, 0, 255)
        assert small[0, 0] == first and len(jpeg.thumbnail_hash(small)) == 16
    # In two-by-two units the four luminance blocks stand side by side and below each other.
    unit = [[(0, [8 * k] + [0] * 63) for k in range(4)] + [(1, [0] * 64), (2, [0] * 64)]]
    h = jpeg.Header(Writer(unit, [0x22, 0x11, 0x11], (16, 16)).file)
    assert jpeg.thumbnail(h, jpeg.decode_segments([h])[0]).tolist() == [[128, 131], [134, 137]]


def test_media_columns(spark, odd, nothing):
    rows = jpeg.media_columns(odd).collect()
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    assert len(rows) == odd.count() and jpeg.media_columns(nothing).count() == 0
    for r in rows:
        if r["doc_id"] is not None:
            raw = (texts[r["doc_id"]] or "").encode()
            payload = jpeg.pad(raw)
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
            assert r["tail_crc32"] == zlib.crc32(payload[-16:]) and r["media_sha256"] == hashlib.sha256(jpeg.encode(payload)).hexdigest()
    assert len({(r["media_sha256"], r["feature"]) for r in rows if r["doc_id"] in (6, 77)}) == 1
    lost = jpeg.read_media(spark.createDataFrame([(1, 5, None)], "doc_id long, n_bytes long, media binary")).first()
    assert lost["doc_id"] == 1 and lost["payload_sha256"] is None and lost["feature"] is None


def test_large_files_are_decoded_in_runs(monkeypatch):
    """The same payload, dimensions and hash whatever is decoded at once, also for files among others."""
    rng = np.random.default_rng(5)
    payloads = [bytes(rng.integers(32, 127, n, dtype=np.uint8)) for n in (10, 400_000, 5_000, 90_000)]
    media = [jpeg.encode(jpeg.pad(p)) for p in payloads]
    whole = jpeg.read(media)
    assert [r["payload"].rstrip(b" ") for r in whole] == [p.rstrip(b" ") for p in payloads]
    for run in (1, 3_000, 100_000):
        monkeypatch.setattr(jpeg, "RUN", run)
        assert jpeg.read(media) == whole
        assert len(jpeg.in_runs(jpeg.Header(media[1]))) > 1

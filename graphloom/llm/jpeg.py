"""Media columns: texts as baseline JPEG files, and a decoder for such files (operator 8).

A payload is a sequence of bytes whose length is a multiple of 192. Each minimum coded unit (one 8x8 block of Y, Cb and Cr)
holds 192 of them as quantised coefficients, byte v as 256 + v, in zigzag order. Every such coefficient has magnitude
category 9, so a Huffman table with one code of one bit serves, and a restart marker after every unit resets
the predictors. Coefficients are stored, not pixels, so nothing is lost; any baseline decoder reads the file.
"""

from __future__ import annotations

import functools
import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import small_batches

UNIT = 192
LIFT, CATEGORY = 256, 9
MARK = b"payload-bytes:"
#: Bytes of scans that are decoded at once.
RUN = 4 << 20


def pad(text: bytes) -> bytes:
    """With spaces up to a positive multiple of 192."""
    return text + b" " * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _coded(payload: bytes, first: int, last: bool) -> bytes:
    """The scan of units from number ``first`` on, each a restart segment; the last of all has no marker behind it."""
    v = np.frombuffer(payload, np.uint8).reshape(-1, 4)
    # Four coefficients are 40 bits: each the code 0, then 1 and the byte (256 + v in nine bits).
    bits = np.empty((len(v), 5), np.uint8)
    bits[:, 0] = 0x40 | v[:, 0] >> 2
    bits[:, 1] = (v[:, 0] & 3) << 6 | 0x10 | v[:, 1] >> 4
    bits[:, 2] = (v[:, 1] & 15) << 4 | 0x04 | v[:, 2] >> 6
    bits[:, 3] = (v[:, 2] & 63) << 2 | 0x01
    bits[:, 4] = v[:, 3]
    coded = bits.reshape(len(payload) // UNIT, -1)
    marks = np.empty((len(coded), 2), np.uint8)
    marks[:, 0], marks[:, 1] = 0xFF, 0xD0 + np.arange(first, first + len(coded)) % 8
    scan = np.concatenate([coded, marks], axis=1).ravel()
    scan = scan[:-2] if last else scan
    stuffed = np.flatnonzero(scan == 0xFF)
    width = coded.shape[1] + 2
    stuffed = stuffed[stuffed % width != width - 2]  # data, not the markers
    return (np.insert(scan, stuffed + 1, 0) if len(stuffed) else scan).tobytes()


def encode(payload: bytes) -> bytes:
    units = len(payload) // UNIT
    across = math.isqrt(units - 1) + 1
    down = -(-units // across)
    if max(across, down) * 8 > 65535:
        raise ValueError("the payload needs more than 65535 pixels a side")
    # Made in runs, so that only payload and file are held whole.
    scan, step = [], RUN // UNIT
    for first in range(0, across * down, step):
        last = min(first + step, across * down)
        scan.append(_coded(payload[first * UNIT : last * UNIT].ljust((last - first) * UNIT), first, last == across * down))
    table = bytes([1, *[0] * 15, CATEGORY])
    return b"".join(
        [
            b"\xff\xd8",
            _segment(0xFE, MARK + str(len(payload)).encode()),
            _segment(0xDB, b"\x00" + b"\x01" * 64),
            _segment(0xC0, struct.pack(">BHHB", 8, down * 8, across * 8, 3) + bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0])),
            _segment(0xC4, b"\x00" + table + b"\x10" + table),
            _segment(0xDD, b"\x00\x01"),
            _segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])),
            *scan,
            b"\xff\xd9",
        ]
    )


class Header:
    """What the markers of a baseline file say, and its entropy-coded segments without stuffing."""

    def __init__(self, data: bytes):
        self.quant: dict[int, list[int]] = {}
        self.huffman: dict[int, bytes] = {}
        self.interval, self.comment = 0, b""
        if data[:2] != b"\xff\xd8":
            raise ValueError("no JPEG file")
        at = 2
        while True:
            if data[at] != 0xFF:
                raise ValueError("a marker was expected")
            kind = data[at + 1]
            if kind == 0xFF:
                at += 1
                continue
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if kind == 0xDB:
                while body:
                    wide = body[0] >> 4
                    values = struct.unpack(">64H", body[1:129]) if wide else tuple(body[1:65])
                    self.quant[body[0] & 15] = list(values)
                    body = body[129 if wide else 65 :]
            elif kind == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    self.huffman[body[0]] = bytes(body[1:n])
                    body = body[n:]
            elif kind == 0xC0:
                self.height, self.width = struct.unpack(">HH", body[1:5])
                # identifier, horizontal and vertical sampling, quantisation table
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            elif kind in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
                raise ValueError("only baseline files are read")
            elif kind == 0xDD:
                self.interval = int.from_bytes(body[:2], "big")
            elif kind == 0xFE:
                self.comment = bytes(body)
            elif kind == 0xDA:
                tables = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
                break
        self.tables = [(tables[p[0]] >> 4, 0x10 | tables[p[0]] & 15) for p in self.parts]
        if len(self.parts) == 1:
            self.parts = [(self.parts[0][0], 1, 1, self.parts[0][3])]
        wide, high = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        self.across, self.down = -(-self.width // (8 * wide)), -(-self.height // (8 * high))
        #: Component of each block of a unit.
        self.blocks = [i for i, p in enumerate(self.parts) for _ in range(p[1] * p[2])]
        scan = np.frombuffer(data, np.uint8)[at:]
        # Markers are FF with anything but 00 behind it; restart markers cut the scan, another one ends it.
        flags = np.flatnonzero((scan[:-1] == 0xFF) & (scan[1:] != 0))
        ends = flags[(scan[flags + 1] & 0xF8) != 0xD0]
        stop = int(ends[0]) if len(ends) else len(scan)
        cuts = flags[flags < stop]
        stuffed = np.flatnonzero((scan[: stop - 1] == 0xFF) & (scan[1:stop] == 0)) + 1
        gone = np.unique(np.concatenate([cuts, np.minimum(cuts + 1, stop - 1), stuffed])) if stop else np.zeros(0, np.int64)
        keep = np.ones(stop, bool)
        keep[gone] = False
        self.scan = scan[:stop][keep]
        #: Where each segment's bytes begin, and how many units it has.
        self.starts = np.concatenate([[0], cuts - np.searchsorted(gone, cuts)]).astype(np.int64)
        units = self.across * self.down
        each = self.interval or units
        self.units = np.minimum(each, units - each * np.arange(-(-units // each)))
        if len(self.units) != len(self.starts):
            raise ValueError("restart markers don't match the size")

    def layout(self) -> tuple:
        return (tuple(self.blocks), tuple(self.tables), tuple(sorted(self.huffman.items())), int(self.units.max()))


@functools.lru_cache(maxsize=16)
def lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Length and symbol of the code at the head of any 16 bits; length 0: no code."""
    length, symbol = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    code, k = 0, 16
    for size in range(1, 17):
        for _ in range(table[size - 1]):
            at, n = code << (16 - size), 1 << (16 - size)
            length[at : at + n], symbol[at : at + n] = size, table[k]
            code, k = code + 1, k + 1
        code <<= 1
    return length, symbol


class _Bits:
    """Bit streams that are read in lockstep, one position each, from one buffer."""

    def __init__(self, buffer: np.ndarray, starts: np.ndarray):
        b = np.concatenate([buffer, np.zeros(8, np.uint8)]).astype(np.uint64)
        n = len(b) - 7
        self.window = np.zeros(n, np.uint64)
        for i in range(8):
            self.window |= b[i : i + n] << np.uint64(56 - 8 * i)
        self.at = starts * 8

    def peek(self, who: np.ndarray | slice) -> np.ndarray:
        at = self.at[who]
        return self.window[np.minimum(at >> 3, len(self.window) - 1)] << (at & 7).astype(np.uint64)


def _value(head: np.ndarray, used: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The signed number in ``size`` bits behind the first ``used`` ones."""
    raw = ((head << used.astype(np.uint64)) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
    return np.where((size > 0) & (raw < (1 << np.maximum(size - 1, 0))), raw - (1 << size) + 1, raw)


def decode_segments(headers: list[Header]) -> list[np.ndarray]:
    """For each file of one layout its quantised coefficients: units x blocks x 64 in zigzag order.

    The restart segments of all files are decoded in lockstep: step by step each of them reads one symbol.
    """
    first = headers[0]
    tables = {k: lookup(t) for k, t in first.huffman.items()}
    sizes = [len(h.scan) for h in headers]
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    starts = np.concatenate([h.starts + o for h, o in zip(headers, offsets, strict=True)])
    units = np.concatenate([h.units for h in headers])
    bits = _Bits(np.concatenate([h.scan for h in headers]), starts)
    n, most, blocks = len(starts), int(units.max()), first.blocks
    out = np.zeros((n, most, len(blocks), 64), np.int16)
    before = np.zeros((n, len(first.parts)), np.int64)
    for unit in range(most):
        live = np.flatnonzero(units > unit)
        for j, part in enumerate(blocks):
            dc, ac = first.tables[part]
            length, symbol = tables[dc]
            head = bits.peek(live)
            code = (head >> np.uint64(48)).astype(np.int64)
            used, size = length[code], symbol[code]
            if (used == 0).any():
                raise ValueError("no such Huffman code")
            bits.at[live] += used + size
            before[live, part] += _value(head, used, size)
            out[live, unit, j, 0] = before[live, part]
            length, symbol = tables[ac]
            open_, place = live, np.ones(len(live), np.int64)
            while len(open_):
                head = bits.peek(open_)
                code = (head >> np.uint64(48)).astype(np.int64)
                used, coded = length[code], symbol[code]
                if (used == 0).any():
                    raise ValueError("no such Huffman code")
                run, size = coded >> 4, coded & 15
                bits.at[open_] += used + size
                place = place + run
                value = _value(head, used, size)
                if size.all():
                    if (place > 63).any():
                        raise ValueError("a run leaves its block")
                    out[open_, unit, j, place] = value
                    place = place + 1
                else:
                    some = size > 0
                    if (place[some] > 63).any():
                        raise ValueError("a run leaves its block")
                    out[open_[some], unit, j, place[some]] = value[some]
                    place = np.where(some | (run == 15), place + 1, 64)
                left = place < 64
                if not left.all():
                    open_, place = open_[left], place[left]
    found, at = [], 0
    for h in headers:
        own = out[at : at + len(h.units)]
        found.append(np.concatenate([own[i, :u] for i, u in enumerate(h.units)]) if most > 1 else own[:, 0])
        at += len(h.units)
    return found


def in_runs(header: Header) -> list[Header]:
    """The file as parts of consecutive restart segments, each of :data:`RUN` bytes of scan or one segment, so that a large file is never decoded at once."""
    if len(header.scan) <= RUN:
        return [header]
    ends = np.concatenate([header.starts[1:], [len(header.scan)]])
    out, at = [], 0
    while at < len(header.starts):
        low = int(header.starts[at])
        end = max(at + 1, int(np.searchsorted(ends, low + RUN, side="right")))
        part = copy(header)
        part.scan, part.starts, part.units = header.scan[low : int(ends[end - 1])], header.starts[at:end] - low, header.units[at:end]
        out.append(part)
        at = end
    return out


def luminance_dc(header: Header, coefficients: np.ndarray) -> np.ndarray:
    """Units x luminance blocks: their quantised DC coefficients."""
    return coefficients[:, [k for k, p in enumerate(header.blocks) if p == 0], 0].astype(np.int64)


def thumbnail(header: Header, coefficients: np.ndarray) -> np.ndarray:
    """One luminance sample for each 8x8 block, from the DC coefficients alone."""
    return dc_thumbnail(header, luminance_dc(header, coefficients))


def dc_thumbnail(header: Header, dc: np.ndarray) -> np.ndarray:
    _, wide, high, table = header.parts[0]
    grid = (dc * header.quant[table][0]).reshape(header.down, header.across, high, wide).swapaxes(1, 2).reshape(header.down * high, header.across * wide)
    return np.clip(grid / 8 + 128, 0, 255)


def thumbnail_hash(pixels: np.ndarray) -> str:
    """Difference hash: whether each of 8x8 samples is brighter than the one to its left, as 16 hexadecimal digits."""
    rows = (np.arange(8) * 2 + 1) * pixels.shape[0] // 16
    columns = (np.arange(9) * 2 + 1) * pixels.shape[1] // 18
    small = pixels[rows][:, columns]
    return np.packbits((small[:, 1:] > small[:, :-1]).ravel()).tobytes().hex()


def read(media: list[bytes]) -> list[dict]:
    """Payload, dimensions and thumbnail hash of each file; files of one layout are decoded together."""
    headers = [Header(m) for m in media]
    groups: dict[tuple, list[int]] = {}
    for i, h in enumerate(headers):
        groups.setdefault(h.layout(), []).append(i)
    out: list[dict] = [{} for _ in media]
    for members in groups.values():
        parts = [(i, p) for i in members for p in in_runs(headers[i])]
        dc: dict[int, list[np.ndarray]] = {i: [] for i in members}
        payload: dict[int, list[np.ndarray]] = {i: [] for i in members}
        # Bounded work: so many bytes of scans at a time.
        while parts:
            n, total = 0, 0
            while n < len(parts) and (n == 0 or total + len(parts[n][1].scan) <= RUN):
                total += len(parts[n][1].scan)
                n += 1
            some, parts = parts[:n], parts[n:]
            for (i, _), found in zip(some, decode_segments([p for _, p in some]), strict=True):
                dc[i].append(luminance_dc(headers[i], found))
                if headers[i].comment.startswith(MARK):
                    payload[i].append((found.ravel() - LIFT).astype(np.uint8))
        for i in members:
            h = headers[i]
            out[i] = {"width": h.width, "height": h.height, "thumbnail_hash": thumbnail_hash(dc_thumbnail(h, np.concatenate(dc.pop(i)))), "payload": None}
            if h.comment.startswith(MARK):
                out[i]["payload"] = np.concatenate(payload.pop(i))[: int(h.comment[len(MARK) :])].tobytes()
    return out


def write_media(documents: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: each text (null: empty) as a JPEG file."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() or b"" for x in batch.column(0).cast(pa.binary())]
            media = [encode(pad(x)) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([len(x) for x in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    schema = documents.select("doc_id", F.lit(0).cast("long").alias("n_bytes"), F.lit(b"").alias("media")).schema
    return documents.select("text", "doc_id").mapInArrow(run, schema)


def read_media(stored: DataFrame) -> DataFrame:
    """The columns of a table with ``doc_id, n_bytes, media`` that are computed from the stored bytes.

    ``feature`` is width, height and thumbnail hash. A null ``media`` or one without a payload of ours gives nulls for what isn't there.
    """
    small_batches(stored.sparkSession)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = batch.column(2).to_pylist()
            found = iter(read([m for m in media if m is not None]))
            rows = [next(found) if m is not None else {"payload": None} for m in media]
            payload = [r["payload"] for r in rows]
            columns = [
                batch.column(0),
                batch.column(1),
                pa.array([None if p is None else len(p) for p in payload], pa.int64()),
                pa.array([None if p is None else hashlib.sha256(p).hexdigest() for p in payload], pa.string()),
                pa.array([None if p is None else zlib.crc32(p[-16:]) for p in payload], pa.int64()),
                pa.array([None if m is None else len(m) for m in media], pa.int64()),
                pa.array([None if m is None else hashlib.sha256(m).hexdigest() for m in media], pa.string()),
                pa.array([f"{r['width']}x{r['height']}:{r['thumbnail_hash']}" if "width" in r else None for r in rows], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = stored.select("doc_id", "n_bytes").schema.simpleString()[7:-1]
    kinds += ", payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, kinds)


def media_columns(documents: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature`` for every row.

    Each whole text is stored as a JPEG file and the file is read back; everything but ``n_bytes`` comes from the file. Null texts
    count as empty, which is a payload of 192 spaces; equal texts give equal values; a null doc_id stays null. An
    empty table gives an empty result. Texts beyond 12 GB don't fit into the format and raise ValueError.
    """
    return read_media(write_media(documents))

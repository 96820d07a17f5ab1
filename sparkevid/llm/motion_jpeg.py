"""Media columns: AVI motion-JPEG. Bytes to AVI files and back, intra frames, shots and timed clips.

Writing is lossless: a byte is one 8 x 8 block of equal samples, coded by its DC coefficient with quantiser 8, which every
baseline decoder restores exactly. The frames' Huffman tables give a DC category of c bits a code of 9 - c bits,
so that each block takes ten bits; such frames decode without a bit-wise loop. Frames with other tables, or
with AC coefficients, decode block by block (grey baseline JPEG). The payload's length stands in the stream's ``strd`` chunk.

Reading walks the RIFF chunks, takes frames by ``idx1`` (or in ``movi`` order where there is none), and finds
shots: frames' histograms are compared, and a cut is a difference above the recent mean by a multiple of the recent deviation,
or above a fixed threshold where fewer than two differences are known. Cuts themselves are no part of the recent differences.

Null and empty texts are a payload of 64 zero bytes. Equal texts give equal files. Repeated rows are stored each for
itself; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import on_executors, table

#: Blocks in a row of a frame, rows at most, frames a second.
COLUMNS, ROWS, RATE = 64, 64, 25
#: Shots: bins of a histogram, frames that the threshold looks back on, deviations above the mean, least difference.
BINS, RECENT, DEVIATIONS, LEAST = 16, 12, 3.0, 0.1
#: Shots: the threshold while fewer than two differences are known, and the greatest that it may become.
FIRST, MOST = 0.5, 0.9
#: The zigzag order of JPEG.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8 if (k // 8 + k % 8) % 2 else k % 8))))


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """Ten bits of a block by its DC difference + 255, and the difference by the ten bits."""
    code = np.zeros(511, np.uint64)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        prefix = (1 << (9 - c)) - 2  # 8 - c ones and a zero
        code[d + 255] = ((prefix << c) | (d if d >= 0 else d + (1 << c) - 1)) << 1  # and the one-bit end of block
    back = np.zeros(1024, np.int64)
    back[code] = np.arange(-255, 256)
    return code, back


CODE, DIFFERENCE = _codes()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_TABLES = (
    _segment(0xDB, b"\x00" + bytes([8] * 64))
    + _segment(0xC4, b"\x00" + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1)))
    + _segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\x00")
)


def encode_frame(values: np.ndarray) -> bytes:
    """A baseline JPEG of one block for each value; ``values`` (rows, columns), uint8."""
    level = values.ravel().astype(np.int64) - 128
    code = CODE[np.diff(level, prepend=0) + 255].reshape(-1, 4)
    word = code[:, 0] << np.uint64(30) | code[:, 1] << np.uint64(20) | code[:, 2] << np.uint64(10) | code[:, 3]
    data = word.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes().replace(b"\xff", b"\xff\x00")
    rows, columns = values.shape
    frame = _segment(0xC0, struct.pack(">BHHBBBB", 8, rows * 8, columns * 8, 1, 1, 0x11, 0))
    return b"\xff\xd8" + _TABLES + frame + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + data + b"\xff\xd9"


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(payload: bytes) -> bytes:
    """``payload``: a positive multiple of 64 bytes."""
    rows = len(payload) // COLUMNS
    frames = -(-rows // ROWS)
    height = -(-rows // frames)
    values = np.zeros(frames * height * COLUMNS, np.uint8)
    values[: len(payload)] = np.frombuffer(payload, np.uint8)
    images = [encode_frame(x) for x in values.reshape(frames, height, COLUMNS)]
    movi, index, at = [b"movi"], [], 4
    for image in images:
        movi.append(_chunk(b"00dc", image))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(image)))
        at += len(movi[-1])
    largest, w, h = max(map(len, images)), COLUMNS * 8, height * 8
    avih = struct.pack("<14I", 1_000_000 // RATE, largest * RATE, 0, 0x10, frames, 0, 1, largest, w, h, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, RATE, 0, frames, largest, 0xFFFFFFFF, 0, 0, 0, w, h)
    strf = struct.pack("<IiiHH4sIiiII", 40, w, h, 1, 8, b"MJPG", w * h, 0, 0, 0, 0)
    strl = b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf) + _chunk(b"strd", struct.pack("<Q", len(payload)))
    hdrl = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", strl)
    return _chunk(b"RIFF", b"AVI " + _chunk(b"LIST", hdrl) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


@dataclass
class Avi:
    rate: float = RATE
    payload: int | None = None
    movi: int = 0
    frames: list[tuple[int, int]] | None = None  # where each frame's data begins, and its size


def read_avi(data: bytes | memoryview) -> Avi:
    """Chunks of a file: stream settings and where its video frames are. Damaged files raise ValueError."""
    if bytes(data[:4]) != b"RIFF" or bytes(data[8:12]) != b"AVI ":
        raise ValueError("not an AVI file")
    out, found, index = Avi(), [], []

    def walk(at: int, end: int) -> None:
        while at + 8 <= end:
            name, size = bytes(data[at : at + 4]), struct.unpack_from("<I", data, at + 4)[0]
            body = at + 8
            if body + size > len(data):
                raise ValueError("a chunk is cut off")
            if name == b"LIST":
                if bytes(data[body : body + 4]) == b"movi":
                    out.movi = body
                walk(body + 4, body + size)
            elif name == b"strh" and bytes(data[body : body + 4]) == b"vids":
                scale, rate = struct.unpack_from("<II", data, body + 20)
                out.rate = rate / max(scale, 1)
            elif name == b"strd" and size == 8:
                out.payload = struct.unpack_from("<Q", data, body)[0]
            elif name[2:] in (b"dc", b"db"):
                found.append((body, size))
            elif name == b"idx1":
                index.extend(struct.iter_unpack("<4sIII", data[body : body + size // 16 * 16]))
            at = body + size + (size & 1)

    walk(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))
    video = [(at, size) for name, _, at, size in index if name[2:] in (b"dc", b"db")]
    if video:  # offsets count from the word 'movi', or from the file's beginning
        base = out.movi if bytes(data[out.movi + video[0][0] : out.movi + video[0][0] + 4])[2:] in (b"dc", b"db") else 0
        found = [(base + at + 8, size) for at, size in video]
    out.frames = found
    return out


def _huffman(body: bytes) -> tuple[dict[tuple[int, int], int], list[tuple[int, int]]]:
    """(length, code) to symbol, and (symbol, length) in order."""
    out, order, code, at = {}, [], 0, 16
    for length in range(1, 17):
        for _ in range(body[length - 1]):
            out[length, code] = body[at]
            order.append((body[at], length))
            code, at = code + 1, at + 1
        code <<= 1
    return out, order


def decode_frame(data: bytes) -> np.ndarray:
    """Samples of a grey baseline JPEG as (block rows, block columns, 8, 8), or (rows, columns) of values where all blocks are even."""
    at, quant, tables, orders = 2, {}, {}, {}
    height = width = qid = interval = 0
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    while True:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                if body[0] >> 4:
                    raise ValueError("16-bit quantisers are not baseline")
                quant[body[0] & 15] = np.frombuffer(body[1:65], np.uint8).astype(np.int64)
                body = body[65:]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]], orders[body[0]] = _huffman(body[1 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC0:
            _, height, width, parts = struct.unpack_from(">BHHB", body)
            if parts != 1:
                raise ValueError("only grey frames are decoded")
            qid = body[8]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline frame")
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            dc, ac = body[2] >> 4, 0x10 | (body[2] & 15)
            break
    scan = data[at : data.rindex(b"\xff\xd9")]
    rows, columns = -(-height // 8), -(-width // 8)
    n = rows * columns
    fixed = {length + symbol for symbol, length in orders[dc]} == {9} and orders[ac] == [(0, 1)] and not interval and n % 4 == 0
    if fixed and quant[qid][0] == 8:
        packed = np.frombuffer(scan.replace(b"\xff\x00", b"\xff"), np.uint8).reshape(-1, 5)
        word = np.zeros((len(packed), 8), np.uint8)
        word[:, 3:] = packed
        word = word.view(">u8").ravel().astype(np.uint64)
        code = np.stack([word >> np.uint64(s) & np.uint64(1023) for s in (30, 20, 10, 0)], axis=1).ravel()[:n]
        return (np.cumsum(DIFFERENCE[code]) + 128).astype(np.uint8).reshape(rows, columns)
    return _blocks(scan, n, quant[qid], tables[dc], tables[ac], interval).reshape(rows, columns, 8, 8)


def _blocks(scan: bytes, n: int, quant: np.ndarray, dc: dict, ac: dict, interval: int) -> np.ndarray:
    """Any grey baseline scan, bit by bit."""
    parts, part = [], bytearray()
    i = 0
    while i < len(scan):
        if scan[i] == 0xFF and i + 1 < len(scan) and scan[i + 1] != 0:
            if 0xD0 <= scan[i + 1] <= 0xD7:
                parts.append(bytes(part))
                part = bytearray()
            i += 2
            continue
        part.append(scan[i])
        i += 2 if scan[i] == 0xFF else 1
    parts.append(bytes(part))
    k = np.arange(8)
    basis = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    out = np.zeros((n, 8, 8), np.uint8)
    block = 0
    for data in parts:
        bits = "".join(f"{b:08b}" for b in data)
        at = last = 0

        def symbol(table: dict, bits: str = bits) -> int:
            nonlocal at
            code = 0
            for length in range(1, 17):
                code = code << 1 | (bits[at] == "1")
                at += 1
                if (length, code) in table:
                    return table[length, code]
            raise ValueError("no such Huffman code")

        def number(size: int, bits: str = bits) -> int:
            nonlocal at
            v = int(bits[at : at + size] or "0", 2)
            at += size
            return v if not size or v >> (size - 1) else v - (1 << size) + 1

        for _ in range(interval or n):
            if block == n:
                break
            coefficients = np.zeros(64, np.int64)
            last += number(symbol(dc))
            coefficients[0] = last
            i = 1
            while i < 64:
                run = symbol(ac)
                if run == 0:
                    break
                i += run >> 4
                if run & 15:
                    coefficients[i] = number(run & 15)
                i += 1
            square = np.zeros(64)
            square[ZIGZAG] = coefficients * quant
            out[block] = np.clip(np.rint(basis @ square.reshape(8, 8) @ basis.T + 128), 0, 255)
            block += 1
    return out


def payload_of(values: list[np.ndarray], size: int | None) -> bytes:
    """The bytes of even-block frames, in order."""
    data = b"".join((v if v.ndim == 2 else v[:, :, 0, 0]).tobytes() for v in values)
    return data if size is None else data[:size]


def cuts(frames: list[np.ndarray]) -> list[int]:
    """The frames that begin a shot, 0 included."""
    if not frames:
        return []
    hist = [np.bincount(f.ravel() >> 4, minlength=BINS) / f.size for f in frames]
    d = np.array([np.abs(a - b).sum() / 2 for a, b in zip(hist[1:], hist, strict=False)])
    out, recent = [0], []
    for i, x in enumerate(d.tolist(), 1):
        limit = max(LEAST, np.mean(recent) + DEVIATIONS * np.std(recent)) if len(recent) >= 2 else FIRST
        if x > min(limit, MOST):
            out.append(i)
        else:
            recent = [*recent[-(RECENT - 1) :], x]
    return out


def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id and text (binary) to doc_id, n_bytes, media."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            texts = [x.as_py() or b"" for x in part.column("text")]
            media = [write_avi(t + b"\0" * (-len(t) % 64 if t else 64)) for t in texts]
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "media": pa.array(media, pa.binary())})


def opened(media: bytes) -> tuple[Avi, list[np.ndarray]]:
    """A file's settings and frames; ValueError says what is wrong with a damaged one."""
    try:
        avi = read_avi(media)
        return avi, [decode_frame(media[at : at + size]) for at, size in avi.frames]
    except (KeyError, IndexError, struct.error, OverflowError, MemoryError, RecursionError) as error:
        raise ValueError(f"damaged file: {type(error).__name__}") from error


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stored files, read back, to their payload's and their own digests and features."""
    names = [c.split()[0] for c in DIGEST.split(", ")][2:]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            rows = []
            for x in part.column("media"):
                media = x.as_py()
                avi, frames = opened(media)
                data = payload_of(frames, avi.payload)
                starts = cuts(frames)
                feature = f"frames={len(frames)};blocks={frames[0].shape[1]}x{frames[0].shape[0]};clips={len(starts)};starts={','.join(map(str, starts))}"
                rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            if rows:
                cols = {n: pa.array(v, k) for n, v, k in zip(names, zip(*rows, strict=True), kinds, strict=True)}
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_bytes": part.column("n_bytes")} | cols)


def clip_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stored files to a row for each clip: doc_id, clip, first_frame, n_frames, start_s, end_s, error. A missing or damaged file has one
    row, of which the error alone is set."""
    for batch in batches:
        rows: list[tuple] = []
        for doc, x in zip(batch.column("doc_id").to_pylist(), batch.column("media"), strict=True):
            try:
                avi, frames = opened(x.as_py() or b"")
            except ValueError as error:
                rows.append((doc, None, None, None, None, None, str(error)))
                continue
            starts = cuts(frames)
            for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(frames)], strict=True)):
                rows.append((doc, k, a, b - a, a / avi.rate, b / avi.rate, None))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string())
        if rows:
            yield pa.RecordBatch.from_pydict({n: pa.array(v, k) for n, v, k in zip(("doc_id", "clip", "first_frame", "n_frames", "start_s", "end_s", "error"), zip(*rows, strict=True), kinds, strict=True)})


def store(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as an AVI file."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(on_executors("motion_jpeg", "stored"), "doc_id long, n_bytes long, media binary")


def clips(media: DataFrame) -> DataFrame:
    return media.select("doc_id", "media").mapInArrow(on_executors("motion_jpeg", "clip_rows"), "doc_id long, clip int, first_frame int, n_frames int, start_s double, end_s double, error string")


def op6_media_columns(spark, sf_dir: str) -> DataFrame:
    return store(table(spark, sf_dir, "documents")).mapInArrow(on_executors("motion_jpeg", "digests"), DIGEST)

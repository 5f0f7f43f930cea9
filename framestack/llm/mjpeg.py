"""Motion-JPEG media columns: AVI files whose frames are intra-coded JPEGs, and the clips in them.

pack() stores bytes as 24 x 24 grey 8-bit frames, each a lossless JPEG (SOF3, left predictor), in a
RIFF/AVI file with an idx1 index.  unpack() parses the index and decodes the frames; shots() cuts
where the histogram difference to the frame before exceeds an adaptive threshold, and clips()
gives the timed clip rows.  Everything is one narrow pass; coding runs over all frames of a batch
in step, in numpy.  Frames are decoded by the Huffman table and predictor they carry; lossy frames, which
cannot hold a payload, and other predictors are refused.  A file that is refused or broken gives a row with
its `error`, no payload and no clips; null media gives such a row without an error.

Null texts count as empty (one frame of padding); equal inputs give equal files; repeated rows stay.
pack() reads key and text only; unpack() replaces columns with the names of its own.  A file is one BINARY
value, so below 2 GB.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

SIDE = 24
FRAME = SIDE * SIDE
FPS = 25
BINS = 16
#: A cut needs a difference over MEAN + SPREAD deviations of the WINDOW frames around, and over LEAST.
WINDOW, SPREAD, LEAST = 8, 3.0, 0.35

# The Huffman code lengths of the difference categories 0 to 8.
LENGTHS = (4, 5, 4, 4, 3, 3, 4, 2, 5)
#: Frames decoded in step at once; bounds the working memory.
CHUNK = 8192


def _codes() -> tuple[np.ndarray, list[int]]:
    """Canonical codes by category, and the categories in code order."""
    order = sorted(range(len(LENGTHS)), key=lambda c: (LENGTHS[c], c))
    codes, code, last = np.zeros(len(LENGTHS), np.uint32), 0, LENGTHS[order[0]]
    for c in order:
        code <<= LENGTHS[c] - last
        codes[c], last = code, LENGTHS[c]
        code += 1
    return codes, order


CODES, ORDER = _codes()
assert sum(2.0**-n for n in LENGTHS) < 1  # JPEG leaves the code of all ones unused
LEN = np.array(LENGTHS, np.int64)


def _decode_table(counts: bytes, symbols: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """Longest code, and by as many next bits the symbol and its code's length (0: no code), of a DHT segment."""
    if len(counts) != 16 or len(symbols) < sum(counts) or not sum(counts) or max(symbols[: sum(counts)]) > 8:
        raise ValueError("unfit Huffman table")
    top = max(n for n, c in enumerate(counts, 1) if c)
    symbol, length = np.zeros(1 << top, np.uint8), np.zeros(1 << top, np.int64)
    code = at = 0
    for n, c in enumerate(counts[:top], 1):
        for s in symbols[at : at + c]:
            first = code << (top - n)
            symbol[first : first + (1 << (top - n))], length[first : first + (1 << (top - n))] = s, n
            code += 1
        at += c
        code <<= 1
    return top, symbol, length


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


DHT = bytes(LENGTHS.count(n) for n in range(1, 17)) + bytes(ORDER)
HEAD = (
    b"\xff\xd8"
    + _segment(0xC3, struct.pack(">BHHBBBB", 8, SIDE, SIDE, 1, 1, 0x11, 0))
    + _segment(0xC4, bytes([0]) + DHT)
    + _segment(0xDA, bytes([1, 1, 0x00, 1, 0, 0]))
)
TAIL = b"\xff\xd9"


def _differences(frames: np.ndarray) -> np.ndarray:
    """Left-predicted differences of (n, SIDE, SIDE) samples; the first column is predicted from above."""
    wide = frames.astype(np.int16)
    out = np.empty_like(wide)
    out[:, :, 1:] = wide[:, :, 1:] - wide[:, :, :-1]
    out[:, 1:, 0] = wide[:, 1:, 0] - wide[:, :-1, 0]
    out[:, 0, 0] = wide[:, 0, 0] - 128
    return out.reshape(len(frames), FRAME)


_CATEGORY = np.array([int(v).bit_length() for v in range(256)], np.uint8)


def encode_frames(frames: np.ndarray) -> list[bytes]:
    """A lossless JPEG for each (SIDE, SIDE) frame."""
    out: list[bytes] = []
    for at in range(0, len(frames), 2048):
        out += _encode_chunk(frames[at : at + 2048])
    return out


def _encode_chunk(frames: np.ndarray) -> list[bytes]:
    diff = _differences(frames)
    cat = _CATEGORY[np.abs(diff)].astype(np.int64)
    extra = np.where(diff < 0, diff + (1 << cat) - 1, diff).astype(np.uint64)
    value = CODES[cat].astype(np.uint64) << cat.astype(np.uint64) | extra
    length = LEN[cat] + cat
    ends = np.cumsum(length, axis=1)
    size = -(-ends[:, -1] // 8)  # bytes of each frame; the last is filled with ones
    base = np.concatenate(([0], np.cumsum(size)[:-1]))
    start = ends - length + 8 * base[:, None]
    # Each code has at most 13 bits, so it meets at most three bytes.
    byte, shift = start >> 3, (24 - (start & 7) - length).astype(np.uint64)
    wide = value << shift
    total = int(size.sum())
    packed = np.zeros(total + 3, np.float64)
    flat = byte.ravel()
    for k in range(3):
        part = (wide >> np.uint64(16 - 8 * k) & np.uint64(255)).ravel()
        packed += np.bincount(flat + k, part, total + 3)  # codes don't overlap, so adding is or-ing
    data = packed[:total].astype(np.uint8)
    pad = (8 * size - ends[:, -1]).astype(np.int64)
    data[base + size - 1] |= ((1 << pad) - 1).astype(np.uint8)
    raw, cut = data.tobytes(), [*base.tolist(), total]
    return [HEAD + raw[cut[i] : cut[i + 1]].replace(b"\xff", b"\xff\x00") + TAIL for i in range(len(frames))]


def parse_jpeg(data: bytes) -> tuple[bytes, bytes]:
    """The Huffman table (16 counts and symbols) and the unstuffed entropy-coded bytes of a lossless grey frame of SIDE x SIDE."""
    if data.startswith(HEAD):
        return DHT, data[len(HEAD) : -2].replace(b"\xff\x00", b"\xff")
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    at, table, shape = 2, {}, None
    while at + 4 <= len(data) and data[at] == 0xFF:
        mark, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xC3:
            shape = struct.unpack(">BHHB", body[:6])
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only lossless frames (SOF3) are decoded")
        elif mark == 0xC4:
            while len(body) > 17:
                n = 17 + sum(body[1:17])
                table[body[0]] = body[1:n]
                body = body[n:]
        elif mark == 0xDD and body != b"\0\0":
            raise ValueError("restart intervals are not decoded")
        elif mark == 0xDA:
            if shape != (8, SIDE, SIDE, 1):
                raise ValueError(f"frames of another shape: {shape}")
            if len(body) < 6 or body[0] != 1 or body[3] != 1 or body[5] & 15 or body[2] >> 4 not in table:
                raise ValueError("a predictor other than the left one, or no table")
            end = data.rfind(b"\xff\xd9")
            return table[body[2] >> 4], data[at : end if end >= at else len(data)].replace(b"\xff\x00", b"\xff")
    raise ValueError("a frame without a scan")


def decode_frames(jpegs: list[bytes]) -> np.ndarray:
    """(n, SIDE, SIDE) samples; CHUNK frames of one Huffman table at a time advance together, one sample a step."""
    out = np.empty((len(jpegs), SIDE, SIDE), np.uint8)
    coded: dict[bytes, list[tuple[int, bytes]]] = {}
    for i, j in enumerate(jpegs):
        table, body = parse_jpeg(j)
        coded.setdefault(table, []).append((i, body))
    for table, frames in coded.items():
        read = _decode_table(table[:16], table[16:])
        for at in range(0, len(frames), CHUNK):
            places, bodies = zip(*frames[at : at + CHUNK], strict=True)
            out[list(places)] = _decode_chunk(bodies, *read)
    return out


def _decode_chunk(coded: tuple[bytes, ...], top: int, symbol: np.ndarray, length: np.ndarray) -> np.ndarray:
    size = np.array([len(c) for c in coded], np.int64)
    data = np.frombuffer(b"".join(coded) + bytes(4), np.uint8).astype(np.uint32)
    word = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]  # 32 bits from each byte on
    at_bit = 8 * (np.cumsum(size) - size)
    end_bit = 8 * np.cumsum(size)
    got = np.empty((FRAME, len(coded)), np.int16)
    for s in range(FRAME):
        if (at_bit >= end_bit).any():
            raise ValueError("a frame ends too early")
        window = word[at_bit >> 3] << (at_bit & 7).astype(np.uint32)
        next_bits = window >> np.uint32(32 - top)
        cat, n = symbol[next_bits], length[next_bits]
        if not n.all():
            raise ValueError("a code that the table lacks")
        wide = cat.astype(np.uint32)
        extra = ((window << n.astype(np.uint32)).astype(np.uint64) >> (32 - wide).astype(np.uint64)).astype(np.int32)
        half = np.left_shift(1, wide.astype(np.int32)) >> 1
        got[s] = np.where(extra < half, extra - 2 * half + 1, extra)
        at_bit += n + cat
    if (at_bit > end_bit).any():
        raise ValueError("a frame ends too early")
    diff = np.ascontiguousarray(got.T).reshape(-1, SIDE, SIDE)
    diff[:, :, 0] = np.cumsum(diff[:, :, 0], axis=1, dtype=np.int16) + 128
    return np.cumsum(diff, axis=2, dtype=np.int16).astype(np.uint8)


# -- RIFF --------------------------------------------------------------------------------------


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def build_avi(jpegs: list[bytes], fps: int = FPS) -> bytes:
    largest = max(map(len, jpegs), default=0)
    main = struct.pack("<14I", 1_000_000 // fps, 0, 0, 0x10, len(jpegs), 0, 1, largest, SIDE, SIDE, 0, 0, 0, 0)
    stream = b"vids" + b"MJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, fps, 0, len(jpegs), largest, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    bitmap = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    header = b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", bitmap))
    movie, index, at = [b"movi"], [], 4
    for j in jpegs:
        body = _chunk(b"00dc", j)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(j)))
        movie.append(body)
        at += len(body)
    return _chunk(b"RIFF", b"AVI " + _chunk(b"LIST", header) + _chunk(b"LIST", b"".join(movie)) + _chunk(b"idx1", b"".join(index)))


def parse_avi(data: bytes) -> tuple[int, list[bytes]]:
    """Microseconds a frame and the coded video frames, found through idx1 (through movi where there is none)."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    at, movie, until, index, micros = 12, 0, 0, None, 0
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if name == b"LIST" and data[at + 8 : at + 12] == b"hdrl":
            micros = int.from_bytes(data[at + 20 : at + 24], "little")
        elif name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movie, until = at + 8, at + 8 + size
        elif name == b"idx1":
            index = np.frombuffer(data[at + 8 : at + 8 + size // 16 * 16], "<u4").reshape(-1, 4)
        at += 8 + size + (size & 1)
    frames = []
    if index is not None:
        offsets = index[:, 2].astype(np.int64)
        base = movie if len(offsets) == 0 or offsets[0] < movie else 0  # some writers count from the file's start
        for name, start, size in zip(index[:, 0].tolist(), (offsets + base).tolist(), index[:, 3].tolist(), strict=True):
            if name >> 16 in (0x6364, 0x6264):  # ..dc, ..db
                frames.append(data[start + 8 : start + 8 + size])
    else:
        at = movie + 4
        while movie and at + 8 <= until:
            size = int.from_bytes(data[at + 4 : at + 8], "little")
            if data[at + 2 : at + 4] in (b"dc", b"db"):
                frames.append(data[at + 8 : at + 8 + size])
            at += 8 + size + (size & 1)
    return micros, frames


# -- shots -------------------------------------------------------------------------------------


def histograms(frames: np.ndarray) -> np.ndarray:
    """Share of the samples in each of BINS equal ranges, by frame."""
    out = np.empty((len(frames), BINS))
    for at in range(0, len(frames), CHUNK):
        part = frames[at : at + CHUNK].reshape(-1, FRAME) >> (8 - BINS.bit_length() + 1)
        where = part + (BINS * np.arange(len(part), dtype=np.int32))[:, None]
        out[at : at + CHUNK] = np.bincount(where.ravel(), minlength=len(part) * BINS).reshape(-1, BINS) / FRAME
    return out


def shots(hist: np.ndarray) -> list[tuple[int, int]]:
    """(first frame, frame after the last) of each shot, by adaptive histogram differences."""
    n = len(hist)
    diff = np.abs(np.diff(hist, axis=0)).sum(1) / 2  # between frames i and i + 1
    if n < 2:
        return [(0, n)] if n else []
    one, two = (np.concatenate(([0], np.cumsum(x))) for x in (diff, diff * diff))
    i = np.arange(n - 1)
    lo, hi = np.maximum(i - WINDOW, 0), np.minimum(i + WINDOW + 1, n - 1)
    count = hi - lo - 1  # the difference itself is left out
    mean = (one[hi] - one[lo] - diff) / np.maximum(count, 1)
    spread = np.sqrt(np.maximum((two[hi] - two[lo] - diff * diff) / np.maximum(count, 1) - mean * mean, 0))
    cuts = (np.flatnonzero((diff > LEAST) & (diff > mean + SPREAD * spread)) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, n], strict=True))


# -- columns -----------------------------------------------------------------------------------


def payload(raw: bytes) -> bytes:
    return raw + b"\xff" * (-len(raw) % FRAME or FRAME * (not raw))


def pack(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes long, media binary): each text as an AVI file."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
            full = [payload(r) for r in raw]
            jpegs = encode_frames(np.frombuffer(b"".join(full), np.uint8).reshape(-1, SIDE, SIDE)) if full else []
            at, media = 0, []
            for p in full:
                media.append(build_avi(jpegs[at : at + len(p) // FRAME]))
                at += len(p) // FRAME
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], [key, "n_bytes", "media"])

    rows = df.select(key, F.col(text).cast("string"))
    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, n_bytes long, media binary")


CLIP = "array<struct<first:int,after:int,start_ms:double,end_ms:double>>"
_CLIP = pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32()), ("start_ms", pa.float64()), ("end_ms", pa.float64())]))


def read_files(media: list[bytes | None]) -> list[tuple[int, np.ndarray | None, str | None]]:
    """(microseconds a frame, samples or None, error or None) of each file; the frames of all sound files are decoded together."""
    out: list = []
    for m in media:
        try:
            out.append((*parse_avi(m), None) if m is not None else (0, None, None))
        except (ValueError, struct.error) as error:
            out.append((0, None, str(error) or "broken file"))
    try:
        frames = decode_frames([f for _, fs, _ in out if fs for f in fs])
    except (ValueError, IndexError, struct.error):
        for i, (micros, fs, error) in enumerate(out):  # file by file, to tell the broken ones
            try:
                out[i] = (micros, None if fs is None else decode_frames(fs), error)
            except (ValueError, IndexError, struct.error) as found:
                out[i] = (0, None, str(found) or "broken frame")
        return out
    at = 0
    for i, (micros, fs, error) in enumerate(out):
        if fs is not None:
            out[i] = (micros, frames[at : at + len(fs)], error)
            at += len(fs)
    return out


def unpack(df: DataFrame, media: str = "media") -> DataFrame:
    """df with payload binary (the samples read back), frames int, clips array and error string for each media file."""
    bounded_batches(df.sparkSession)
    rows = df.drop("payload", "frames", "clips", "error")
    names, place = rows.columns, rows.columns.index(media)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, count, clips, errors = [], [], [], []
            for micros, frames, error in read_files(batch.column(place).to_pylist()):
                body.append(None if frames is None else frames.tobytes())
                count.append(0 if frames is None else len(frames))
                cuts = [] if frames is None else shots(histograms(frames))
                clips.append([{"first": a, "after": b, "start_ms": a * micros / 1000, "end_ms": b * micros / 1000} for a, b in cuts])
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(body, pa.binary()), pa.array(count, pa.int32()), pa.array(clips, _CLIP), pa.array(errors, pa.string())], [*names, "payload", "frames", "clips", "error"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, payload binary, frames int, clips {CLIP}, error string")


def clips(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a clip of unpack()'s result: (key, clip, first, after, start_ms, end_ms)."""
    return df.select(key, F.posexplode("clips").alias("clip", "c")).select(key, "clip", "c.*")

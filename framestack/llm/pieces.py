"""SentencePiece encoding that keeps offsets: every piece knows the bytes of the text that it came from.

A text is normalised here, by the longest prefix that the model's compiled character map knows at each
place, and each byte of the normal form keeps the span of source bytes that it stands for.  The library's
own model, with its normaliser switched off, then turns the normal form into pieces, segment by segment;
lengths of pieces summed along the normal form give their places in it, and the kept spans project them
to byte spans of the source.  A segment is a run of blank marks with what follows it: where no piece of
the vocabulary joins a character to a blank mark behind it, no merge crosses a segment, so segments
met before come from a memo; any other vocabulary is encoded whole.

encode() and decode() are one narrow pass each, in Arrow batches of bounded bytes.  Null texts count as
empty, and empty texts give only the begin and end ids.  Repeated rows give repeated rows, and no row
depends on another, so ties can't matter; only the key and text columns are read, so other columns can
have any name.  Ids are little-endian unsigned 32-bit integers in a BINARY column, spans are pairs of such
integers (first byte, byte behind) in another.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

MARK = "▁"
#: A worker's memo starts anew behind the group in which it passes so many segments or characters; results do not depend on it.
MEMO_SEGMENTS, MEMO_CHARS = 1 << 18, 1 << 22
#: Texts are encoded in groups of about so many characters; MEGABYTES of them come in one batch.
GROUP_CHARS, MEGABYTES = 1 << 19, 2

_SEGMENT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Field numbers of the model file (a protocol buffer): fixed values.
_PIECES, _TRAINER, _NORMALIZER = 1, 2, 3
_PIECE, _KIND, _BYTE_KIND = 1, 3, 6
_SUFFIX = 24
_MAP, _DUMMY, _EXTRA, _ESCAPE = 2, 3, 4, 5
_loaded: dict[str, Pieces] = {}


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message; fixed-width values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + size]
        at += size


class CharMap:
    """The compiled character map: a double-array trie over UTF-8 bytes whose values point into a pool of NUL-ended strings."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.pool = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes read, what they become) of the longest prefix of data[at:] that the map knows."""
        units, found = self.units, None
        if not units:
            return None
        offset = lambda u: (u >> 10) << ((u & 512) >> 6)
        node = offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node] if node < len(units) else 0
            if unit & 0x800000FF != data[i]:
                break
            node ^= offset(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        return found and (found[0], self.pool[found[1] : self.pool.index(b"\0", found[1])])


class Normalizer:
    """Text to its normal form, with the source span of each byte of it."""

    def __init__(self, spec: bytes, suffix: bool):
        got = dict(_fields(spec))
        self.map = CharMap(got.get(_MAP, b""))
        self.dummy, self.extra, self.escape = (bool(got.get(k, 1)) for k in (_DUMMY, _EXTRA, _ESCAPE))
        self.suffix = suffix
        self.space = MARK.encode() if self.escape else b" "
        self.plain = not self.map.units and not self.extra and self.escape and not suffix

    def __call__(self, text: str) -> tuple[str, np.ndarray, np.ndarray]:
        """(normal form, start, end): byte i of the form stands for source bytes start[i] to end[i]."""
        if self.plain:
            form = (MARK if self.dummy and text else "") + text.replace(" ", MARK)
            return form, *_plain_spans(text, form)
        return self._mapped(text.encode())

    def _steps(self, data: bytes) -> Iterator[tuple[int, int, bytes]]:
        """(first byte, byte behind, what it becomes) of each longest prefix, or of a character that the map does not know."""
        at = 0
        while at < len(data):
            known = self.map.longest(data, at)
            if known is None:
                first = data[at]
                size = 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)
                known = size, data[at : at + size]
            yield at, at + known[0], known[1]
            at += known[0]

    def _mapped(self, data: bytes) -> tuple[str, np.ndarray, np.ndarray]:
        out, start, end = bytearray(), [], []

        def put(piece: bytes, a: int, b: int) -> None:
            out.extend(piece)
            one_to_one = len(piece) == b - a and piece == data[a:b]
            start.extend(range(a, b) if one_to_one else [a] * len(piece))
            end.extend(range(a + 1, b + 1) if one_to_one else [b] * len(piece))

        steps = list(self._steps(data))
        lead = 0
        while self.extra and lead < len(steps) and steps[lead][2] == b" ":
            lead += 1
        steps = steps[lead:]
        if not steps:
            return "", np.empty(0, np.int32), np.empty(0, np.int32)
        origin = steps[0][0]
        if self.dummy and not self.suffix:
            put(self.space, origin, origin)
        blank = self.extra  # whether the last byte put was a blank, where runs of them become one
        for a, b, form in steps:
            while blank and form.startswith(b" "):
                form = form[1:]
            if not form:
                continue
            if b" " in form:
                for c in form:
                    put(self.space if c == 32 else bytes([c]), a, b)
            else:
                put(form, a, b)
            blank = self.extra and form.endswith(b" ")
        while self.extra and out.endswith(self.space):
            del out[-len(self.space) :], start[-len(self.space) :], end[-len(self.space) :]
        if self.dummy and self.suffix:
            put(self.space, len(data), len(data))
        return out.decode("utf-8", "replace"), np.array(start, np.int32), np.array(end, np.int32)


def _plain_spans(text: str, form: str) -> tuple[np.ndarray, np.ndarray]:
    """Spans where the form only puts marks for blanks, and perhaps one in front."""
    source, made = (np.frombuffer(t.encode(), np.uint8) for t in (text, form))
    at = np.append(np.flatnonzero(source & 0xC0 != 0x80), len(source)).astype(np.int32)
    first = np.flatnonzero(made & 0xC0 != 0x80).astype(np.int32)
    extra = np.zeros(len(first) - (len(at) - 1), np.int32)
    begin, behind = np.append(extra, at[:-1]), np.append(extra, at[1:])
    size = np.diff(np.append(first, np.int32(len(made))))
    within = np.arange(len(made), dtype=np.int32) - np.repeat(first, size)
    same = np.repeat(size == behind - begin, size)
    start, end = np.repeat(begin, size), np.repeat(behind, size)
    return np.where(same, start + within, start), np.where(same, start + within + 1, end)


class Pieces:
    """A model file: normaliser, the library's model behind it, lengths of pieces, and a memo of segments."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            data = f.read()
        fields = list(_fields(data))
        message = lambda number: b"".join(v for k, v in fields if k == number)  # noqa: E731  copies of a message merge
        trainer = dict(_fields(message(_TRAINER)))
        self.normal = Normalizer(message(_NORMALIZER), bool(trainer.get(_SUFFIX, 0)))
        pieces = [dict(_fields(v)) for k, v in fields if k == _PIECES]
        names = [p[_PIECE].decode() for p in pieces]
        self.size = np.array([1 if p.get(_KIND, 1) == _BYTE_KIND else len(p[_PIECE]) for p in pieces], np.int64)
        self.parted = not any(re.search(f"[^{MARK}]{MARK}", n) for n in names)
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=data)
        # A later copy of a field overrides an earlier one: no map, no mark in front, nothing removed, nothing escaped.
        bare = bytes([_MAP << 3 | 2, 0, _DUMMY << 3, 0, _EXTRA << 3, 0, _ESCAPE << 3, 0])
        self.model = sentencepiece.SentencePieceProcessor(model_proto=data + bytes([_NORMALIZER << 3 | 2, len(bare)]) + bare)
        self.begin, self.end, self.unknown = self.whole.bos_id(), self.whole.eos_id(), self.whole.unk_id()
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}  # segment: its place among the rows of ids
        self.held, self.rows, self.ends = 0, np.empty(0, np.int64), np.zeros(1, np.int64)

    def _learn(self, parts: set[str]) -> None:
        """Ask the model once for the segments that the memo lacks."""
        if len(self.memo) > MEMO_SEGMENTS or self.held > MEMO_CHARS:
            self._forget()
        new = [p for p in parts if p not in self.memo]
        got = self.model.encode(new, num_threads=1) if new else []
        self.memo.update(zip(new, range(len(self.memo), len(self.memo) + len(new))))
        self.held += sum(map(len, new))
        self.rows = np.append(self.rows, np.fromiter(chain.from_iterable(got), np.int64))
        self.ends = np.append(self.ends, self.ends[-1] + np.cumsum([len(g) for g in got], dtype=np.int64))

    def ids(self, form: list[str]) -> np.ndarray:
        """Ids of the segments of a normal form, which the memo has."""
        at = np.fromiter(map(self.memo.__getitem__, form), np.int64, len(form))
        size = self.ends[at + 1] - self.ends[at]
        behind = np.cumsum(size)
        return self.rows[np.arange(behind[-1] if len(at) else 0) + np.repeat(self.ends[at] - (behind - size), size)]

    def encode(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids with begin and end, source byte spans of each) of every text."""
        group, chars = [], 0
        for text in texts:
            group.append(text or "")
            chars += len(group[-1])
            if chars >= GROUP_CHARS:
                yield from self._group(group)
                group, chars = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        forms = [self.normal(t) for t in texts]
        parts = [_SEGMENT.findall(f) if self.parted else [f] if f else [] for f, _, _ in forms]
        self._learn(set(chain.from_iterable(parts)))
        return map(self._spanned, texts, forms, parts)

    def _spanned(self, text: str, form: tuple[str, np.ndarray, np.ndarray], parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        _, start, end = form
        ids = self.ids(parts)
        size = self._surfaces(parts) if self.unknown in ids else self.size[ids]
        behind = np.cumsum(size)
        if len(start) != (behind[-1] if len(ids) else 0):
            raise ValueError("pieces do not add up to the normal form")
        spans = np.empty((len(ids) + 2, 2), "<u4")
        spans[0], spans[-1] = 0, len(text.encode())
        spans[1:-1, 0], spans[1:-1, 1] = start[behind - size], end[behind - 1]
        return np.concatenate(([self.begin], ids, [self.end])).astype("<u4"), spans

    def _surfaces(self, parts: list[str]) -> np.ndarray:
        """Bytes of each piece, asked of the library: a run of characters that the model does not know is one piece."""
        said = (self.model.encode(p, return_type="proto").pieces for p in parts)
        return np.array([len(p.surface.encode()) for p in chain.from_iterable(said)], np.int64)


def pieces(path: str) -> Pieces:
    """The model of a path, once per worker."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens long, ids binary, spans binary) for every row of df, begin and end ids included."""
    bounded_batches(df.sparkSession, megabytes=MEGABYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            made = [(i.tobytes(), s.tobytes()) for i, s in model.encode(batch.column(1).to_pylist())]
            columns = [pa.array([len(i) // 4 for i, _ in made], pa.int64()), pa.array([i for i, _ in made], pa.binary()), pa.array([s for _, s in made], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [key, "n_tokens", "ids", "spans"])

    rows = df.select(key, F.col(text).cast("string"))
    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, n_tokens long, ids binary, spans binary")


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text of its ids, by the library's decode, in column `out` (replaced if it exists).  Null ids give an empty text."""
    bounded_batches(df.sparkSession, megabytes=MEGABYTES)
    rows = df.drop(out) if out != ids else df
    names, place = rows.columns, rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path).whole
        for batch in batches:
            said = [model.decode(np.frombuffer(b, "<u4").tolist()) if b else "" for b in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.string())], [*names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, `{out}` string")

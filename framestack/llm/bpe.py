"""Byte-level BPE with the tiktoken library and a local rank file.

encode() turns whole texts into token ids, decode() ids back into raw bytes.  Both are one
narrow pass (no shuffle); a batch holds bounded bytes.  Null texts count as empty: no ids, empty
bytes.  Repeated rows give repeated rows; only the key and text columns are read, so other
columns can have any name.  Ids are little-endian unsigned 32-bit integers in a BINARY column.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Longer texts are cut at safe boundaries into pieces of about this many characters.
PIECE_CHARS = 1 << 18
#: Longer runs of white space are encoded as the single match that they are, without the regex.
LONG_BLANK = 20_000

_BLANK_RUN = re.compile(r"[ \t\n\r]{%d,}" % LONG_BLANK)
#: One space between two characters that are not white space: no match of the pattern spans its left edge.
_SAFE = re.compile(r"(?<=[^\s\x1c-\x1f\x85]) (?=[^\s\x1c-\x1f\x85])")
_encodings: dict = {}


def encoding(rank_path: str, pattern: str):
    """The tiktoken encoding of a rank file, once per worker."""
    if (rank_path, pattern) not in _encodings:
        import tiktoken

        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _encodings[rank_path, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[rank_path, pattern]


def pieces(text: str, limit: int = PIECE_CHARS) -> Iterator[tuple[str, bool]]:
    """(piece, is one match): cuts of a long text that no match of the pattern crosses."""
    at = 0
    for run in _BLANK_RUN.finditer(text) if len(text) > LONG_BLANK else ():
        start, end = run.span()
        before, after = text[start - 1 : start], text[end : end + 1]
        if before.isspace() or after.isspace():
            continue
        end -= bool(after)  # the last blank goes with what follows
        yield from _cut(text[at:start], limit)
        yield text[start:end], True
        at = end
    yield from _cut(text[at:], limit)


def _cut(text: str, limit: int) -> Iterator[tuple[str, bool]]:
    at = 0
    while len(text) - at > limit and (m := _SAFE.search(text, at + limit)):
        yield text[at : m.start()], False
        at = m.start()
    if at < len(text):
        yield text[at:], False


def encode_text(enc, text: str | None) -> np.ndarray:
    if not text:
        return np.empty(0, "<u4")
    if len(text) <= LONG_BLANK:
        return np.array(enc.encode_ordinary(text), "<u4")
    ids: list[int] = []
    for piece, one in pieces(text):
        ids += enc._encode_single_piece(piece) if one else enc.encode_ordinary(piece)
    return np.array(ids, "<u4")


def encode(df: DataFrame, rank_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens long, ids binary) for every row of df."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_path, pattern)
        for batch in batches:
            ids = [encode_text(enc, t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, ids), pa.int64(), size=len(ids)), pa.array([i.tobytes() for i in ids], pa.binary())],
                [key, "n_tokens", "ids"],
            )

    rows = df.select(key, F.col(text).cast("string"))
    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, n_tokens long, ids binary")


def decode(df: DataFrame, rank_path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the raw bytes of its ids in column `out` (replaced if it exists).  Null ids give empty bytes."""
    bounded_batches(df.sparkSession)
    rows = df.drop(out) if out != ids else df
    names, place = rows.columns, rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_path, pattern)
        for batch in batches:
            raw = [enc.decode_bytes(np.frombuffer(b or b"", "<u4").tolist()) for b in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], [*names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, `{out}` binary")

"""Token ids in a file format of directly addressable codes.

Ids are cut into 8-bit chunks.  Level k of a segment holds the k-th chunk of each id that has one,
a bitmap of the ids that continue, and a rank directory over that bitmap, so any token is found
with one rank per level and no block is decoded.  Segments are rows of Parquet files, in ascending
key order; a segment holds whole documents and about SEGMENT_TOKENS ids.

write() makes one shuffle, of the ids and not of the texts, by key ranges.  Null texts count as
empty; a null key sorts first; rows with equal keys stay separate, in order of their ids.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, partitions, stored

SEGMENT_TOKENS = 1 << 20
RANK_BITS = 512
#: Words whose ids a worker remembers at most.
MEMO_WORDS = 1 << 20

_tokenizers: dict = {}
#: Letters whose normal form and class are beyond doubt, then marks without apostrophes.
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0134-\u0148]+)([!-&(-/:-;=?-@\[-`{-~]*)")

SEGMENT = "bucket int, segment int, bucket_start long, n_tokens long, keys array<long>, ends array<long>, levels array<binary>, bitmaps array<binary>, ranks array<binary>"


# -- the codes ---------------------------------------------------------------------------------


def pack(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Chunk levels, continuation bitmaps and rank directories of unsigned ids."""
    levels, bitmaps, ranks = [], [], []
    rest = ids.astype(np.uint32)
    while len(rest):
        more = rest > 255
        levels.append((rest & 255).astype(np.uint8).tobytes())
        bits = np.packbits(more, bitorder="little")
        bits = np.pad(bits, (0, -len(bits) % (RANK_BITS // 8)))
        count = np.bitwise_count(bits.view(np.uint64)).reshape(-1, RANK_BITS // 64).sum(1)
        bitmaps.append(bits.tobytes())
        ranks.append(np.concatenate(([0], np.cumsum(count)[:-1])).astype("<u4").tobytes())
        rest = rest[more] >> 8
    return levels, bitmaps, ranks


def access(levels: list[bytes], bitmaps: list[bytes], ranks: list[bytes], at: np.ndarray) -> np.ndarray:
    """The ids at positions `at`, by rank alone."""
    out = np.zeros(len(at), np.uint32)
    live, place = np.arange(len(at)), np.asarray(at, np.int64)
    for k, chunk in enumerate(levels):
        if not len(live):
            break
        words = np.frombuffer(bitmaps[k], np.uint64)
        directory = np.frombuffer(ranks[k], "<u4")
        out[live] |= np.frombuffer(chunk, np.uint8)[place].astype(np.uint32) << np.uint32(8 * k)
        word, bit = place >> 6, (place & 63).astype(np.uint64)
        more = (words[word] >> bit & np.uint64(1)).astype(bool)
        live, place, word, bit = live[more], place[more], word[more], bit[more]
        block = place // RANK_BITS
        inside = _inside_block(words, block, word, whole=len(at) * 16 > len(chunk))
        place = directory[block].astype(np.int64) + inside + np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
    return out


def _inside_block(words: np.ndarray, block: np.ndarray, word: np.ndarray, whole: bool) -> np.ndarray:
    """Set bits between the start of each block and each word; whole: one running count serves all."""
    first = block * (RANK_BITS // 64)
    if whole:
        before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
        return before[word] - before[first]
    near = first[:, None] + np.arange(RANK_BITS // 64)
    return (np.bitwise_count(words[near]) * (near < word[:, None])).sum(1, dtype=np.int64)


# -- text to ids -------------------------------------------------------------------------------


class WordMemo:
    """Ids of texts by the tokenizers library, which is asked once for each new word.

    The tokenizer drops white space and never merges across it, so the ids of a text are those of
    its blank-separated words in a row.  Words of plain letters go straight to the library's merge
    model, any others through its whole chain of normalizer, splitter and model.  Of what it has
    seen, a worker keeps at most two generations of MEMO_WORDS / 2 words.
    """

    def __init__(self, path: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.dtype, self.young, self.old = Tokenizer.from_file(path), dtype, {}, {}
        visible = ByteLevel(add_prefix_space=False, use_regex=False)

        class Visible(dict):
            def __missing__(self, code: int) -> str:
                self[code] = visible.pre_tokenize_str(chr(code))[0][0]
                return self[code]

        self.visible = Visible()

    def _letters(self, word: str) -> bytes:
        if not word.isascii():
            word = self.tokenizer.normalizer.normalize_str(word).translate(self.visible)
        return np.array([t.id for t in self.tokenizer.model.tokenize(word.lower() if word.isascii() else word)], self.dtype).tobytes()

    def _remember(self, word: str, ids: bytes) -> bytes:
        if len(self.young) >= MEMO_WORDS // 2:
            self.young, self.old = {}, self.young
        self.young[word] = ids
        return ids

    def word(self, word: str) -> bytes | None:
        """Ids of a word that is known or easy, else None."""
        if (got := self.young.get(word)) is not None:
            return got
        if (got := self.old.get(word)) is not None:
            return self._remember(word, got)
        if not (m := _PLAIN.fullmatch(word)):
            return None
        letters, marks = m.groups()
        if marks:
            head = self.word(letters)
            tail = self.young.get(marks) or self.old.get(marks) or self._remember(marks, self._whole([marks])[0])
            return head + tail  # not kept: both parts are
        return self._remember(word, self._letters(word))

    def _whole(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def ids(self, texts: pa.Array, end: int) -> list[bytes]:
        """The ids of each text and the end id, as bytes."""
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        coded = [self.word(w) for w in distinct]
        hard = [i for i, c in enumerate(coded) if c is None]
        for i, ids in zip(hard, self._whole([distinct[i] for i in hard]), strict=True):
            coded[i] = self._remember(distinct[i], ids)
        size = np.array([len(c) for c in coded], np.int64) // np.dtype(self.dtype).itemsize
        flat, first = np.frombuffer(b"".join(coded), self.dtype), np.cumsum(size) - size
        use = words.indices.to_numpy(zero_copy_only=False)
        length = size[use]
        ends = np.cumsum(length)
        out = flat[np.repeat(first[use] - (ends - length), length) + np.arange(int(length.sum()))]
        cut = np.concatenate(([0], ends))[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        last = np.array([end], self.dtype).tobytes()
        return [out[a:b].tobytes() + last for a, b in zip(cut, cut[1:])]


def memo(path: str, dtype: str) -> WordMemo:
    if (path, dtype) not in _tokenizers:
        _tokenizers[path, dtype] = WordMemo(path, dtype)
    return _tokenizers[path, dtype]


def tokenized(df: DataFrame, tokenizer_path: str, end_id: int, bounds: list[int], wide: bool, key: str, text: str) -> DataFrame:
    """(key, bucket, ids binary): bucket counts the bounds below the key."""
    dtype, edges = ("<u4" if wide else "<u2"), np.array(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = memo(tokenizer_path, dtype)
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            known = ~np.array(batch.column(0).is_null())
            bucket = np.zeros(len(keys), np.int32)
            bucket[known] = np.searchsorted(edges, keys[known].astype(np.int64), "left")
            ids = words.ids(batch.column(1), end_id)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bucket), pa.array(ids, pa.binary())], ["key", "bucket", "ids"])

    return df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, "key long, bucket int, ids binary")


# -- the files ---------------------------------------------------------------------------------


def key_bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """Ascending keys that cut the rows into about equal ranges; read from the key column alone."""
    cuts = [i / parts for i in range(1, parts)]
    got = df.select(F.percentile_approx(F.col(key).cast("long"), cuts, 10_000).alias("b")).first()["b"] if cuts else []
    return sorted(set(got or []))


def write(df: DataFrame, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text", wide: bool = False) -> DataFrame:
    """Write the ids of df as segment files in key order and return the stored segments.

    wide: for vocabularies beyond 65,536 ids.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    parts = partitions(spark)
    bounds = key_bounds(df, key, parts)
    dtype = "<u4" if wide else "<u2"

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {"bucket": None, "segment": 0, "start": 0}
        keys: list = []
        ids: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            ends = np.cumsum([len(i) for i in ids], dtype=np.int64)
            levels, bitmaps, ranks = pack(np.concatenate(ids))
            row = {"bucket": state["bucket"], "segment": state["segment"], "bucket_start": state["start"], "n_tokens": int(ends[-1]), "keys": list(keys), "ends": ends.tolist(), "levels": levels, "bitmaps": bitmaps, "ranks": ranks}
            state["segment"] += 1
            state["start"] += int(ends[-1])
            keys.clear()
            ids.clear()
            return pa.RecordBatch.from_pylist([row], SCHEMA)

        held = 0
        for batch in batches:
            for k, bucket, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if keys and (held >= SEGMENT_TOKENS or bucket != state["bucket"]):
                    yield flush()
                    held = 0
                if bucket != state["bucket"]:
                    state.update(bucket=bucket, segment=0, start=0)
                keys.append(k)
                ids.append(np.frombuffer(raw, dtype))
                held += len(ids[-1])
        if keys:
            yield flush()

    rows = tokenized(df, tokenizer_path, end_id, bounds, wide, key, text)
    rows = rows.repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket", F.col("key").asc_nulls_first(), "ids")
    return stored(rows.mapInArrow(segments, SEGMENT), "dac")


SCHEMA = pa.schema([("bucket", pa.int32()), ("segment", pa.int32()), ("bucket_start", pa.int64()), ("n_tokens", pa.int64()), ("keys", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))] + [(n, pa.list_(pa.binary())) for n in ("levels", "bitmaps", "ranks")])


def bucket_starts(segments: DataFrame) -> dict[int, int]:
    """Tokens before each bucket; one row a bucket (at most one a partition) comes to the driver."""
    at, out = 0, {}
    for bucket, n in sorted(segments.groupBy("bucket").agg(F.sum("n_tokens")).collect()):
        out[bucket], at = at, at + n
    return out


def read(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids binary little-endian u32): every document of the stored segments."""
    starts = bucket_starts(segments)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ends = np.array(row["ends"], np.int64)
                begins = np.concatenate(([0], ends[:-1]))
                base = starts[row["bucket"]] + row["bucket_start"]
                ids = access(row["levels"], row["bitmaps"], row["ranks"], np.arange(row["n_tokens"])).astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["keys"], pa.int64()), pa.array(base + begins), pa.array(ends - begins), pa.array([ids[a:b].tobytes() for a, b in zip(begins, ends, strict=True)], pa.binary())],
                    [key, "start", "n_tokens", "ids"],
                )

    bounded_batches(segments.sparkSession)
    return segments.mapInArrow(run, f"`{key}` long, start long, n_tokens long, ids binary")


def tokens_at(segments: DataFrame, wanted: DataFrame, key: str = "doc_id", position: str = "position") -> DataFrame:
    """(key, position, id) for (key, position) pairs: random access without decoding other tokens.

    Positions outside the document give a null id; a key that is not stored gives no row.
    """
    places = segments.select("bucket", "segment", F.posexplode("keys").alias("nth", key))
    asked = wanted.select(F.col(key).cast("long").alias(key), F.col(position).cast("long").alias(position))
    grouped = asked.join(places, key).groupBy("bucket", "segment").agg(F.collect_list(F.struct(key, "nth", position)).alias("asked"))
    joined = segments.join(grouped, ["bucket", "segment"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ends = np.array(row["ends"], np.int64)
                begins = np.concatenate(([0], ends[:-1]))
                keys, nth, at = (np.array([a[n] for a in row["asked"]], np.int64) for n in (key, "nth", position))
                inside = (at >= 0) & (begins[nth] + at < ends[nth])
                ids = access(row["levels"], row["bitmaps"], row["ranks"], (begins[nth] + at)[inside])
                out = np.zeros(len(at), np.int64)
                out[inside] = ids
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(at), pa.array(out, mask=~inside)], [key, position, "id"])

    bounded_batches(segments.sparkSession)
    return joined.mapInArrow(run, f"`{key}` long, `{position}` long, id long")

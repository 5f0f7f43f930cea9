"""Language identification by compression: the language whose dictionary compresses a text best.

train() takes a bounded sample of labelled texts as raw-content zstandard dictionaries, one a
language.  classify() compresses each whole text, in blocks, with every dictionary and chooses the
smallest sum.  A fast setting comes first; where its margin is narrow, a thorough one compresses the
whole text again, and where that is narrow too, `rejected` is true.  Texts that are null or have no
letters are `und`, with score 0.  Case, digits and ASCII marks are not used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, sampled_ids

#: The sample: about DOCS texts a language, of which DICTIONARY bytes are kept.
DOCS, DICTIONARY = 300, 96 << 10
BLOCK = 2048
LEVEL = 3
#: Margins, as a share of the smallest sum: below DOUBT the thorough setting decides, below NARROW a
#: result is rejected; SCALE makes the score.
DOUBT, NARROW, SCALE = 0.06, 0.01, 40.0
THOROUGH = {"window_log": 18, "chain_log": 16, "hash_log": 16, "search_log": 4, "min_match": 3, "target_length": 32, "strategy": 6}
UNKNOWN = "und"

#: ASCII characters other than letters become blanks.
_BLANKS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def letters(text: str | None) -> bytes:
    """The words of a text in lower case, as UTF-8 with single spaces; nothing if no character is a letter."""
    if not text:
        return b""
    content = b" ".join(text.lower().encode().translate(_BLANKS).split())
    return content if any(map(str.isalpha, text)) else b""


def train(labelled: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", docs: int = DOCS, size: int = DICTIONARY) -> dict[str, bytes]:
    """Raw dictionary content by language, from a repeatable sample of about `docs` texts for each."""
    named = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = dict(named.groupBy(lang).count().collect())  # one row a language
    out = {}
    for name, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):  # a tie of sizes goes to the commoner language
        rows = sampled_ids(named.where(F.col(lang) == name), key, n, docs)
        share = max(256, 4 * size // docs)
        pieces = sorted(rows.select(key, F.substring(text, 1, 4 * share).alias("t")).limit(4 * docs).collect(), key=lambda r: (r[0] is None, r[0], r[1]))
        out[name] = b" ".join(letters(t)[:share] for _, t in pieces)[-size:]
    return {name: content for name, content in out.items() if len(content) >= 8}


class Compressors:
    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard

        bare = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        thorough = zstandard.ZstdCompressionParameters(**THOROUGH, **bare)
        self.names, self.fast, self.thorough = list(dictionaries), [], []
        for name in self.names:
            d = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.thorough.append(zstandard.ZstdCompressor(dict_data=d, compression_params=thorough))
            d = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.fast.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, **bare))

    def _best(self, blocks: list[bytes], compressors: list) -> tuple[int, float]:
        size = np.array([sum(len(c.compress(b)) for b in blocks) for c in compressors])
        order = np.argsort(size, kind="stable")
        return int(order[0]), float((size[order[1]] - size[order[0]]) / size[order[0]]) if len(order) > 1 else 1.0

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score from 0 to 1, margin."""
        content = letters(text)
        if not content or not self.names:
            return UNKNOWN, 0.0, 0.0
        blocks = [content[i : i + BLOCK] for i in range(0, len(content), BLOCK)]
        best, margin = self._best(blocks, self.fast)
        if margin < DOUBT:
            best, margin = self._best(blocks, self.thorough)
        return self.names[best], 1 / (1 + math.exp(-SCALE * margin)), margin


def classify(df: DataFrame, dictionaries: dict[str, bytes], key: str = "doc_id", text: str = "text", narrow: float = NARROW) -> DataFrame:
    """(key, lang_pred, score, rejected) for every row of df."""
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(dictionaries)  # languages x DICTIONARY bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = Compressors(shared.value)
        for batch in batches:
            got = [compressors.predict(t) for t in batch.column(1).to_pylist()]
            name, score, margin = zip(*got, strict=True) if got else ((), (), ())
            rejected = [n != UNKNOWN and m < narrow for n, m in zip(name, margin, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [key, "lang_pred", "score", "rejected"])

    rows = df.select(key, F.col(text).cast("string"))
    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, lang_pred string, score double, rejected boolean")

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from framestack.llm import bpe, dac, queries

RANKS = P.path(queries.RANKS)


def test_op1_is_tiktoken_and_round_trips(spark, data, texts):
    enc = bpe.encoding(RANKS, P.PATTERN)
    got = {r["doc_id"]: r for r in queries.op1_bpe_round_trip(spark, data).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        ids = enc.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


@pytest.mark.parametrize("text", ["a " * 300_000, "x" * 100_000 + " it's 'twas", "a" + " " * 50_000 + "b", "\n" * 30_000, "é日 " * 120_000, "ab\t" + " " * 25_000 + "  c", "'s't" * 90_000])
def test_long_texts_are_cut_where_no_match_crosses(text):
    enc = bpe.encoding(RANKS, P.PATTERN)
    parts = list(bpe.pieces(text, 1000))
    assert "".join(p for p, _ in parts) == text
    assert bpe.encode_text(enc, text).tolist() == enc.encode_ordinary(text)
    ids = [i for p, one in parts for i in (enc._encode_single_piece(p) if one else enc.encode_ordinary(p))]
    assert ids == enc.encode_ordinary(text)


def test_op1_odd_rows(odd, empty):
    rows = bpe.decode(bpe.encode(odd, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    want = sorted(((r["text"] or "").encode() for r in odd.collect()))
    assert sorted(bytes(r["decoded"]) for r in rows) == want and len(rows) == odd.count()
    assert bpe.decode(bpe.encode(empty, RANKS, P.PATTERN), RANKS, P.PATTERN).count() == 0


def test_op3_is_the_tokenizer_read_back(spark, data, texts):
    tok = Tokenizer.from_file(P.path(queries.WORDS))
    got = {r["doc_id"]: r for r in queries.op3_token_files(spark, data).collect()}
    at = 0
    for i in sorted(texts):
        ids = [*tok.encode(texts[i] or "", add_special_tokens=False).ids, queries.END_ID]
        assert (got[i]["start"], got[i]["n_tokens"]) == (at, len(ids))
        assert got[i]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 511, 512, 513, 20_000])
def test_directly_addressable_codes(n):
    ids = (np.random.default_rng(n).zipf(1.2, n) % (1 << 30)).astype(np.uint32)
    code = dac.pack(ids)
    assert np.array_equal(dac.access(*code, np.arange(n)), ids)
    at = np.random.default_rng(1).integers(0, max(n, 1), min(n, 50))
    assert np.array_equal(dac.access(*code, at), ids[at])


def test_random_access_over_files(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(dac, "SEGMENT_TOKENS", 2000)
    segments = dac.write(docs, P.path(queries.WORDS), queries.END_ID)
    tok = Tokenizer.from_file(P.path(queries.WORDS))
    wanted = spark.createDataFrame([(3, 0), (3, 5), (7, 10**6), (-1, 0)], "doc_id long, position long")
    got = {(r["doc_id"], r["position"]): r["id"] for r in dac.tokens_at(segments, wanted).collect()}
    ids = tok.encode(texts[3], add_special_tokens=False).ids
    assert got == {(3, 0): ids[0], (3, 5): ids[5], (7, 10**6): None}


def test_word_memo_equals_the_library():
    import pyarrow as pa

    tok, memo = Tokenizer.from_file(P.path(queries.WORDS)), dac.memo(P.path(queries.WORDS), "<u2")
    for t in ["A <|endoftext|> b", "Σας ΑΣ́ é \x1c x y　z'S can't", "it's 12 34a", "", " \n\ta", "ÀÉ. ſt İI ǅ Ÿ ß don't! ĳ ŉ a.b x`y `` a_b <|startoftext|>", "école ½ ²"]:
        assert np.frombuffer(memo.ids(pa.array([t]), 2)[0], "<u2").tolist() == [*tok.encode(t, add_special_tokens=False).ids, 2]


def test_op3_odd_rows(spark, odd, empty):
    got = dac.read(dac.write(odd, P.path(queries.WORDS), 2)).collect()
    assert len(got) == odd.count() and {r["n_tokens"] for r in got if r["doc_id"] in (2, 3, 6)} == {1}
    first = min(got, key=lambda r: (r["start"], r["n_tokens"]))
    assert first["doc_id"] is None and first["start"] == 0
    ends = sorted((r["start"], r["n_tokens"]) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:]))
    assert dac.read(dac.write(empty, P.path(queries.WORDS), 2)).count() == 0

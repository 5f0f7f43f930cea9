import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F

from framestack.llm import conversations, pieces, queries, vectors

# -- prefix trie ---------------------------------------------------------------------------------


def trie_by_hand(rows):
    """Each rebuilt conversation walked through a dictionary of prefixes."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    digest = lambda r: hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()
    for turns in own.values():
        turns.sort(key=lambda r: (r[:2], digest(r)))
    sign = lambda c: int(math.fmod(c, 20))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple((r[2], r[3]) for r in own.get(c - sign(c), [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    below = defaultdict(set)
    for node in members:
        for d in range(len(node) + 1):
            below[node[:d]].add(node)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    saved = {n: (len(m) - 1) * (words(n[-1][1]) if n else 0) for n, m in members.items()}
    out = []
    for n, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(n))
        parent = min(members[n[:-1]]) if n else None
        out.append((min(m), len(n), parent, len(m), children[n], sum(not children[x] for x in below[n]), sum(saved[x] for x in below[n]), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    got = df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_op11_equals_brute_force(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op11_prefix_trie(spark, data)
    assert found(got) == trie_by_hand(rows)
    assert dict(got.dtypes) == {c: "string" if c == "ends_sha256" else "bigint" for c in got.columns}


@pytest.mark.parametrize("held", [1 << 17, 3])
def test_op11_odd_conversations(spark, monkeypatch, held):
    """Nulls, ties, repeated rows, missing bases, turnless and negative ids, copies; small parts of tries merge too."""
    monkeypatch.setattr(conversations, "HELD", held)
    rng = np.random.default_rng(11)
    texts = ["a b", "", None, " x\ty ", "é\x00z", "long " * 50]
    rows = [(int(c), None if t == 2 else int(t), [None, "user", "bot"][rng.integers(3)], texts[rng.integers(6)]) for c in [*range(-45, 30), 100, 101, 119, 139, 1 << 40, None] for t in rng.integers(0, 4, rng.integers(1, 6)) if c is not None]
    rows += [(None, 1, "user", "lost"), *[(c, t, "user", "same") for c in range(2000, 2300, 3) for t in range(4)], *[(c, 0, "user", "only") for c in (201, 202, 203, 204)]]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, family string, node int")
    assert found(conversations.trie(conversations.rebuilt(df))) == trie_by_hand(rows)
    assert any(conversations.heads(c) for c in (201, 202, 203, 204))  # some of these are left without turns


def test_op11_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.trie(conversations.rebuilt(none)).count() == 0


# -- vector codes --------------------------------------------------------------------------------


def codes_by_hand(rows, parts=8, entries=16, rounds=6):
    """Python's integers and plain loops."""
    kept = [(i, [math.floor(4096 * x) for x in v], l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]

    def near(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for _, v, _ in kept:
                groups[near(v, p)[1]].append(cut(v, p))
            books[p] = [[sum(x) // len(groups[k]) for x in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])]
    out, by_label = [], defaultdict(int)
    for i, v, label in kept:
        got = [near(v, p) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in got), sum(d for d, _ in got), label))
        by_label[label] += out[-1][2]
    flat = ",".join(str(x) for b in books for e in b for x in e)
    return sorted(((i, c, e, by_label[label], hashlib.sha256(flat.encode()).hexdigest()) for i, c, e, label in out), key=str)


def coded(df):
    rows = vectors.kept(df)
    books = vectors.train(rows)
    return vectors.with_label_error(vectors.encode(rows, books)).withColumn("sha", F.lit(books.sha256())).select("vec_id", "code", "error", "label_error", "sha")


def test_op12_equals_brute_force(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = queries.op12_vector_codes(spark, data)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == codes_by_hand(rows)


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_op12_odd_rows(spark, scale):
    """Nulls, non-finite components, repeated rows, ties, few rows, and components too large for 64-bit squares."""
    rng = np.random.default_rng(12)
    rows = [(int(i), (rng.integers(-3, 4, 16) / 4096 * rng.choice([1, 3], 16) * scale).tolist(), [None, 1, 2][i % 3]) for i in rng.integers(0, 60, 120)]
    rows += [rows[5], rows[5], (1, None, 1), (2, [None] * 16, 1), (3, [math.nan] * 16, 1), (4, [-math.inf] * 16, 2), (None, [0.5] * 16, None)]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "vec_id long, embedding array<double>, label int, salt int, code string")
    assert sorted((tuple(r) for r in coded(df).collect()), key=str) == codes_by_hand(rows)
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>, label int")
    assert sorted((tuple(r) for r in coded(few).collect()), key=str) == codes_by_hand(rows[:3])


def test_op12_other_lengths_and_empty(spark):
    rows = [(1, [0.1] * 8, 1), (2, [0.2] * 8, None), (3, [0.3] * 5, None), (4, [], 2)]
    got = {r["vec_id"]: r for r in coded(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert got[1]["code"] == "00" * 8 and got[2]["code"] == "01" * 8 and got[1]["error"] == 0
    assert got[3]["code"] is None and got[3]["error"] is None and got[3]["label_error"] == 0 and got[4]["label_error"] is None
    odd = coded(spark.createDataFrame([(1, [0.1] * 5, 1)], "vec_id long, embedding array<float>, label int")).collect()
    assert odd[0]["code"] is None
    assert coded(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    huge = coded(spark.createDataFrame([(1, [3e38] * 8, 1), (2, [-3e38] * 8, 1)], "vec_id long, embedding array<float>, label int")).collect()
    assert {(r["code"], r["error"]) for r in huge} == {("00" * 8, 0), ("01" * 8, 0)}


# -- SentencePiece -------------------------------------------------------------------------------

MODEL = P.path(queries.PIECES)
ALPHABET = ["a", "e", " ", "  ", "▁", "é", "日", "🙂", "\t", "\n", "x", "<s>", "</s>", "\x00", "ﬁ", "́", "the", " the", "ing", "\xa0", "　", "Ⅷ", "①", "ガ", "ﾃﾞ", "ｶ"]


def mixed_texts(n=1500):
    rng = np.random.default_rng(13)
    return ["", " ", "▁", "   ", *("".join(rng.choice(ALPHABET, rng.integers(0, 30))) for _ in range(n)), "x" * 5000, "the " * 3000, "日" * 3000]


def field(number, value):
    size, out = len(value), bytearray([number << 3 | 2])
    while size > 127:
        out.append(size & 127 | 128)
        size >>= 7
    return bytes(out) + bytes([size]) + value


def equal_to_library(path):
    model = pieces.Pieces(path)
    texts = mixed_texts()
    for t, (ids, spans) in zip(texts, model.encode(texts)):
        assert ids.tolist() == model.whole.encode(t, add_bos=True, add_eos=True)
        raw = t.encode()
        assert spans[0].tolist() == [0, 0] and spans[-1].tolist() == [len(raw)] * 2
        inner = spans[1:-1]
        assert (inner[:, 0] <= inner[:, 1]).all() and (np.diff(inner.astype(int), axis=0) >= 0).all()
    return model, texts


def test_op13_is_the_library(spark, data, texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r["doc_id"]: r for r in queries.op13_piece_round_trip(spark, data).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_op13_spans_are_the_librarys_surfaces():
    model, texts = equal_to_library(MODEL)
    for t, (_, spans) in zip(texts, model.encode(texts)):
        raw = t.encode()
        said = model.whole.encode(t, return_type="proto").pieces
        assert all(raw[a:b].decode() == p.surface for p, (a, b) in zip(said, spans[1:-1]) if not p.piece.startswith("<0x"))
        assert b"".join(raw[a:b] for a, b in spans[1:-1]) == raw


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("extra", [0, 1])
def test_op13_character_maps(tmp_path, rule, extra):
    """The library's own maps, put into the model: same normal forms, same ids, spans of whole source characters."""
    spec = dict(pieces._fields(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()))[3]
    path = tmp_path / "mapped.model"
    path.write_bytes(open(MODEL, "rb").read() + field(3, spec + bytes([3 << 3, 1, 4 << 3, extra, 5 << 3, 1])))
    model, texts = equal_to_library(str(path))
    for t in texts:
        form, start, end = model.normal(t)
        assert form == model.whole.normalize(t) and len(start) == len(form.encode()) == len(end)
    form, start, end = model.normal("aⅧb")
    assert form.lower() == "▁aviiib" and start.tolist()[3:] == [0, 1, 1, 1, 1, 4] and end.tolist()[3:] == [1, 4, 4, 4, 4, 5]


def test_op13_without_bytes(tmp_path):
    """A model that knows no bytes: runs of unknown characters are one piece."""
    data = open(MODEL, "rb").read()
    out = b""
    for number, value in pieces._fields(data):
        if number == 1 and dict(pieces._fields(value)).get(3) == 6:
            value += bytes([3 << 3, 5])
        out += field(number, value)
    path = tmp_path / "unknown.model"
    path.write_bytes(out + field(2, bytes([(35 << 3) & 127 | 128, 35 << 3 >> 7, 0])))
    model, texts = equal_to_library(str(path))
    for t, (_, spans) in zip(texts, model.encode(texts)):
        assert b"".join(t.encode()[a:b] for a, b in spans[1:-1]) == t.encode()


def test_op13_memo_does_not_change_results(monkeypatch):
    monkeypatch.setattr(pieces, "MEMO_SEGMENTS", 3)
    model = pieces.Pieces(MODEL)
    for t in mixed_texts(200):
        assert next(model.encode([t]))[0].tolist() == model.whole.encode(t, add_bos=True, add_eos=True)


def test_op13_odd_rows(odd, empty):
    rows = pieces.decode(pieces.encode(odd, MODEL), MODEL).collect()
    assert len(rows) == odd.count() and all(r["n_tokens"] == 2 and r["decoded"] == "" for r in rows if r["doc_id"] in (2, 3))
    assert pieces.decode(pieces.encode(empty, MODEL), MODEL).count() == 0

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from compare import differences, oracle
from pyspark.sql import functions as F

from framestack.llm import merkle, mixing, queries, simhash


def brute_fingerprint(text, width):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, bits=3):
    keys = sorted(prints)
    codes = np.array([prints[k] for k in keys], np.uint64)
    label = list(range(len(keys)))

    def find(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i in range(len(keys)):
        for j in np.flatnonzero(np.bitwise_count(codes[i:] ^ codes[i]) <= bits) + i:
            a, b = find(i), find(int(j))
            label[max(a, b)] = min(a, b)
    return {k: keys[find(i)] for i, k in enumerate(keys)}


def jaccard(a, b, width=5):
    one, two = (set(zip(*(t.lower().split()[i:] for i in range(width)))) for t in (a, b))
    return len(one & two) / max(1, len(one | two))


def test_near_copies_of_the_stage(spark):
    """Copies with a few words changed meet; texts that share less stay apart."""
    rng = np.random.default_rng(12)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(4000)]
    rows, want = [], {}
    for i in range(40):
        base = [words[j] for j in rng.integers(0, 4000, 300)]
        rows.append((3 * i, " ".join(base)))
        near, far = base[:], base[:]
        for j in rng.integers(0, 300, 4):
            near[j] = words[rng.integers(0, 4000)]
        for j in rng.integers(0, 300, 40):
            far[j] = words[rng.integers(0, 4000)]
        rows += [(3 * i + 1, " ".join(near)), (3 * i + 2, " ".join(far))]
        assert jaccard(rows[-3][1], rows[-2][1]) > 0.85 and jaccard(rows[-3][1], rows[-1][1]) < 0.6
        want |= {3 * i: 3 * i, 3 * i + 1: 3 * i, 3 * i + 2: 3 * i + 2}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_groups(df).collect()} == want


def test_op8_equals_brute_force(spark, data, texts):
    prints = {i: brute_fingerprint(t, 3) for i, t in texts.items()}
    want = brute_components(prints)
    got = queries.op8_simhash(spark, data).collect()
    assert len(got) == len(texts)
    for r in got:
        assert int(r["fingerprint"], 16) == prints[r["doc_id"]] and len(r["fingerprint"]) == 16
        assert r["component_id"] == want[r["doc_id"]]
    assert len(set(want.values())) < len(want)


@pytest.mark.parametrize("node_rows", [1 << 19, 40])
def test_links_of_dense_and_chained_groups(spark, node_rows):
    """One ball of many codes, chains, and strangers; small node_rows forces the splitting of hot nodes."""
    rng = np.random.default_rng(8)
    codes = {int(x) << 20 for x in rng.integers(0, 1 << 9, 150)}
    for _ in range(6):
        x = int(rng.integers(0, 1 << 62))
        for _ in range(12):
            codes.add(x)
            x ^= int(sum(1 << int(b) for b in rng.integers(0, 64, 3)))
    codes |= {int(x) for x in rng.integers(0, 1 << 62, 200)}
    want = brute_components({c: c for c in codes})
    signed = lambda c: c - (1 << 64) if c >> 63 else c
    df = spark.createDataFrame([(signed(c),) for c in codes], "fp long")
    labels = {r["fp"]: r["label"] for r in simhash.connected(simhash.links(df, 3, node_rows)).collect()}
    parts = defaultdict(set)
    for c in codes:
        parts[want[c]].add(labels.get(signed(c), signed(c)))
    assert all(len(p) == 1 for p in parts.values())
    assert len({next(iter(p)) for p in parts.values()}) == len(parts)


def test_op8_odd_rows(odd, empty):
    got = simhash.cluster(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[2]["fp"] == by[3]["fp"] == by[6]["fp"] == 0 and by[6]["component_id"] == 2
    assert by[5]["component_id"] == 1
    assert simhash.cluster(empty).count() == 0
    left = simhash.deduplicated(odd).collect()
    assert sorted(r["doc_id"] or 0 for r in left) == [0, 1, 2, 4, 7, 9, 10, 11] and set(left[0].asDict()) == set(odd.columns)
    assert simhash.deduplicated(empty).count() == 0


def test_op7_equals_sql(spark, data):
    got = queries.op7_merkle(spark, data).toPandas()
    assert differences(got, oracle(queries.OP7_SQL, data)) == ""
    assert (got["near_edited"] >= got["near_next"]).mean() > 0.95 and got["near_edited"].between(0, 1).all()


def test_op7_odd_rows(odd, empty, spark):
    got = merkle.compare(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["fingerprint"] == by[5]["fingerprint"] != by[7]["fingerprint"]
    assert by[2]["fingerprint"] == by[3]["fingerprint"] and by[3]["n_chars"] == 0 and by[3]["near_next"] == 1.0
    assert merkle.compare(empty).count() == 0
    one = merkle.compare(spark.createDataFrame([(4, "a b c. d e f.")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0


def test_next_rows_over_many_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1009).alias("doc_id"), F.concat(F.lit("t"), (F.col("id") * 7 % 1009).cast("string")).alias("text"))
    ids = sorted((r[0] for r in df.select("doc_id").collect()), reverse=True)
    want = {i: f"t{ids[(n + 1) % len(ids)]}" for n, i in enumerate(ids)}
    assert {r["doc_id"]: r["next_text"] for r in merkle.neighbours(df).collect()} == want


def test_places_among_many_cuts(spark):
    cuts = list(range(5, 3000, 7))
    got = spark.range(0, 3100, 3).select("id", merkle._below(cuts, F.col("id")).alias("n")).collect()
    assert all(r["n"] == sum(c < r["id"] for c in cuts) for r in got)


def test_edits_are_located(spark):
    df = spark.createDataFrame([("a\nb\n\nc", "a\nx\n\nc"), ("a", "a\n\nnew"), ("a", "a")], "t string, u string")
    got = [[(e["section"], e["paragraph"]) for e in r["edits"]] for r in merkle.edits(df, "t", "u").collect()]
    assert got == [[(0, 1)], [(1, 0)], []]


def test_op9_weights_and_budget(spark, data, docs):
    got = queries.op9_temperature_mix(spark, data).collect()
    assert len(got) == docs.count() and all(r["copies"] >= 1 for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
    size = {s: sum(r["tokens"] for r in rs) for s, rs in by.items()}
    used = {s: sum(r["tokens"] * r["copies"] for r in rs) for s, rs in by.items()}
    total = sum(max(size[s] / r[0]["weight"] for s, r in by.items()) * r[0]["weight"] for r in by.values())
    for s, rs in by.items():
        target = rs[0]["weight"] * total
        largest = max(r["tokens"] for r in rs)
        assert target - largest - 1 <= used[s] <= target + 1 and used[s] <= mixing.MAX_EPOCHS * size[s] + 1


@pytest.mark.parametrize("sizes", [[100, 10, 1], [5, 5, 5], [1000, 1]])
def test_exponent_meets_its_targets(spark, sizes):
    s = spark.createDataFrame([(str(i), n) for i, n in enumerate(sizes)], "source string, tokens long")
    p = np.array(sizes, float)
    weights = lambda e: p**e / (p**e).sum()
    epochs = lambda e: (weights(e) / p).max() / (weights(e) / p).min()
    e = mixing.exponent(s, 4.0)
    assert 0 <= e <= 1 and epochs(e) <= 4 + 1e-6 and (e == 0 or epochs(max(0, e - 1e-4)) > 4 or max(sizes) == min(sizes))
    bits = lambda e: -(weights(e) * np.log2(weights(e))).sum()
    want = (bits(0.0) + bits(1.0)) / 2
    e = mixing.exponent(s, entropy=want)
    assert bits(e) >= want - 1e-6


def test_small_blocks_are_split_exactly(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 64)
    rows = [(i, " ".join(["w"] * (1 + i % 9)), "big" if i % 3 else "small") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, max_epochs=1.5).collect()
    used, size, blocks = Counter(), Counter(), defaultdict(set)
    for r in got:
        used[r["source"]] += r["tokens"] * r["copies"]
        size[r["source"]] += r["tokens"]
        blocks[r["source"]].add(r["block"])
    assert used["big"] == size["big"] and 1.5 * size["small"] - 9 <= used["small"] <= 1.5 * size["small"]
    assert len(blocks["small"]) > 10
    again = mixing.repeated(df, max_epochs=1.5)
    assert again.columns == df.columns and again.groupBy("source").count().collect()
    assert Counter(r["doc_id"] for r in again.collect()) == Counter({r["doc_id"]: r["copies"] for r in got})


def test_op9_odd_rows(odd, empty):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count() and {r["source"] for r in got} == {None, "s"} and all(r["copies"] >= 1 for r in got)
    assert mixing.mix(empty).count() == 0 and mixing.repeated(empty).count() == 0
    assert set(mixing.repeated(odd).columns) == set(odd.columns)


def exact_groups(texts, width=5):
    """Parts of the graph of all pairs whose sets of shingles are alike to 0.8, by comparing all pairs."""
    keys = sorted(texts)
    sets = []
    for k in keys:
        words = (texts[k] or "").lower().split()
        sets.append(set(zip(*(words[i:] for i in range(width)))) or {tuple(words)})
    label = list(range(len(keys)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if 5 * shared >= 4 * (len(sets[i]) + len(sets[j]) - shared):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return {k: keys[find(i)] for i, k in enumerate(keys)}


def family(rng, members, changed, words=200):
    """Texts that each change some of the same base's words."""
    base = [f"w{x}" for x in rng.integers(0, 9999, words)]
    out = []
    for _ in range(members):
        one = base[:]
        for j in rng.choice(words, changed, replace=False):
            one[j] = f"c{rng.integers(0, 1 << 40)}"
        out.append(one)
    return out


def test_links_of_large_families_are_not_lost(spark):
    """A family whose members are alike to about 0.7 only, but for pairs of members at about 0.85."""
    rng = np.random.default_rng(3)
    texts = family(rng, 60, 7)
    for one in texts[:30]:
        near = one[:]
        for j in rng.choice(195, 3, replace=False):
            near[j] = "n%d" % rng.integers(0, 1 << 40)
        texts.append(near)
    texts = {i: " ".join(t) for i, t in enumerate(texts)}
    want = exact_groups(texts)
    assert 25 < sum(want[60 + i] == i for i in range(30)) and len(set(want.values())) > 30
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_groups(df).collect()} == want


def test_pairs_just_above_and_below_the_least_similarity(spark):
    """Of 300 pairs at 0.74 to 0.86 exactly those at 0.8 or more are linked."""
    rng = np.random.default_rng(4)
    texts, above = {}, 0
    for i in range(300):
        base = family(rng, 1, 0, 300)[0]
        near = base[:]
        cut = int(rng.integers(23, 45))
        near[100 : 100 + cut] = [f"n{x}" for x in rng.integers(0, 1 << 40, cut)]
        texts |= {2 * i: " ".join(base), 2 * i + 1: " ".join(near)}
        above += 0.8 <= jaccard(texts[2 * i], texts[2 * i + 1]) < 0.85
    want = exact_groups(texts)
    assert above > 50 and 50 < sum(want[2 * i + 1] == 2 * i for i in range(300)) < 250
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_groups(df).collect()} == want


def test_different_texts_of_one_or_no_key_stay(spark):
    rows = [(None, "one text without a key"), (None, "and yet another text"), (None, "one text without a key"), (7, "seven is here"), (7, "seven is not here"), (8, "seven is here")]
    left = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["text"]) for r in left) == Counter({rows[0], rows[1], rows[3], rows[4]})


def test_fingerprint_filter_loses_no_pair_at_the_threshold():
    """20,000 pairs of sets with a similarity from 0.80 to 0.85, of FILTER_FROM to 600 shingles: none differs in over FAR bits.

    A bit of a pair at 0.8 differs with probability 0.152, so FAR of 128 lies six standard deviations out.
    """
    rng = np.random.default_rng(45)
    most = 0
    for _ in range(20_000):
        n = int(rng.integers(simhash.FILTER_FROM, 600))
        shared = -(-8 * n // 9) + int(rng.integers(0, max(1, n // 40)))  # two sets of n with so many in common
        pool = rng.integers(0, 1 << 63, 2 * n - shared, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 2 * n - shared, dtype=np.uint64)
        a, b = pool[:n], np.concatenate([pool[:shared], pool[n:]])
        assert 0.8 <= shared / (2 * n - shared) <= 0.87
        bits = np.bitwise_count(simhash.set_prints(a).view(np.uint64) ^ simhash.set_prints(b).view(np.uint64)).sum()
        most = max(most, int(bits))
    assert most <= simhash.FAR


def test_prefixes_meet_within_the_positional_bound():
    """Sets that are alike share a prefix shingle, and at the first one they share the bound on what may follow holds."""
    rng = np.random.default_rng(46)
    counts = rng.integers(0, 256, 1 << 10).astype(np.uint8)
    order = lambda h: sorted(h.tolist(), key=lambda x: (counts[x >> 54], x))
    for _ in range(3000):
        n, m = (int(x) for x in rng.integers(1, 120, 2))
        pool = np.unique(rng.integers(0, 1 << 63, 240, dtype=np.uint64) * np.uint64(2))
        rng.shuffle(pool)
        k = int(rng.integers(max(0, min(n, m) - 12), min(n, m) + 1))
        a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:k], pool[n : n + m - k]]))
        if k * 5 < (n + m - k) * 4:
            continue
        pa, pb = simhash.prefix(a, counts).tolist(), simhash.prefix(b, counts).tolist()
        assert pa == order(a)[: len(pa)]
        first = next(t for t in pa if t in set(pb))
        assert min(n - pa.index(first), m - pb.index(first)) * 9 >= (n + m) * 4

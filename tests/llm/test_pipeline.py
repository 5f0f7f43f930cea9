from collections import Counter

import corpus_pipeline
import public_tokenizers as P
from test_groups import exact_groups

from framestack.llm import bpe, mixing, queries, secret_scan, toxicity


def test_run_equals_the_stages_done_by_hand(spark, data, docs, texts):
    out = corpus_pipeline.run(spark, data)
    got = Counter((r["doc_id"], r["n_tokens"]) for r in out.collect())
    model = toxicity.train(*toxicity.sample(docs, spark.read.parquet(f"{data}/labels.parquet")))
    score = model.scores([toxicity.word_hashes(t) for t in texts.values()])[0]
    clean = {i: t for (i, t), s in zip(texts.items(), score) if s < toxicity.CUT}
    group = exact_groups(clean)
    kept = {i: t for i, t in clean.items() if group[i] == i}
    forest = secret_scan.trained(spark.createDataFrame(list(kept.items()), "doc_id long, text string"))
    for i, t in kept.items():
        for f in reversed(secret_scan.scan_text([t], forest, secret_scan.THRESHOLD)[0]):
            t = t[: f["start"]] + secret_scan.MASK + t[f["end"] :]
        kept[i] = t
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    rows = spark.createDataFrame([(i, t, source[i]) for i, t in kept.items()], "doc_id long, text string, source string")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(rows).collect()}
    enc = bpe.encoding(P.path(queries.RANKS), P.PATTERN)
    assert got == Counter({(i, len(enc.encode_ordinary(t))): copies[i] for i, t in kept.items()})
    assert 0 < len(kept) < len(texts)


def test_stages_keep_the_columns_and_odd_rows(spark, data, odd, empty):
    for name, stage in corpus_pipeline.STAGES:
        for df in (odd, empty):
            got = stage(spark, df.select(*corpus_pipeline.COLUMNS), data)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert got.columns == list(corpus_pipeline.COLUMNS)
            n, there = got.count(), df.count()
            if not there:
                assert n == 0
            else:
                low, high = {"toxicity": (1, there), "simhash_dedup": (8, 8), "secret_scan": (there, there), "temperature_mix": (there, 2 * there), "bpe_encode": (there, there)}[name]
                assert low <= n <= high, name

"""The registered query of each operator: production parameters, whole tables, and the SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, dac, langid, merkle, mixing, mjpeg, pieces, quality, secret_scan, simhash, toxicity, vectors
from .common import key_crc, stored, table

RANKS = "byte_bpe_multi_50k.tiktoken"
WORDS = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"
END_ID = 2


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    encoded = bpe.encode(table(spark, sf_dir, "documents"), path, pattern)
    decoded = bpe.decode(encoded, path, pattern)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs, secret_scan.trained(docs))
    spans = F.array_join(F.transform("findings", lambda f: F.concat_ws("-", f["start"], f["end"])), ",")
    counted = found.withColumns({"n_findings": F.size("findings"), "spans": spans})
    return secret_scan.redact(counted).select("doc_id", "n_findings", "spans", F.sha2("text", 256).alias("redacted_sha256"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = dac.write(table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS), END_ID)
    return dac.read(segments).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_media_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = mjpeg.unpack(mjpeg.pack(table(spark, sf_dir, "documents")))
    clip = lambda c: F.concat(F.concat_ws("-", c["first"], c["after"]), F.lit("@"), F.concat_ws("-", c["start_ms"].cast("long"), c["end_ms"].cast("long")))
    return media.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.col("frames").cast("string"), F.lit(":"), F.array_join(F.transform("clips", clip), ",")).alias("feature"),
    )


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.pmod(key_crc(), F.lit(5)) == 0, F.lit(True))
    dictionaries = langid.train(docs.where(~held).select("doc_id", "text", "lang"))
    said = langid.classify(docs, dictionaries)
    return said.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.pmod(key_crc(), F.lit(3)) == 1, F.lit(True))
    model = toxicity.train(*toxicity.sample(docs, table(spark, sf_dir, "labels").where(~held)))
    said = toxicity.classify(docs, model)
    return said.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"), "threshold")


def op7_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare(table(spark, sf_dir, "documents"))


_LEAVES = r"list_transform(list_filter(string_split(regexp_replace(p, '(([^\p{{L}}\p{{N}} \t\n\r\f]|[aeoynst])[ \t\n\r\f]+)', '\1' || chr(31), 'g'), chr(31)), lambda c: c <> ''), lambda c: md5(c))"
_TREE = "list_transform(string_split(replace(replace({}, chr(30), chr(30) || '0'), chr(31), chr(30) || '1'), E'\\n\\n'), lambda s: list_transform(string_split(s, E'\\n'), lambda p: " + _LEAVES + "))"
_ROOT = "sha256('root:' || array_to_string(list_transform({}, lambda s: sha256('section:' || array_to_string(list_transform(s, lambda p: sha256(array_to_string(p, ''))), ''))), ''))"
_SET = "list_distinct(flatten(flatten({})))"
OP7_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS next_text FROM d),
e AS (SELECT *, length(text) AS n_chars, left(text, length(text) - length(text) // 3) || left(next_text, length(text) // 3) AS edited FROM n),
t AS (SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, {_TREE.format("text")} AS t, {_TREE.format("edited")} AS te, {_TREE.format("next_text")} AS tn FROM e),
r AS (
  SELECT doc_id, n_chars, edited_sha256, {_ROOT.format("t")} AS fingerprint, {_ROOT.format("te")} AS edited_fingerprint, {_ROOT.format("tn")} AS next_fingerprint,
    {_SET.format("t")} AS c, {_SET.format("te")} AS ce, {_SET.format("tn")} AS cn FROM t),
s AS (SELECT *, len(list_intersect(c, ce)) AS be, len(list_intersect(c, cn)) AS bn FROM r)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
  CASE WHEN len(c) + len(ce) > be THEN be::DOUBLE / (len(c) + len(ce) - be) ELSE (fingerprint = edited_fingerprint)::INT::DOUBLE END AS near_edited,
  CASE WHEN len(c) + len(cn) > bn THEN bn::DOUBLE / (len(c) + len(cn) - bn) ELSE (fingerprint = next_fingerprint)::INT::DOUBLE END AS near_next
FROM s
"""


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.cluster(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.pmod(key_crc(), F.lit(3)) == 1, F.lit(True))
    rows = stored(quality.features(docs), "features")
    labels = table(spark, sf_dir, "labels").where(~held).select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(rows.join(labels, "doc_id"))
    said = quality.score(rows, model)
    return said.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.trie(conversations.rebuilt(table(spark, sf_dir, "conversations"))).drop("node", "parent")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.kept(table(spark, sf_dir, "embeddings"))
    codebooks = vectors.train(rows)
    coded = vectors.encode(rows, codebooks).withColumn("codebooks_sha256", F.lit(codebooks.sha256()))
    return vectors.with_label_error(coded).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(PIECES)
    decoded = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), path), path)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.sha2("spans", 256).alias("spans_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = (op1_bpe_round_trip, op2_secret_scan, op3_token_files, op4_media_clips, op5_language, op6_toxicity, op7_merkle, op8_simhash, op9_temperature_mix, op10_quality, op11_prefix_trie, op12_vector_codes, op13_piece_round_trip, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op7_merkle": OP7_SQL}

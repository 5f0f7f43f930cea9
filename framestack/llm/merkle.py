"""Document fingerprints: a Merkle tree over clauses, paragraphs and sections, in DataFrame functions only.

A blank line parts sections, a line end parts paragraphs, and a clause ends behind a mark, or a word that
ends in one of a few letters, and its blanks.  Clauses are the tree's leaves, with their MD5; a paragraph's
digest is the SHA-256 of its clauses' digests, a section's that of its paragraphs', and the root that of the
sections'.  So equal roots mean equal texts, and differing digests locate edits.  The likeness of two trees is
the share of leaves they have in common (Jaccard of the leaf digests that their roots are made of).

Null texts count as empty; an empty text has one empty paragraph without clauses, and two texts without
clauses are alike if their roots are.  Repeated rows stay; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions

#: A clause ends at the blanks behind a character that is no letter or digit, or behind one of these letters.
CLAUSE_END = r"(([^\p{L}\p{N} \t\n\r\f]|[aeoynst])[ \t\n\r\f]+)"
#: Key ranges for each shuffle partition in neighbours().
RANGES = 4


def tree(text: Column) -> Column:
    """Sections, each an array of paragraphs, each an array of clause digests; every character is in one clause.

    The unit separator ends a clause here, so one in the text is written otherwise first.
    """
    text = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\x1e"), F.lit("\x1e0")), F.lit("\x1f"), F.lit("\x1e1"))
    leaves = lambda p: F.transform(F.filter(F.split(F.regexp_replace(p, CLAUSE_END, "$1\x1f"), "\x1f", -1), lambda c: c != ""), lambda c: F.md5(c))
    return F.transform(F.split(text, "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), leaves))


def paragraph_digests(tree: Column) -> Column:
    """Array of sections, each an array of paragraph digests (hex)."""
    return F.transform(tree, lambda s: F.transform(s, lambda p: F.sha2(F.array_join(p, ""), 256)))


def section_digests(tree: Column) -> Column:
    return F.transform(paragraph_digests(tree), lambda s: F.sha2(F.concat(F.lit("section:"), F.array_join(s, "")), 256))


def root(tree: Column) -> Column:
    return F.sha2(F.concat(F.lit("root:"), F.array_join(section_digests(tree), "")), 256)


def leaves(tree: Column) -> Column:
    """Distinct clause digests."""
    return F.array_distinct(F.flatten(F.flatten(tree)))


def likeness(a: Column, b: Column, root_a: Column, root_b: Column) -> Column:
    """Jaccard of two arrays of distinct digests; of two empty ones, whether the roots are equal."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise((root_a == root_b).cast("double"))


def edits(df: DataFrame, text: str, other: str) -> DataFrame:
    """df with `edits`: the (section, paragraph) places whose digests differ between the columns text and other."""
    a, b = paragraph_digests(tree(F.col(text))), paragraph_digests(tree(F.col(other)))
    count = F.greatest(F.size(a), F.size(b))
    differing = F.flatten(
        F.transform(
            F.sequence(F.lit(0), count - 1),
            lambda i: F.when(
                ~F.get(a, i).eqNullSafe(F.get(b, i)),
                F.filter(
                    F.transform(
                        F.sequence(F.lit(0), F.greatest(F.size(F.coalesce(F.get(a, i), F.array())), F.size(F.coalesce(F.get(b, i), F.array()))) - 1),
                        lambda j: F.when(~F.get(F.get(a, i), j).eqNullSafe(F.get(F.get(b, i), j)), F.struct(i.alias("section"), j.alias("paragraph"))),
                    ),
                    lambda x: x.isNotNull(),
                ),
            ).otherwise(F.array().cast("array<struct<section:int,paragraph:int>>")),
        )
    )
    return df.withColumn("edits", differing)


def _below(cuts: list[int], key: Column, step: int = 128) -> Column:
    """How many of the ascending cuts lie below the key: first by every step-th of them, then within one step."""
    if not cuts:
        return F.lit(0)
    count = lambda a: F.size(F.filter(a, lambda c: c < key))
    coarse = cuts[step - 1 :: step]
    at = count(F.lit(np.array(coarse, np.int64))) * step if coarse else F.lit(0)
    return at + count(F.slice(F.lit(np.array(cuts, np.int64)), at + 1, F.lit(step)))


def neighbours(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, next_text): next is the row before in ascending key order, the largest for the smallest key.

    Rows are cut into key ranges of about equal size; each range also gets the top row of the range
    below it (the lowest range: of the highest), so the text is shuffled once and no task sees more
    than its ranges.  Rows with equal keys follow each other in order of their texts; a null key sorts first.
    """
    n = RANGES * partitions(df.sparkSession)
    rows = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    cuts = rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 10_000).alias("cuts")).first()["cuts"] or []
    place = F.when(F.col("key").isNull(), F.lit(-1)).otherwise(_below(sorted(set(cuts)), F.col("key"))).alias("range")
    tops = rows.select("key", place).groupBy("range").agg(F.max("key").alias("top"))
    order = Window.orderBy("range")  # a row a range
    tops = tops.select("top", F.col("range").alias("own"), F.lead("range").over(order).alias("above"), F.first("range").over(order).alias("lowest"))
    tops = tops.select(F.col("top").alias("key"), F.col("own").alias("range"), F.coalesce("above", "lowest").alias("also"))
    placed = rows.select("key", "text", place)
    copied = placed.join(F.broadcast(tops), placed["key"].eqNullSafe(tops["key"]) & (placed["range"] == tops["range"]), "left").select(
        placed["key"], "text", placed["range"], "also"
    )
    both = copied.select(
        "key",
        "text",
        F.explode(F.when(F.col("also").isNull(), F.array(F.struct(F.col("range"), F.lit(False).alias("copy")))).otherwise(F.array(F.struct(F.col("range"), F.lit(False).alias("copy")), F.struct(F.col("also").alias("range"), F.lit(True).alias("copy"))))).alias("at"),
    ).select("key", "text", "at.*")
    falling = Window.partitionBy("range").orderBy("copy", F.col("key").desc_nulls_last(), F.xxhash64("text"))
    after = F.lead("text").over(falling)
    return both.select("key", "text", "copy", after.alias("next_text")).where(~F.col("copy")).select(F.col("key").alias(key), "text", "next_text")


def with_edited(pairs: DataFrame) -> DataFrame:
    """pairs with n_chars and edited_text: the last third of the text replaced by as much of the next one's start."""
    third = F.floor(F.length("text") / 3).cast("int")
    n = F.length("text")
    return pairs.withColumn("n_chars", n.cast("long")).withColumn("edited_text", F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third)))


def compare(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and its edited form, and their likenesses; see the module's top for the cases."""
    trees = with_edited(neighbours(df, key, text)).select(
        key,
        "n_chars",
        F.sha2("edited_text", 256).alias("edited_sha256"),
        tree(F.col("text")).alias("t"),
        tree(F.col("edited_text")).alias("te"),
        tree(F.col("next_text")).alias("tn"),
    )
    rows = trees.select(
        key,
        "n_chars",
        "edited_sha256",
        root(F.col("t")).alias("fingerprint"),
        root(F.col("te")).alias("edited_fingerprint"),
        root(F.col("tn")).alias("next_fingerprint"),
        leaves(F.col("t")).alias("c"),
        leaves(F.col("te")).alias("ce"),
        leaves(F.col("tn")).alias("cn"),
    )
    return rows.select(
        key,
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("c"), F.col("ce"), F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("c"), F.col("cn"), F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )

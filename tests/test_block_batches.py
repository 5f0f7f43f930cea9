"""Blocks come to Python in batches of bounded bytes."""

import pyarrow as pa

from framestack.operators import blocks


def test_batches_of_blocks_are_bounded_by_bytes(spark):
    held = spark.range(1500).selectExpr("0 AS by", "CAST(id AS INT) AS bx", "1 AS f", "CAST(repeat('a', 32768) AS BINARY) AS data").coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    blocks.to_pixels(held, ["f"], 64)
    most = max(r.n for r in held.mapInArrow(sizes, "n long").collect())
    assert most * 32768 <= 20 << 20

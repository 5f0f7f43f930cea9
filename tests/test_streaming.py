import datetime as dt

import pytest

from framestack.streaming import nights

SCHEMA = "k string, ts timestamp, value double, digest string"
T = dt.datetime(2024, 1, 1, 20, 0, 0)


def at(hours):
    return T + dt.timedelta(hours=hours)


@pytest.fixture
def run(spark, tmp_path):
    def go(batches, make):
        src = tmp_path / "in"
        src.mkdir(exist_ok=True)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(src))
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
        name = f"out{abs(hash(str(tmp_path))) % 10**9}"
        q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return spark.table(name).collect()

    return go


def test_nights_close_behind_the_watermark(run):
    rows = [[("a", at(0), 1.0, "x"), ("a", at(5), 3.0, "y")], [("a", at(90), 9.0, "z")], [("a", at(91), 9.0, "z")]]
    got = run(rows, lambda s: nights.night_statistics(s, ["k"], "ts", "value"))
    assert [(str(r["night"]), r["n"], r["mean"]) for r in got] == [("2024-01-01", 2, 2.0)]


def test_gap_blocks_split_only_on_longer_gaps(run):
    rows = [[("a", at(0), 1.0, ""), ("a", at(2), 1.0, ""), ("a", at(4.5), 1.0, "")], [("a", at(100), 1.0, "")], [("a", at(101), 1.0, "")]]
    got = sorted((r["block"], r["n"]) for r in run(rows, lambda s: nights.gap_blocks(s, "k", "ts")))
    assert got == [(0, 2), (1, 1)]


def test_sessions_and_duplicates(run):
    rows = [[("a", at(0), 1.0, "x"), ("a", at(1), 1.0, "x"), ("b", at(0), 1.0, "y")], [("a", at(99), 1.0, "q")], [("a", at(99.5), 1.0, "q")]]
    got = run(rows, lambda s: nights.first_copies(s, "digest", "ts"))
    assert sorted(r["digest"] for r in got) == ["q", "x", "y"]


def test_session_windows(run):
    rows = [[("a", at(0), 1.0, "x"), ("a", at(1), 1.0, "x")], [("a", at(99), 1.0, "q")], [("a", at(99.5), 1.0, "q")]]
    got = run(rows, lambda s: nights.sessions(s, ["k"], "ts"))
    assert [r["n"] for r in got] == [2]


def test_sliding_counts(run):
    rows = [[("a", at(0), 1.0, "x")], [("a", at(99), 1.0, "q")], [("a", at(99.5), 1.0, "q")]]
    assert sum(r["n"] for r in run(rows, lambda s: nights.sliding_counts(s, ["k"], "ts"))) == 2


def test_batch_writer_sees_touched_nights(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", at(0), 1.0, "x"), ("a", at(30), 1.0, "y")], SCHEMA).write.parquet(src)
    seen = []
    q = nights.baselines_by_night(spark.readStream.schema(SCHEMA).parquet(src), lambda n, i: seen.extend(str(r[0]) for r in n.orderBy("night").collect())).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert seen == ["2024-01-01", "2024-01-02"]


def test_sums_follow_the_stream(spark, tmp_path):
    """After every batch the sums are those of all frames so far; a batch that runs twice counts once."""
    from framestack.streaming import sums

    source, out, schema = tmp_path / "in", f"file://{tmp_path}/sums", "band string, cell int, v double"
    rng = __import__("numpy").random.default_rng(8)
    rows = []

    def arrive(k):
        new = [("R" if i % 3 else None, i % 5, float(1e6 + rng.normal(0, 1)) if i % 7 else (None if i % 2 else float("nan"))) for i in range(40 + k)]
        rows.extend(new)
        spark.createDataFrame(new, schema).coalesce(1).write.parquet(str(source / f"frame{k}"))

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{source}/*")
        sums.accumulate(stream, ["band", "cell"], "v", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()

    def same():
        got = {(r.band, r.cell): r for r in sums.accumulated(spark, out, ["band", "cell"]).collect()}
        held = {}
        for band, cell, v in rows:
            if v is not None and v == v:
                held.setdefault((band, cell), []).append(v)
        assert got.keys() == held.keys()
        for k, v in held.items():
            m = sum(v) / len(v)
            assert got[k].n == len(v) and abs(got[k]["mean"] - m) < 1e-6 and (got[k].low, got[k].high) == (min(v), max(v))
            assert abs(got[k].variance - sum((a - m) ** 2 for a in v) / len(v)) < 1e-6

    for k in range(3):
        arrive(k)
        run()
        same()
    last = spark.createDataFrame(rows[-42:], schema)
    sums.partial_sums(last, ["band", "cell"], "v").write.mode("overwrite").parquet(f"{out}/batch=2")
    same()

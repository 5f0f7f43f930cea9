import json

import numpy as np
import pytest

from framestack.operators import stack, tiles
from framestack.sources import fits, frames, records, xisf


@pytest.fixture
def image():
    v = np.random.default_rng(1).normal(100, 5, (100, 40)).astype(np.float32)
    v[3, 4] = np.nan
    return v


def test_fits_round_trip(spark, tmp_path, image):
    (tmp_path / "a.fits").write_bytes(fits.encode(image, {"FILTER": "L", "EXPTIME": 60.0, "OBJECT": "it's"}))
    (tmp_path / "bad.fits").write_bytes(b"nothing")
    (tmp_path / ".hidden.fits").write_bytes(b"")
    heads = {r["path"].rsplit("/")[-1]: r for r in fits.headers(spark, str(tmp_path)).collect()}
    assert heads["a.fits"]["header"]["FILTER"] == "L" and heads["a.fits"]["header"]["OBJECT"] == "it's" and heads["a.fits"]["height"] == 100
    assert heads["bad.fits"]["error"] and heads["bad.fits"]["header"] is None
    assert sorted(r["path"].rsplit("/")[-1] for r in fits.discover(spark, str(tmp_path)).collect()) == ["a.fits", "bad.fits"]
    t = fits.tiles(spark, str(tmp_path), rows=32)
    assert t.count() == 4
    got = fits.samples(t, ["path"]).toPandas()
    assert len(got) == 4000 and got["value"].isna().sum() == 1
    content = fits.files(t, ["path"]).first()["content"]
    assert np.array_equal(fits.decode_rows(content), image, equal_nan=True)
    assert np.array_equal(fits.decode_rows(content, 10, 12), image[10:12])


def test_fits_integers_with_zero_and_blank():
    head = b"".join(f"{k:<8}= {v:>20}".ljust(80).encode() for k, v in (("SIMPLE", "T"), ("BITPIX", 16), ("NAXIS", 2), ("NAXIS1", 3), ("NAXIS2", 1), ("BZERO", 32768), ("BLANK", -32768))) + b"END".ljust(80)
    raw = head.ljust(2880) + np.array([-32768, -32767, 5], ">i2").tobytes().ljust(2880, b"\0")
    got = fits.decode_rows(raw)[0]
    assert np.isnan(got[0]) and got[1:].tolist() == [1.0, 32773.0]


@pytest.mark.parametrize("compression", [None, "zlib", "zlib+sh", "lz4+sh", "zstd"])
def test_xisf_round_trip(spark, tmp_path, compression):
    v = np.random.default_rng(2).integers(0, 60000, (2, 70, 30)).astype(np.uint16)
    (tmp_path / "a.xisf").write_bytes(xisf.build(v, {"FILTER": "R"}, compression))
    words, got = xisf.image((tmp_path / "a.xisf").read_bytes())
    assert words["FILTER"] == "R" and np.array_equal(got, v)
    if compression == "zlib+sh":
        row = xisf.headers(spark, str(tmp_path)).first()
        assert (row["width"], row["height"], row["bitpix"]) == (30, 70, 16)
        assert fits.samples(xisf.tiles(spark, str(tmp_path)), ["path"]).count() == 2100


def test_xisf_refuses_declarations():
    xml = b'<!DOCTYPE a [<!ENTITY b "c">]><xisf/>'
    with pytest.raises(ValueError):
        xisf.parse(b"XISF0100" + len(xml).to_bytes(4, "little") + bytes(4) + xml)


def test_tile_stack_equals_the_sql_form(spark):
    rng = np.random.default_rng(3)
    frames = rng.normal(10, 1, (7, 4, 5)).astype(np.float32)
    frames[0, 0, 0], frames[1, 1, 1] = 1e4, np.nan
    rows = [(f, 0, 4, 5, bytearray(frames[f].astype("<f4").tobytes()), float(f + 1), 0) for f in range(7)]
    t = spark.createDataFrame(rows, "frame int, y0 int, rows int, width int, data binary, w double, g int")
    out = tiles.stack_tiles(t, ["g"], "frame", "w").first()
    mean = np.frombuffer(out["data"], "<f4").reshape(4, 5)
    s = fits.samples(t, ["frame", "w"])
    want = {(r["y"], r["x"]): r for r in stack.clip_mean(s, ["y", "x"], "value", "w").collect()}
    for (y, x), r in want.items():
        assert abs(mean[y, x] - r["mean"]) < 1e-4
        assert np.frombuffer(out["accepted"], "<u4").reshape(4, 5)[y, x] == r["n_accepted"]
    assert want[0, 0]["n_rejected"] == 1 and want[1, 1]["n"] == 6


def test_image_helpers():
    flat = np.tile([[0.5, 1.0], [1.0, 2.0]], (4, 4)).astype(np.float32)
    assert np.allclose(tiles.calibrate(flat * 100 + 7, None, np.full_like(flat, 7), flat), 100)
    assert np.allclose(tiles.debayer(np.full((6, 6), 3.0, np.float32)), 3)
    dark = np.random.default_rng(4).normal(0, 1, (20, 20))
    dark[5, 6] = 100
    mask = tiles.hot_pixels(dark, 8)
    assert mask.sum() == 1 and abs(tiles.repaired(dark, mask)[5, 6]) < 3
    smooth = np.add.outer(np.arange(30.0), np.arange(30.0) * 2).astype(np.float32)
    shift = np.array([[1, 0, 0.5], [0, 1, 0.25], [0, 0, 1]])
    got = tiles.warp(smooth, shift, (30, 30))
    assert np.allclose(got[5:20, 5:20], smooth[5:20, 5:20] + 1.25, atol=0.05)
    assert np.allclose(tiles.warp(smooth, np.eye(3), (30, 30)), smooth, atol=1e-5)
    sky = np.random.default_rng(5).normal(0, 1, (64, 64))
    sky[np.arange(64), np.arange(64)] += 4
    angle, distance, z = tiles.radon_peaks(sky)[0]
    assert abs(angle - 3 * np.pi / 4) < 0.05 and abs(distance) < 3
    y, x = np.mgrid[:64, :64]
    stars = np.random.default_rng(6).normal(0, 0.5, (64, 64)) + 200 * np.exp(-((x - 20.3) ** 2 + (y - 30.6) ** 2) / 4)
    found = tiles.detect_sources(stars)
    assert abs(found[0, 0] - 20.3) < 0.2 and abs(found[0, 1] - 30.6) < 0.2


def test_decisions_and_measurements(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"schemaVersion": 1, "kind": "k", "undecided": "DROP", "decisions": [{"sourceSha256": "a", "decision": "KEEP"}, {"sourceSha256": "b", "decision": "MAYBE"}, {"decision": "KEEP"}]}))
    d = records.decisions(spark, str(tmp_path / "d.json"))
    assert {r["sourceSha256"]: r["error"] for r in d.collect()} == {"a": None, "b": "unknown decision", None: "no digest"}
    assets = spark.createDataFrame([("a",), ("b",), ("c",)], "sha256 string")
    assert {r[0]: r[1] for r in records.decided(assets, d).collect()} == {"a": "KEEP", "b": "DROP", "c": "DROP"}
    both = spark.createDataFrame([("a", "KEEP", None), ("a", "DROP", None), ("b", "KEEP", None)], "sourceSha256 string, decision string, error string")
    assert {r[0]: r[1] for r in records.decided(assets, both).collect()} == {"a": "CONFLICT", "b": "KEEP", "c": "ERROR"}
    (tmp_path / "m.json").write_text(json.dumps({"columns": ["path", "fwhm"], "rows": [["x", "2.5"], ["y", "wide"], ["z", None]]}))
    rows = {r["path"]: r for r in records.measurement_table(spark, str(tmp_path / "m.json"), {"path": "string", "fwhm": "double"}).collect()}
    assert rows["x"]["fwhm"] == 2.5 and rows["y"]["bad"] == 1 and rows["z"]["bad"] == 0


def test_cone_reads_only_its_zones(spark, tmp_path):
    rng = np.random.default_rng(7)
    stars = spark.createDataFrame([(float(a), float(d), float(f)) for a, d, f in zip(rng.uniform(0, 360, 500), rng.uniform(-80, 80, 500), rng.uniform(1, 9, 500))], "ra double, dec double, flux double")
    records.by_sky_cell(stars, str(tmp_path / "stars"))
    read = spark.read.parquet(str(tmp_path / "stars"))
    got = records.cone(read, 100.0, 20.0, 15.0, "flux", 5).collect()
    assert len(got) == 5 and all(r["separation"] <= 15 for r in got) and got[0]["flux"] == max(r["flux"] for r in got)


@pytest.mark.parametrize("whole", [False, True])
def test_headers_rows_and_previews_of_a_mixed_folder(spark, tmp_path, image, whole, monkeypatch):
    """By seeking, and by whole files as where Arrow can't seek; endings in any case, blanks in names."""
    if whole:
        monkeypatch.setattr(fits, "seekable", lambda path: False)
    data = fits.encode(image, {"FILTER": "L"})
    (tmp_path / "a b.FiTs").write_bytes(data)
    (tmp_path / "head.fit").write_bytes(data[:2880])
    (tmp_path / "cfa.fits").write_bytes(fits.encode(image, {"BAYERPAT": "RGGB"}))
    (tmp_path / "bad.fits").write_bytes(b"nothing")
    v = np.random.default_rng(4).integers(0, 60000, (2, 70, 30)).astype(np.uint16)
    (tmp_path / "c.XISF").write_bytes(xisf.build(v, {"FILTER": "R"}, None))
    (tmp_path / "d.xisf").write_bytes(xisf.build(v, {"FILTER": "R"}, "zlib+sh"))
    (tmp_path / "e.xisf").write_bytes(b"XISF0100")
    name = lambda r: r["path"].rsplit("/")[-1]
    heads = {name(r): r for r in frames.headers(spark, str(tmp_path)).collect()}
    assert {k for k, r in heads.items() if r["error"]} == {"bad.fits", "e.xisf"} and len(heads) == 7
    assert heads["head.fit"]["height"] == 100 and heads["a b.FiTs"]["header"]["FILTER"] == "L" and heads["c.XISF"]["header"]["FILTER"] == "R"
    rows = {(name(r), r["y0"]): np.frombuffer(r["data"], "<f4") for r in fits.row_gather(spark, str(tmp_path), [3, 99, 3, 100, -1]).collect()}
    assert set(rows) == {(n, y) for n in ("a b.FiTs", "cfa.fits") for y in (3, 99)} and np.array_equal(rows["a b.FiTs", 3], image[3], equal_nan=True)
    seen = {name(r): r for r in frames.previews(spark, str(tmp_path), 34).collect()}
    assert {k for k, r in seen.items() if r["error"]} == {"bad.fits", "e.xisf", "head.fit"}
    assert seen["a b.FiTs"]["block"] == 3 and seen["cfa.fits"]["block"] == 4
    pixels = lambda r: np.frombuffer(r["data"], "<f4").reshape(r["height"], r["width"])
    for n, source, block in (("a b.FiTs", image, 3), ("cfa.fits", image, 4), ("c.XISF", v.mean(0), 3), ("d.xisf", v.mean(0), 3)):
        h, w = source.shape
        wanted = [[np.nanmean(source[y : y + block, x : x + block].astype(float)) for x in range(0, w, block)] for y in range(0, h, block)]
        assert np.allclose(pixels(seen[n]), wanted, rtol=1e-6)
    assert frames.tiles(spark, str(tmp_path)).count() == 8


def test_twins_read_only_what_may_be_equal(spark, tmp_path, monkeypatch):
    """Equal files, files of one length, of one head, alone, empty (never listed); both ways of reading give the same, and no content is in a plan."""
    from framestack.sources import frames

    big = b"h" * (frames.HEAD + 10)
    names = {"a.fits": big + b"1", "b.fit": big + b"1", "c.FITS": big + b"2", "d.fits": b"x" + big, "sub/e.xisf": big + b"1", "f.fits": b"alone", "g.fits": b"", "h.fits": b"", "i.txt": big + b"1"}
    for name, content in names.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    short = lambda df: sorted((r.path.split(f"{tmp_path.name}/")[-1], r.first.split(f"{tmp_path.name}/")[-1], r.digest) for r in df.collect())
    found = frames.twins(spark, str(tmp_path))
    assert "content" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = short(found)
    assert [g[:2] for g in got] == [("a.fits", "a.fits"), ("b.fit", "a.fits"), ("sub/e.xisf", "a.fits")]
    monkeypatch.setattr(frames.fits, "seekable", lambda path: False)
    assert short(frames.twins(spark, str(tmp_path))) == got

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skycube.functions import geometry as G
from skycube.functions import names as NM
from skycube.functions import spectra as S
from skycube.jobs import ingest
from skycube.operators import inventory as I
from skycube.operators import patchfit as H
from skycube.operators import quality as Q
from skycube.operators import reduce as R
from skycube.operators import select as P
from skycube.operators import tracking as T
from skycube.operators import windows as W
from skycube.sources import fits, schema, store, tables


def cube(spark, x, **more):
    """Cells of an array (time, freq, pol, l, m); NaN is missing."""
    rows = [(*map(int, i), None if np.isnan(v) else float(v)) for i, v in np.ndenumerate(x)]
    df = spark.createDataFrame(rows, "time_idx long, freq_idx long, pol_idx long, l_idx long, m_idx long, flux double")
    n = x.shape
    return df.withColumns({
        "mjd": 60000 + 0.01 * F.col("time_idx"), "freq_hz": 46e6 + 4e6 * F.col("freq_idx"), "stokes": F.lit(1),
        "l": -1 + 2 * F.col("l_idx") / (n[3] - 1), "m": -1 + 2 * F.col("m_idx") / (n[4] - 1),
    } | more)


def array(df, column, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        if r[column] is not None:
            out[r.time_idx, r.freq_idx, r.pol_idx, r.l_idx, r.m_idx] = r[column]
    return out


@pytest.fixture(scope="module")
def basic(spark):
    x = np.random.default_rng(42).uniform(0, 10, (2, 3, 1, 12, 12))
    x[0, 0, 0, 3, 4] = np.nan
    return x, cube(spark, x).persist()


def test_schema_errors(spark, basic):
    with pytest.raises(schema.CubeError, match="missing dimensions: pol_idx"):
        schema.check_cells(basic[1].drop("pol_idx"))
    with pytest.raises(schema.CubeError, match="missing variables: flux"):
        schema.check_cells(basic[1].drop("flux"))
    with pytest.raises(schema.CubeError, match="no pixel"):
        P.box(basic[1], 5, 5, 0.1, 0.1, check=True)
    with pytest.raises(schema.CubeError, match="no channel"):
        R.frequency_average(basic[1], 1, 2, check=True)


def test_rms_and_peaks_against_numpy(spark, basic):
    x, cells = basic
    got = array(W.rms_map(cells, 5), "rms", x.shape)
    for (t, f, p, i, j), v in np.ndenumerate(x):
        box = x[t, f, p, max(0, i - 2) : i + 3, max(0, j - 2) : j + 3]
        assert np.isnan(got[t, f, p, i, j]) if np.isnan(v) else math.isclose(got[t, f, p, i, j], np.nanstd(box), abs_tol=1e-9)
    y = np.random.default_rng(1).normal(0, 0.01, (1, 1, 1, 40, 40))
    y[0, 0, 0, 20, 11] = 50
    peaks = W.find_peaks(cube(spark, y), 5, 10, 5).collect()
    assert [(r.l_idx, r.m_idx) for r in peaks] == [(20, 11)]


def test_all_missing_plane(spark):
    x = np.full((1, 1, 1, 4, 4), np.nan)
    cells = cube(spark, x)
    assert R.finite_fraction(cells, 4, 4).first().fraction == 0
    assert R.time_average(cells).where("flux IS NOT NULL").count() == 0
    assert W.find_peaks(cells, 1, 3, 1).count() == 0


def test_infinite_values_are_not_finite(spark):
    x = np.ones((1, 1, 1, 2, 2))
    x[0, 0, 0, 0, 0] = np.inf
    cells = cube(spark, x)
    assert R.finite_fraction(cells, 2, 2).first().fraction == 0.75
    assert not spark.range(1).select(P.passes(F.lit(float("inf")), "gt", 1).alias("x")).first().x


def test_integrated_flux_rules(spark):
    rows = [("a", 1.0, 2.0), ("a", 2.0, 4.0), ("a", 3.0, 6.0), ("b", 1.0, 5.0), ("c", 9.0, 1.0), ("d", 1.0, None), ("d", 2.0, 1.0)]
    got = {r.k: r.integrated for r in R.integrated_flux(spark.createDataFrame(rows, "k string, freq_hz double, flux double"), ["k"], 0, 5).collect()}
    assert got == {"a": 8.0, "b": 5.0, "c": 0.0, "d": None}


def test_pixel_world_round_trip(spark):
    wcs = {k: F.lit(v) for k, v in {"crval1": 180.0, "crval2": 45.0, "crpix1": 25.0, "crpix2": 25.0, "cdelt1": -1.0, "cdelt2": 1.0}.items()}
    df = spark.range(50).crossJoin(spark.range(50).toDF("j")).select(F.col("id").alias("i"), "j")
    ra, dec = G.pixel_to_world(F.col("i"), F.col("j"), wcs)
    x, y = G.world_to_pixel(F.col("ra"), F.col("dec"), wcs, 50, 50)
    back = df.select("i", "j", ra.alias("ra"), dec.alias("dec")).select("i", "j", x.alias("x"), y.alias("y"))
    assert back.where("x <> i OR y <> j OR x IS NULL").count() == 0
    hidden = spark.range(1).select(G.world_to_pixel(F.lit(0.0), F.lit(-45.0), wcs, 50, 50)[0].alias("x")).first().x
    assert hidden is None


def test_names(spark):
    names = ["20240524_050009_41MHz_averaged_20000_iterations-I-image.fits", "82MHz-I-Taper-602s-Robust-0-20260419_071829-image.pbcorr_dewarped.fits", "Blue_I_10min_Taper_Robust-0_pbcorr_20250508_LST22h_t0001.fits", "x41MHzy.fits"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = df.select(NM.subband_mhz(F.col("n")).alias("m"), NM.stokes(F.col("n")).alias("s"), NM.time_key(F.col("n")).alias("k")).collect()
    assert [r.m for r in got] == [41.0, 82.0, None, None]
    assert [r.s for r in got] == [1, 1, 1, 1]
    assert [r.k for r in got] == ["20240524_050009", "20260419_071829", "20250508_LST22h_t0001", None]


def test_beam_reasons(spark):
    df = spark.createDataFrame([("0.1", "0.1"), (None, "1"), ("x", "1"), ("NaN", "1"), ("0", "1"), ("1", "-2")], "a string, b string")
    got = [r.r for r in df.select(NM.beam_reason(F.col("a"), F.col("b")).alias("r")).collect()]
    assert got == [None, "BMAJ missing", "BMAJ not a number", "BMAJ not finite", "BMAJ not positive", "BMIN not positive"]


def test_dispersion_closed_form(spark):
    d = spark.range(1).select(S.dispersion_delay(F.lit(56.8), F.lit(46.0), F.lit(54.0)).alias("a"), S.dispersion_delay(F.lit(56.8), F.lit(54.0), F.lit(54.0)).alias("b"), S.dispersion_delay(F.lit(-1.0), F.lit(46.0), F.lit(54.0)).alias("c")).first()
    assert math.isclose(d.a, 4148.808 * 56.8 * (46**-2 - 54**-2)) and d.b == 0 and d.c is None


def test_merge_tolerance_is_inclusive(spark):
    keys = spark.createDataFrame([("a", 60000.0), ("b", 60000.0 + 60 / 86400), ("c", 60000.0 + 121 / 86400)], "time_key string, mjd double")
    assert {r.time_key: r.group_key for r in I.merged_keys(keys, 60).collect()} == {"a": "a", "b": "a", "c": "c"}


def test_resume_by_mjd(spark):
    files = spark.createDataFrame([("x", 60000.0), ("y", 60000.1)], "time_key string, mjd double")
    stored = spark.createDataFrame([(60000.0 + 5e-10,)], "mjd double")
    assert [r.time_key for r in I.not_stored(files, stored).collect()] == ["y"]


def test_duplicates_and_resolver(spark):
    rows = [("k", "b", 1, 1, 46e6), ("k", "a", 1, 1, 46e6), ("k", "c", None, 1, None)]
    files = spark.createDataFrame(rows, "time_key string, path string, freq_bin long, stokes int, freq_hz double")
    assert sorted(r.path for r in I.deduplicated(files).collect()) == ["a", "c"]
    picked = I.resolved(files.where("freq_bin = 1"), lambda k, f, paths: paths[-1], files.schema)
    assert [r.path for r in picked.collect()] == ["b"]
    with pytest.raises(Exception, match="unknown path"):
        I.resolved(files.where("freq_bin = 1"), lambda k, f, paths: "zzz", files.schema).collect()


def test_gaussian_fit_recovers_source():
    x, y = (a.reshape(-1).astype(float) for a in np.meshgrid(np.arange(11), np.arange(11), indexing="ij"))
    z = H.model(np.array([7.0, 1.5, 5.3, 4.6]), x, y, 1.6, 1.2)
    p, chi2 = H.fit_gaussian(x, y, z, 1.6, 1.2)
    assert np.allclose(p, [7.0, 1.5, 5.3, 4.6], rtol=1e-4) and chi2 < 1e-8


def test_bounded_fits():
    """A dip has no negative peak, a source beyond the reach stays at it, and a flat patch keeps its moments."""
    x, y = (a.reshape(-1).astype(float) for a in np.meshgrid(np.arange(9), np.arange(9), indexing="ij"))
    p, _ = H.fit_gaussian(x, y, H.model(np.array([-5.0, 2.0, 4.0, 4.0]), x, y, 1.5, 1.5), 1.5, 1.5, centre=(4, 4), reach=2)
    assert p[0] >= 0 and np.abs(p[2:] - 4).max() <= 2
    p, _ = H.fit_gaussian(x, y, H.model(np.array([5.0, 2.0, 7.0, 4.0]), x, y, 1.5, 1.5), 1.5, 1.5, centre=(4, 4), reach=2)
    assert np.isclose(p[2], 6) and p[0] > 0
    assert np.allclose(H.moments(x, y, np.ones(81), (4, 4), 2), [1, 1, 4, 4])


def test_fits_round_trip(spark, tmp_path):
    plane = np.arange(35, dtype=np.float32).reshape(7, 5)
    plane[2, 3] = np.nan
    (tmp_path / "a.fits").write_bytes(fits.write_plane({"RESTFREQ": 46e6, "OBJECT": "it's"}, plane))
    (tmp_path / "bad.fits").write_bytes(b"SIMPLE")
    heads = {r.name: r for r in fits.read_headers(spark, str(tmp_path)).collect()}
    assert heads["a.fits"].header["OBJECT"] == "it's" and float(heads["a.fits"].header["RESTFREQ"]) == 46e6 and heads["bad.fits"].problem
    assert [r.name for r in fits.list_files(spark, str(tmp_path)).orderBy("name").collect()] == ["a.fits", "bad.fits"]
    path = fits.list_files(spark, str(tmp_path), "a.fits").first().path
    tiles = fits.read_tiles(spark, spark.createDataFrame([(path, 0, 0, 0)], "path string, time_idx long, freq_idx long, pol_idx long"), str(tmp_path), 3)
    out = fits.export_planes(tiles, 5, 7).first().fits
    assert np.array_equal(fits.planes_of(bytes(out))[1][0], plane, equal_nan=True)


def test_append_twice_is_append_once(spark, tmp_path):
    x = np.random.default_rng(3).normal(size=(2, 1, 1, 6, 5))
    tiles = store.to_tiles(cube(spark, x), 4)
    path = str(tmp_path / "store")
    for _ in range(2):
        store.append_times(tiles, path)
    back = array(store.to_cells(store.open_tiles(spark, path)), "flux", x.shape)
    assert np.allclose(back, x.astype(np.float32)) and store.open_tiles(spark, path).count() == tiles.count()
    store.append_times(store.to_tiles(cube(spark, x[1:] + 1).withColumn("time_idx", F.lit(1).cast("long")), 4), path, overwrite=True)
    back = array(store.to_cells(store.open_tiles(spark, path)), "flux", x.shape)
    assert np.allclose(back[0], x[0].astype(np.float32)) and np.allclose(back[1], (x[1] + 1).astype(np.float32))


def test_regroup_keeps_values(spark):
    x = np.random.default_rng(4).normal(size=(1, 2, 1, 10, 9))
    back = array(store.to_cells(store.regroup(store.to_tiles(cube(spark, x), 4), 3)), "flux", x.shape)
    assert np.allclose(back, x.astype(np.float32))


def test_headers_are_read_by_blocks(tmp_path):
    """An empty first unit, a second with the image; what lies behind its header isn't read."""
    image = fits.write_plane({"OBJECT": "x"}, np.ones((40, 50), np.float32))
    empty = "".join(c.ljust(80) for c in ("SIMPLE  =                    T", "BITPIX  =                    8", "NAXIS   =                    0", "END")).ljust(2880).encode()
    head = image.index(b"END" + b" " * 77)

    class Counting:
        def __init__(self, data):
            self.data, self.at, self.got = data, 0, 0

        def read(self, n):
            out = self.data[self.at : self.at + n]
            self.at += len(out)
            self.got += len(out)
            return out

        def seek(self, at):
            self.at = at

    stream = Counting(empty + image)
    assert fits.header_of(stream)["OBJECT"] == "x" and stream.got == 2880 * (2 + head // 2880)
    with pytest.raises(ValueError, match="no image"):
        fits.header_of(Counting(empty))


def test_files_to_store(spark, tmp_path):
    """Files of two times, an invalid beam among them, to a cube with all planes; again adds nothing."""
    rng = np.random.default_rng(8)
    planes = {}
    for t, key in enumerate(("20240101_000000", "20240101_010000")):
        for f, mhz in enumerate((41, 46)):
            planes[t, f] = rng.normal(size=(6, 5)).astype(np.float32)
            name = f"{key}_{mhz}MHz-I-image.fits"
            beam = -1.0 if (t, f) == (1, 1) else 0.1
            (tmp_path / name).write_bytes(fits.write_plane({"RESTFREQ": mhz * 1e6, "BMAJ": beam, "BMIN": 0.05, "DATE-OBS": f"2024-01-01T0{t}:00:00"}, planes[t, f]))
    for _ in range(2):
        plan = ingest.convert(spark, str(tmp_path), str(tmp_path / "store"), tile=4)
    assert plan.count() == 3
    cells = store.to_cells(store.open_tiles(spark, str(tmp_path / "store"))).collect()
    got = {(r.time_idx, r.freq_idx, r.l_idx, r.m_idx): r.flux for r in cells}
    assert len(cells) == len(got) == 2 * 2 * 30 and all(got[1, 1, i, j] is None for i in range(5) for j in range(6))
    assert all(np.isclose(got[t, f, i, j], planes[t, f][j, i]) for t, f in ((0, 0), (0, 1), (1, 0)) for i in range(5) for j in range(6))


def test_append_keeps_every_channel(spark, tmp_path):
    """A time step whose channels come one after the other is stored whole; an unreadable store is an error."""
    x = np.random.default_rng(3).normal(size=(2, 3, 1, 6, 5))
    tiles = store.to_tiles(cube(spark, x), 4)
    path = str(tmp_path / "store")
    for f in (0, 1, 0, 2):
        store.append_tiles(tiles.where(F.col("freq_idx") == f), path)
    back = array(store.to_cells(store.open_tiles(spark, path)), "flux", x.shape)
    assert np.allclose(back, x.astype(np.float32)) and store.open_tiles(spark, path).count() == tiles.count()
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_bytes(b"no parquet file at all")
    with pytest.raises(Exception, match="part-0"):
        store.append_tiles(tiles, str(tmp_path / "bad"))


def test_first_of_keeps_loose_rows(spark):
    rows = [("a", 1, "p2"), ("a", 1, "p1"), (None, 1, "p3"), (None, 1, "p3"), ("b", None, "p4")]
    df = spark.createDataFrame(rows, "k string, n int, path string").withColumn("header", F.create_map(F.lit("x"), F.col("path")))
    assert sorted(r.path for r in I.first_of(df, ["k", "n"], ["path"]).collect()) == ["p1", "p3", "p3", "p4"]


def test_merging_over_days(spark):
    """Groups that go over midnight, and over days; a key without a time stands alone."""
    steps = [0.0, 0.4, 0.8, 1.1, 1.5, 1.9, 2.3, 5.0, 5.2, 7.0]
    df = spark.createDataFrame([(f"k{i}", 60000.3 + s) for i, s in enumerate(steps)] + [("none", None)], "time_key string, mjd double")
    got = {r.time_key: r.group_key for r in I.merged_keys(df, 0.41 * 86400).collect()}
    assert got == {**{f"k{i}": "k0" for i in range(7)}, "k7": "k7", "k8": "k7", "k9": "k9", "none": "none"}


def test_candidate_pages(spark):
    index = (
        '<table><tr data-sid="J0"><td>9</td></tr></table><table class="x idx"><tr><th>#</th><th>source</th><th>date</th><th> PB-corr  peak (Jy)</th><th>SNR</th><th>what</th><th>n_i_epoch</th></tr>'
        '<tr data-sid="J1"><td>1</td><td><a href="/s">J1</a></td><td>2025-05-05</td><td>21.91</td><td>72.3</td><td>?</td><td>16</td><td>more</td></tr><tr data-sid=""><td>2</td></tr><tr data-sid="J2"><td>3</td></tr></table>'
    )
    head = "<tr><th>LST</th><th>date</th><th>band</th><th>SNR</th><th>RA</th><th>Dec</th></tr>"
    page = f'<div class="locbar"><input class="lv" value="280.4663 -1.96395"><input class="lv" value="18:41"></div><input class="lv" value="no"><table>{head}<tr><td>17h</td><td>2025-05-05</td><td>Full</td><td>1,092.61</td><td>1.0</td><td>2.0</td></tr><tr><td>25h</td><td>2025-05-05</td><td>Full</td><td>1</td><td>1</td><td>1</td></tr><tr><td>a</td></tr></table>'
    loose = "<table><tr><td>17h</td><td>2025-05-05</td><td>Full</td><td>9</td><td>1.0</td><td>2.0</td></tr></table>"
    read = tables.read_pages(spark.createDataFrame([("1", index), ("2", page + loose), ("3", None)], "page_id string, html string")).persist()
    got = [(r.source_id, r.rank, r.date, r.peak_jy, r.snr, r.n_epoch, r.note) for r in tables.candidates(read).collect()]
    assert got == [("J1", "1", "2025-05-05", 21.91, 72.3, "16", ""), ("J2", "3", "", None, None, "", "")]
    assert [(r.lst_hour, r.snr) for r in tables.detections(read).collect()] == [(17, 1092.61)]
    assert [(r.page, r.ra, r.dec) for r in tables.combined_positions(read).collect()] == [("1", None, None), ("2", 280.4663, -1.96395), ("3", None, None)]


def test_quality_csv(spark, tmp_path):
    run = tmp_path / "08h" / "Run_20240101_000000"
    run.mkdir(parents=True)
    (run / "flux_check.csv").write_text("imfit_flux,imfit_err,elevation,model_flux,source,freq\n4,0.1,50,2,3C48,32\n")
    (run / "dewarp_summary.csv").write_text("freq_mhz,median_shift_arcmin\n55,0.12\nx,0.34\n")
    cov = spark.createDataFrame([("Run_20240101_000000", 8)], "run string, hour long")
    assert Q.flux_ratio(tables.flux_checks(spark, str(run / "flux_check.csv"), cov)).first().ratio == 2.0
    assert sorted((r.freq_mhz or 0, r.median_shift_arcmin) for r in tables.dewarp_shifts(spark, str(run / "dewarp_summary.csv")).collect()) == [(0, 0.34), (55.0, 0.12)]


def test_peak_detection_of_full_band(spark):
    rows = [(1, "s", "2025-05-05", 17, 32, 68.27), (2, "s", "2025-05-05", 17, None, 92.61), (3, "s", "2025-04-10", 15, 23, 33.77)]
    d = spark.createDataFrame(rows, "detection_id long, source_id string, day string, hour long, band long, snr double")
    r = Q.peak_detections(d).first()
    assert (r.detection_id, r.band, r.overlay) == (2, None, 32)


def test_sources_of_one_position_share_its_track(spark):
    """One row for a position, dealt to as many tasks as a shuffle has; no source is lost, nor one without a position."""
    from skycube.operators import tracking as T

    rows = [(k, 10.0 * (k % 3), 40.0) for k in range(600)] + [(600, None, None), (None, 10.0, 40.0)]
    sources = spark.createDataFrame(rows, "source_id long, ra_deg double, dec_deg double")
    times = spark.createDataFrame([(0, 60000.0), (1, 60000.3)], "time_idx long, mjd double")
    held = T.track(sources, times, 8, 8, together=True)
    assert held.count() == 2 * 4 and held.rdd.getNumPartitions() >= 4
    tracked = T.track(sources, times, 8, 8)
    assert tracked.count() == 2 * 602 and tracked.where("source_id IS NULL").count() == 2
    tiles = spark.createDataFrame([(t, 0, 0, a, b, 4 * a, 4 * b, 4, 4, [1.0] * 16) for t in (0, 1) for a in (0, 1) for b in (0, 1)], "time_idx long, freq_idx long, pol_idx long, tile_l long, tile_m long, l0 long, m0 long, n_l int, n_m int, data array<float>")
    found = T.along(held, tiles, 4)
    assert found.count() == 2 * 602 and found.where("source_id = 600 AND flux IS NULL").count() == 2
    assert found.where("visible").count() == found.where("flux = 1").count() > 0


def test_boxes_take_the_pixels_at_their_borders(spark):
    from math import cos, radians

    from skycube.operators import select as P

    centres = [(k, -80.0 + k * 16.1, 0, -1.3 + 0.13 * k, 1.1 - 0.11 * k) for k in range(10)] + [(10, 0.0, 0, 2 * 3 / 7 - 1 + radians(20), 0.0)]
    boxes = P.boxes_on_sky(spark.createDataFrame(centres, "source_id long, dec_deg double, time_idx long, l0 double, m0 double"), 20.0, 15.0, 8, 8)
    got = {(r.source_id, i, j) for r in boxes.collect() for i in range(r.l_lo, r.l_hi + 1) for j in range(r.m_lo, r.m_hi + 1)}
    near = lambda i, c, half: abs(2 * i / 7 - 1 - c) <= half
    assert got == {(s, i, j) for s, dec, _, l0, m0 in centres for i in range(8) for j in range(8) if near(i, l0, radians(20) * cos(radians(dec))) and near(j, m0, radians(15))}


def test_donors_of_one_time_and_windows_that_grow_with_the_rows(spark):
    from skycube.operators import inventory as I

    rows = spark.createDataFrame([(41.0, 5.1, 0.2), (41.0, 5.1, 0.1), (41.0, 5.3, None), (41.0, 5.9, 0.4), (41.0, 5.9, 0.3), (41.0, 7.2, 0.0), (46.0, 5.3, 0.0)], "mhz double, mjd double, bmaj double").coalesce(1)
    found = I.beam_donors(rows)
    assert {(r.mhz, r.mjd): r.donor_bmaj for r in found.where("coalesce(bmaj, 0) <= 0").collect()} == {(41.0, 5.3): 0.2, (41.0, 7.2): 0.4, (46.0, 5.3): None}
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()


def test_a_time_step_is_few_files(spark, tmp_path):
    from pathlib import Path

    from skycube.sources import store

    tiles = spark.range(320).selectExpr("id div 8 AS time_idx", "id % 8 AS freq_idx", "0L AS pol_idx", "0L AS tile_l", "0L AS tile_m", "0L AS l0", "0L AS m0", "1 AS n_l", "1 AS n_m", "array(cast(id AS float)) AS data").repartition(8)
    for name, write in (("a", store.append_tiles), ("b", store.append_times)):
        write(tiles, f"file://{tmp_path}/{name}")
        assert len(list(Path(tmp_path, name).rglob("*.parquet"))) == 40
        assert store.open_tiles(spark, f"file://{tmp_path}/{name}").count() == 320


def test_a_small_file_is_many_tasks_work(spark):
    from compare import SMALL

    from skycube.queries import QUERIES

    for name in ("s10_candidates", "s11_detections", "s11_combined_position"):
        assert QUERIES[name](spark, SMALL).rdd.getNumPartitions() >= 4


def test_a_beam_that_is_written_as_zero_is_not_positive(spark, tmp_path):
    import duckdb
    from compare import SMALL, sql_rows, table

    from skycube.queries import ORACLES, QUERIES

    duckdb.sql(f"COPY (SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE value END AS value) FROM read_parquet('{SMALL}/events.parquet')) TO '{tmp_path}/events.parquet'")
    assert table(QUERIES["f7_invalid_beams"](spark, str(tmp_path)).toPandas()) == table(sql_rows(ORACLES["f7_invalid_beams"], str(tmp_path)))


def test_sources_are_told_apart_after_planes(spark):
    """The last step gives a row to each source, so nothing is read from arrays for each of them."""
    tracked = spark.createDataFrame([([1, 2, 3], 0, 0, 0, True)], "source_ids array<long>, time_idx long, l_idx long, m_idx long, visible boolean")
    values = spark.createDataFrame([(0, 0, 0, f, 0, 1.0) for f in range(4)], "time_idx long, l_idx long, m_idx long, freq_idx long, pol_idx long, value double")
    rows = T.spread(tracked, values)
    assert sorted((r.source_id, r.freq_idx) for r in rows.collect()) == [(s, f) for s in (1, 2, 3) for f in range(4)]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode(source_ids") < plan.index("explode(found")


def test_sources_meet_values_by_blocks(spark, monkeypatch):
    """Every source, time and plane, some sources to a position, more positions than a block holds, hidden ones and some without a position."""
    rows = [(k, 7.0 * (k % 50), 5.0 * (k % 17) - 30) for k in range(900)] + [(900, None, 10.0), (None, 14.0, -20.0)]
    sources = spark.createDataFrame(rows, "source_id long, ra_deg double, dec_deg double")
    times = spark.createDataFrame([(t, 60000 + 0.05 * t) for t in range(6)], "time_idx long, mjd double")
    tiles = spark.createDataFrame([(t, f, p, a, b, 4 * a, 4 * b, 4, 4, [float(t + f + p + a + b + i) for i in range(16)]) for t in range(5) for f in (0, 1) for p in (0, 1) if t + f + p != 3 for a in (0, 1) for b in (0, 1)], "time_idx long, freq_idx long, pol_idx long, tile_l long, tile_m long, l0 long, m0 long, n_l int, n_m int, data array<float>")
    tracked = T.track(sources, times, 8, 8)
    plain = lambda df: sorted(df.collect(), key=str)
    monkeypatch.setattr(T, "BLOCK", 100)
    channels = T.channels_of(tiles)
    names = ["source_id", "time_idx", "freq_idx", "pol_idx", "visible", "flux"]
    got = T.follow(sources, times, 8, 8, T.pixels_of(tiles, 4), channels=channels).select(*names)
    assert plain(got) == plain(T.along(tracked, tiles, 4).select(*names)) and got.count() == 902 * 6 * 4
    got = T.follow(sources, times, 8, 8, T.pixels_of(tiles, 4)).select(*names)
    assert plain(got) == plain(T.spread(tracked, T.pixels_of(tiles, 4)(T.places(tracked))).select(*names))


def test_no_shuffle_has_the_sources_of_each_time(spark):
    """What is shuffled with a source's number does not grow with the times."""
    import re

    from compare import SMALL

    from skycube.queries import QUERIES

    for name in ("e1_light_curve", "f10_spectral_index_at", "a27_coverage_report", "j1_tile_lookup"):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        # Numbers are gathered and dealt to parts, and meet a block's times by the block, not by time and place.
        joins = [x for x in plan.splitlines() if re.search(r"\bJoin Inner\b", x) and "block" in x and "part" in x]
        assert joins and all("time_idx" not in x.split("strategy")[0].split(">")[0] for x in joins), name

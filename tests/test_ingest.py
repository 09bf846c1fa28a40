"""Files to cubes over several runs, and reading FITS in ranges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skycube.jobs import ingest
from skycube.sources import cube, fits, fits_source, remote, store
from skycube.sources.schema import CubeError


def put(folder, key, mhz, pixels, bmaj=0.1, cut=None, **cards):
    folder.mkdir(exist_ok=True)
    hour = f"{key[:4]}-{key[4:6]}-{key[6:8]}T{key[9:11]}:{key[11:13]}:{key[13:15]}" if "LST" not in key else cards.pop("date")
    data = fits.write_plane({"RESTFREQ": mhz * 1e6, "BMAJ": bmaj, "BMIN": 0.05, "DATE-OBS": hour} | cards, np.full((3, 4), pixels, np.float32))
    (folder / f"{key}_{mhz}MHz-I-image.fits").write_bytes(data[:cut])


def planes(spark, path):
    """(MJD, Hz) -> the one value of a plane, by the axes; None if it is missing."""
    at = {(r.axis, r.idx): r.value for r in cube.axes(spark, path).collect()}
    return {(round(at["time", r.time_idx], 4), at["freq", r.freq_idx]): r.x for r in store.to_cells(store.open_tiles(spark, path)).groupBy("time_idx", "freq_idx").agg(F.max("flux").alias("x")).collect()}


def test_an_older_time_and_a_late_subband_come_later(spark, tmp_path):
    path = str(tmp_path / "cube")
    put(tmp_path / "a", "20240101_000000", 41, 1)
    put(tmp_path / "b", "20240102_000000", 41, 2)
    put(tmp_path / "b", "20240102_000000", 46, 3)
    put(tmp_path / "c d%20", "20231231_000000", 41, 4)  # older, in a folder with odd characters
    put(tmp_path / "c d%20", "20240101_000005", 46, 5)  # a late subband, five seconds off
    put(tmp_path / "c d%20", "20240102_000000", 46, 9)  # stored already: stays
    for folder in ("a", "b", "c d%20", "b"):
        before = cube.tiles(spark, path).count() if cube.is_cube(spark, path) else 0
        ingest.convert(spark, str(tmp_path / folder), path, tile=4)
    assert cube.tiles(spark, path).count() == before
    days = {"20240101": 60310.0, "20240102": 60311.0, "20231231": 60309.0}
    assert planes(spark, path) == {(days["20240101"], 41e6): 1, (days["20240101"], 46e6): 5, (days["20240102"], 41e6): 2, (days["20240102"], 46e6): 3, (days["20231231"], 41e6): 4, (days["20231231"], 46e6): None}
    order = cube.in_order(spark, path).orderBy("place").collect()
    assert [(r.time_idx, r.mjd) for r in order] == [(2, 60309.0), (0, 60310.0), (1, 60311.0)]
    assert [r["planes"] for r in cube.versions(spark, path)] == [1, 2, 2, 0]


def test_every_file_has_an_outcome(spark, tmp_path):
    path, folder = str(tmp_path / "cube"), tmp_path / "f"
    put(folder, "20240101_000000", 41, 1)
    put(folder, "20240101_010000", 41, 1, cut=2900)
    put(folder, "20240101_020000", 41, 1, cut=0)  # Spark lists no file without bytes
    put(folder, "20240101_030000", 41, 1, bmaj=-1.0)
    put(folder, "20240101_000030", 41, 7)  # within a minute of the first
    put(folder, "20240101_LST05h_t0001", 41, 1, date="2024-01-01T05:00:00")
    put(folder, "20240101_LST05h_t0001", 46, 1, date="2024-01-01T05:00:10")
    (folder / "20240101_040000_41MHz-I-image.fits").write_bytes(b"no image at all")
    # A cut copy sorts before a good one and must not stand for it.
    put(folder / "0", "20240101_050000", 41, 1, cut=2900)
    put(folder, "20240101_050000", 41, 8)
    ingest.convert(spark, str(folder), path, tile=4)
    got = sorted((r.path.split("/f/")[1].split("-")[0], r.outcome) for r in cube.files(spark, path).collect())
    assert got == [
        ("0/20240101_050000_41MHz", "truncated"), ("20240101_000000_41MHz", "converted"), ("20240101_000030_41MHz", "copy of a plane"), ("20240101_010000_41MHz", "truncated"),
        ("20240101_030000_41MHz", "beam"), ("20240101_040000_41MHz", "malformed"), ("20240101_050000_41MHz", "converted"), ("20240101_LST05h_t0001_41MHz", "mixed header times"), ("20240101_LST05h_t0001_46MHz", "mixed header times"),
    ]
    assert sorted(planes(spark, path).values()) == [1, 8]


def test_a_run_that_fails_or_loses_a_race_leaves_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cube")
    put(tmp_path / "a", "20240101_000000", 41, 1)
    put(tmp_path / "b", "20240102_000000", 41, 2)
    ingest.convert(spark, str(tmp_path / "a"), path)
    whole = cube.commit

    def late(spark, path, seen, run, **counts):
        whole(spark, path, seen, "another")
        return whole(spark, path, seen, run, **counts)

    with monkeypatch.context() as m:
        m.setattr(cube, "commit", late)
        with pytest.raises(CubeError, match="meanwhile"):
            ingest.convert(spark, str(tmp_path / "b"), path)
    assert cube.tiles(spark, path).count() == 1 and planes(spark, path) == {(60310.0, 41e6): 1}
    ingest.convert(spark, str(tmp_path / "b"), path)
    assert planes(spark, path) == {(60310.0, 41e6): 1, (60311.0, 41e6): 2}


def test_an_unreadable_store_is_an_error(spark, tmp_path):
    put(tmp_path / "a", "20240101_000000", 41, 1)
    files = fits.list_files(spark, str(tmp_path / "a"))
    gone = files.withColumn("path", F.lit(f"file:{tmp_path}/a/gone.fits"))
    assert fits.headers_by_blocks(gone).first().problem.startswith("unreadable")
    (tmp_path / "a" / "20240101_000000_41MHz-I-image.fits").chmod(0)
    try:
        open(tmp_path / "a" / "20240101_000000_41MHz-I-image.fits", "rb").close()
    except PermissionError:
        with pytest.raises(CubeError, match="can't be read"):
            ingest.convert(spark, str(tmp_path / "a"), str(tmp_path / "cube"))


def test_schemes():
    assert [remote.scheme_of(p) for p in ("/a:b/c", "file:/a b", "s3a://b/x", "a/b:c")] == ["file", "file", "s3a", "file"]


def test_paths_of_all_schemes_are_told_apart(spark):
    rows = spark.createDataFrame([("s3a://b/x y.fits",), ("file:/x",), ("/x",), ("viewfs://store/x",), ("wasb://c/x",)], "path string")
    assert [r[0] for r in rows.select(remote.in_ranges(F.col("path"))).collect()] == [True, True, True, False, False]


def test_spectral_cubes_give_a_plane_for_each_channel(spark, tmp_path):
    (tmp_path / "a").mkdir()
    n = 5
    data = np.arange(n * 12, dtype=np.float32).reshape(n, 3, 4)
    one = fits.write_plane({"NAXIS3": n, "RESTFREQ": 40e6, "CRVAL3": 40e6, "CRPIX3": 2.0, "CDELT3": 1e6, "BMAJ": 0.1, "BMIN": 0.1, "DATE-OBS": "2024-01-01T00:00:00"}, data[0])
    head = one[:2880]
    body = data.astype(">f4").tobytes()
    (tmp_path / "a" / "20240101_000000_cube.fits").write_bytes(head + body.ljust(2880, b"\0"))
    ingest.convert(spark, str(tmp_path / "a"), str(tmp_path / "cube"), tile=2)
    assert {k[1]: v for k, v in planes(spark, str(tmp_path / "cube")).items()} == {39e6 + 1e6 * k: data[k].max() for k in range(n)}


def test_long_files_are_read_in_ranges(spark, tmp_path):
    """Every strip is read once, whatever the ranges; nothing else of the file is."""
    plane = np.random.default_rng(1).normal(size=(37, 50)).astype(np.float32)
    (tmp_path / "x.fits").write_bytes(fits.write_plane({}, plane))
    inventory = spark.createDataFrame([(f"{tmp_path}/x.fits", 3, 4, 5)], "path string, time_idx long, freq_idx long, pol_idx long").withColumn("size_bytes", F.lit((tmp_path / "x.fits").stat().st_size))
    for size in (1 << 26, 1000, 333):
        tiles = fits.read_tiles(spark, inventory, str(tmp_path), 8, range_bytes=size)
        out = fits.export_planes(tiles.withColumns({"freq_idx": F.lit(0).cast("long")}), 50, 37).collect()
        assert len(out) == 1 and np.array_equal(fits.planes_of(bytes(out[0].fits))[1][0], plane) and tiles.count() == 5 * 7


def test_files_that_no_table_names_are_never_opened(spark, tmp_path):
    """The others can't be opened at all here: they are folders' worth of nonsense."""
    put(tmp_path / "a", "20240101_000000", 41, 1)
    (tmp_path / "a" / "other.fits").write_bytes(b"nonsense")
    named = spark.createDataFrame([(f"file:{tmp_path}/a/20240101_000000_41MHz-I-image.fits", 0, 0, 0)], "path string, time_idx long, freq_idx long, pol_idx long")
    assert fits.read_tiles(spark, named, str(tmp_path / "a"), 8).count() == 1
    fits_source.register(spark)
    read = lambda: spark.read.format("fits").load(str(tmp_path / "a"))
    assert read().where("name LIKE '2024%'").count() == 1 and read().where("size_bytes > 100").select("header").first().header["RESTFREQ"] == "41000000.0"
    with pytest.raises(Exception, match="END card"):
        read().count()


def test_headers_of_arriving_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out, at = str(tmp_path / "out"), str(tmp_path / "at")
    for k in range(2):
        put(tmp_path / "in", f"2024010{k + 1}_000000", 41, 1)
        fits_source.arriving_headers(spark, str(tmp_path / "in")).writeStream.format("parquet").option("checkpointLocation", at).trigger(availableNow=True).start(out).awaitTermination()
        assert sorted(r.header["DATE-OBS"] for r in spark.read.parquet(out).collect()) == [f"2024-01-0{i + 1}T00:00:00" for i in range(k + 1)]


def test_planes_on_another_grid_are_taken_to_the_first(spark, tmp_path):
    """A plane of half the step and twice the size, in a later run: a linear image stays one; pixels beyond it are missing."""
    path = str(tmp_path / "cube")
    ramp = lambda n_m, n_l, step, at: np.add.outer((np.arange(n_m) + 1 - at) * step * 10, (np.arange(n_l) + 1 - at) * -step).astype(np.float32)
    cards = {"BMAJ": 0.1, "BMIN": 0.05, "CDELT1": -1.0, "CDELT2": 1.0, "CRPIX1": 4.0, "CRPIX2": 4.0, "RESTFREQ": 41e6}
    for folder, key, step, at, shape in (("a", "20240101_000000", 1.0, 4.0, (9, 7)), ("b", "20240102_000000", 0.5, 6.0, (11, 12))):
        (tmp_path / folder).mkdir()
        grid = {"CDELT1": -step, "CDELT2": step, "CRPIX1": at, "CRPIX2": at, "DATE-OBS": f"{key[:4]}-{key[4:6]}-{key[6:8]}T00:00:00"}
        (tmp_path / folder / f"{key}_41MHz-I-image.fits").write_bytes(fits.write_plane(cards | grid, ramp(*shape, step, at)))
        ingest.convert(spark, str(tmp_path / folder), path, tile=3)
    want = ramp(9, 7, 1.0, 4.0).T
    got = np.full((2, 7, 9), 0.0)
    for r in store.to_cells(store.open_tiles(spark, path)).collect():
        got[r.time_idx, r.l_idx, r.m_idx] = np.nan if r.flux is None else r.flux
    assert np.allclose(got[0], want) and np.allclose(got[1][np.isfinite(got[1])], want[np.isfinite(got[1])], atol=1e-5)
    assert 20 < np.isfinite(got[1]).sum() < 63


def test_folders_are_listed_in_tasks(spark, tmp_path, monkeypatch):
    """Deep folders, names that Spark skips, empty files; no reader of Spark's lists on the driver, and the files are many tasks' work."""
    from skycube.sources import fits

    for name in ("a.fits", "x y/b%20.fits", "x y/deep/c.fits", "_hidden/d.fits", ".e.fits", "k=1/f.fits", "g.txt"):
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(b"12345")
    (tmp_path / "empty.fits").write_bytes(b"")
    by_spark = spark.read.format("binaryFile").option("pathGlobFilter", "*.fits").option("recursiveFileLookup", "true").load(str(tmp_path))
    want = sorted((r.path, r.length) for r in by_spark.select("path", "length").collect())
    found = fits.list_files(spark, str(tmp_path))
    assert sorted((r.path, r.size_bytes) for r in found.collect()) == want and len(want) == 4
    assert found.rdd.getNumPartitions() == 4 and "binaryfile" not in found._jdf.queryExecution().toString().lower()
    assert fits.list_files(spark, str(tmp_path / "a.fits")).count() == 1


def test_short_files_share_a_partition(tmp_path):
    from skycube.sources.fits_source import FitsReader

    for k in range(600):
        (tmp_path / f"{k}.fits").write_bytes(b"x" * (300 if k == 7 else 10))
    parts = FitsReader({"path": str(tmp_path), "content": "tiles", "rangebytes": "100"}).partitions()
    assert len(parts) < 70 and sum(len(p.files) for p in parts if p.last is None) == 599
    assert [(p.first, p.last) for p in parts if p.last] == [(0, 100), (100, 200), (200, 300)]

"""FITS files written from the cube view, and what is read back from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import lst_hours
from ..functions.names import mjd_timestamp
from ..jobs import ingest
from ..sources import cube, fits, fits_source, fits_tables, store, views
from ..sources.scratch import new_path
from ..sources.views import CELLS_SQL
from .registry import query, rounded

V = "time_idx * 20 + freq_idx * 2 + pol_idx"
#: The planes of the view, which of them are cut short, and which have a bad beam.
P = f"WITH {CELLS_SQL}, p AS (SELECT time_idx, freq_idx, pol_idx, any_value(mjd) AS mjd, any_value(freq_hz) AS freq_hz, any_value(stokes) AS stokes, count(flux) AS pixels, round(sum(flux * (l_idx * 8 + m_idx)), 3) + 0.0 AS mark, vec % 11 = 0 AS short, vec % 13 = 0 AS bad FROM (SELECT *, time_idx * 20 + freq_idx * 2 + pol_idx AS vec FROM cells) GROUP BY time_idx, freq_idx, pol_idx, vec) "
NAME = "strftime(make_timestamp(CAST(round((mjd - 40587) * 86400000000.0) AS BIGINT)), '%Y%m%d_%H%M%S') || '_' || CAST(freq_hz / 1e6 AS INT) || 'MHz-' || CASE stokes WHEN 1 THEN 'I' ELSE 'V' END || '-image.fits'"


def _written(spark, sf_dir, folder, below=None):
    """A file for each plane: (path, size_bytes), stored. ``below`` gives the folder below ``folder`` that a plane goes to."""
    planes = views.cells(spark, sf_dir).select("time_idx", "mjd", "freq_idx", "freq_hz", "pol_idx", "stokes").distinct().withColumn("v", F.expr(V))
    planes = planes.withColumns({"bmaj": F.when(F.col("v") % 13 == 0, 0.0).otherwise(0.1), "bmin": F.lit(0.05), "bpa": F.lit(0.0), "ra0_deg": lst_hours(F.col("mjd")) * 15, "dec0_deg": F.lit(37.2339), "cdelt_deg": F.lit(16.37), "source": F.lit("view")})
    name = F.concat(F.date_format(mjd_timestamp(F.col("mjd")), "yyyyMMdd_HHmmss"), F.lit("_"), (F.col("freq_hz") / 1e6).cast("int").cast("string"), F.lit("MHz-"), F.when(F.col("stokes") == 1, "I").otherwise("V"), F.lit("-image.fits"))
    exported = fits.export_planes(views.tiles(spark, sf_dir), 8, 8, cards=fits.plane_cards(planes, 8, 8, "skycube"))
    files = exported.join(planes.select("time_idx", "freq_idx", "pol_idx", "v", name.alias("name")), ["time_idx", "freq_idx", "pol_idx"])
    # A copy that ends within its pixels.
    files = files.withColumn("fits", F.when(F.col("v") % 11 == 0, F.substring("fits", 1, 3000)).otherwise(F.col("fits")))
    out = new_path(spark, "written")
    if below is not None:
        files = files.withColumn("name", F.concat_ws("/", below, "name"))
    fits.write_files(files, folder).write.parquet(out)
    return spark.read.parquet(out)


@query("s4_listed_files", P + f"SELECT {NAME} AS name, CAST(CASE WHEN short THEN 3000 ELSE 5760 END AS BIGINT) AS size_bytes FROM p")
def listed_files(spark, sf_dir):
    folder = new_path(spark, "fits files")
    _written(spark, sf_dir, folder)
    return fits.list_files(spark, folder).select("name", "size_bytes")


@query("s3_headers", P + f"SELECT {NAME} AS name, freq_hz AS restfreq, mjd, CASE WHEN bad THEN 0.0 ELSE 0.1 END AS bmaj, CAST(3136 AS BIGINT) AS needs, CAST(NULL AS VARCHAR) AS problem FROM p")
def headers(spark, sf_dir):
    """Headers of all files, cut ones too: a header block is all that is read."""
    folder = new_path(spark, "fits files")
    _written(spark, sf_dir, folder)
    h = F.col("header")
    return fits.read_headers(spark, folder).select("name", h["RESTFREQ"].cast("double").alias("restfreq"), h["MJD-OBS"].cast("double").alias("mjd"), h["BMAJ"].cast("double").alias("bmaj"), "needs", "problem")


@query("s2_tiles_of_files", P + "SELECT time_idx, freq_idx, pol_idx, pixels, mark FROM p WHERE NOT short")
def tiles_of_files(spark, sf_dir):
    """The whole planes, each by the place that a table gives it; cut files aren't named and so not opened."""
    folder = new_path(spark, "fits files")
    _written(spark, sf_dir, folder)
    h = F.col("header")
    found = fits.read_headers(spark, folder).where("size_bytes >= needs")
    places = found.select("path", "size_bytes", F.round((h["MJD-OBS"].cast("double") - 60000) * 100).cast("long").alias("time_idx"), F.round((h["RESTFREQ"].cast("double") - 30e6) / 6e6).cast("long").alias("freq_idx"), F.when(h["CRVAL4"].cast("double") == 1, 0).otherwise(1).cast("long").alias("pol_idx"))
    return _marks(fits.read_tiles(spark, places, folder, 3))


def _marks(tiles):
    cells = store.to_cells(tiles)
    out = cells.groupBy("time_idx", "freq_idx", "pol_idx").agg(F.count("flux").alias("pixels"), F.sum(F.col("flux") * (F.col("l_idx") * 8 + F.col("m_idx"))).alias("mark"))
    return rounded(out.withColumn("time_idx", F.col("time_idx").cast("long")), "mark", digits=3)


@query("h6_fits_source", P + f"SELECT {NAME} AS name, pixels, mark FROM p WHERE NOT short AND stokes = 4")
def fits_format(spark, sf_dir):
    """Tiles by Spark's reader; the filters go to the listing, so no other file is opened."""
    folder = new_path(spark, "fits files")
    _written(spark, sf_dir, folder)
    fits_source.register(spark)
    tiles = spark.read.format("fits").option("content", "tiles").option("tile", 5).load(folder).where("size_bytes > 3000").where(F.col("name").endswith("MHz-V-image.fits"))
    cells = store.to_cells(tiles.select(F.col("name").alias("time_idx"), F.lit(0).alias("freq_idx"), F.lit(0).alias("pol_idx"), "l0", "m0", "n_m", "data"))
    out = cells.groupBy(F.col("time_idx").alias("name")).agg(F.count("flux").alias("pixels"), F.sum(F.col("flux") * (F.col("l_idx") * 8 + F.col("m_idx"))).alias("mark"))
    return rounded(out, "mark", digits=3)


#: Folders by time modulo 3, the middle one last.
RUNS = (0, 2, 1, 0)


def _converted(spark, sf_dir):
    path, root = new_path(spark, "cube"), new_path(spark, "some folders")
    _written(spark, sf_dir, root, F.col("time_idx") % 3)
    for k in RUNS:
        ingest.convert(spark, f"{root}/{k}", path, tile=3)
    return path


@query(
    "e11_converted_folders",
    P + """, good AS (SELECT * FROM p WHERE NOT short AND NOT bad), t AS (SELECT time_idx, mjd, row_number() OVER (ORDER BY CASE time_idx % 3 WHEN 0 THEN 0 WHEN 2 THEN 1 ELSE 2 END, time_idx) - 1 AS i, row_number() OVER (ORDER BY mjd) - 1 AS place FROM (SELECT DISTINCT time_idx, mjd FROM good))
SELECT t.i AS time_idx, t.place, round(t.mjd, 6) + 0.0 AS mjd, f.freq_idx, s.pol_idx, coalesce(pixels, 0) AS pixels, mark
FROM t CROSS JOIN (SELECT DISTINCT freq_idx FROM good) f CROSS JOIN (SELECT DISTINCT pol_idx FROM good) s LEFT JOIN good g ON g.time_idx = t.time_idx AND g.freq_idx = f.freq_idx AND g.pol_idx = s.pol_idx""",
)
def converted_folders(spark, sf_dir):
    """Three folders into one store, the middle times last, the first folder twice, with cut files and bad beams among them; every plane read back."""
    path = _converted(spark, sf_dir)
    order = cube.in_order(spark, path).select("time_idx", F.col("place").cast("long").alias("place"), "mjd")
    return rounded(_marks(store.open_tiles(spark, path)).join(order, "time_idx"), "mjd")


@query(
    "e11_file_outcomes",
    P + """, r(version, k) AS (VALUES (1, 0), (2, 2), (3, 1), (4, 0))
SELECT CAST(version AS BIGINT) AS version, CASE WHEN short THEN 'truncated' WHEN bad THEN 'beam' WHEN version = 4 THEN 'stored before' ELSE 'converted' END AS outcome, count(*) AS n FROM p JOIN r ON p.time_idx % 3 = k GROUP BY ALL""",
)
def file_outcomes(spark, sf_dir):
    """What became of each file in each run of the same conversions."""
    path = _converted(spark, sf_dir)
    runs = spark.createDataFrame([(r["run"], r["version"]) for r in cube.versions(spark, path)], "run string, version long")
    return cube.files(spark, path).join(runs, "run").groupBy("version", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s12_beam_tables",
    "SELECT p_partkey AS part, chan, CASE WHEN (p_partkey + chan) % 5 <> 0 THEN pol END AS pol, 30e6 + chan * (p_size * 1000.0) AS freq_hz, CASE WHEN (p_partkey + chan) % 5 <> 0 THEN round((p_size + chan) / 3600.0, 9) END AS bmaj, CASE WHEN (p_partkey + chan) % 5 <> 0 THEN round(p_size / 7200.0, 9) END AS bmin FROM part, range(0, 4) AS c(chan), range(0, 2) AS q(pol) WHERE (p_partkey + chan) % 5 <> 0 OR pol = 0",
)
def beam_tables(spark, sf_dir):
    """Spectral cubes written with a BEAMS table, one for each part; channels and their beams read back from headers and tables."""
    import numpy as np
    import pyarrow as pa

    def rows(batches):
        for batch in batches:
            names, data = [], []
            for key, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = [(c, q) for c in range(4) for q in range(2) if (key + c) % 5 != 0]
                image = fits.write_plane({"NAXIS3": 4, "CTYPE3": "FREQ", "CRVAL3": 30e6, "CRPIX3": 1.0, "CDELT3": size * 1000.0, "PART": key}, np.zeros((8, 2), np.float32))
                beams = {"BMAJ": ("1E", [size + c for c, _ in own]), "BMIN": ("1E", [size / 2 for _ in own]), "BPA": ("1E", [0.0 for _ in own]), "CHAN": ("1J", [c for c, _ in own]), "POL": ("1J", [q for _, q in own])}
                names.append(f"{key}.fits")
                data.append(image + fits_tables.write_table("BEAMS", beams, {"TUNIT1": "arcsec", "NCHAN": 4}))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(data, pa.binary())], names=["name", "fits"])

    folder, out = new_path(spark, "spectral cubes"), new_path(spark, "written")
    fits.write_files(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size").mapInArrow(rows, "name string, fits binary"), folder).write.parquet(out)
    h, number = F.col("header"), lambda k: F.col("header")[k].cast("double")
    heads = fits.read_headers(spark, folder).select("path", h["NAXIS3"].cast("int").alias("n_chan"), number("CRVAL3").alias("crval"), number("CRPIX3").alias("crpix"), number("CDELT3").alias("cdelt"), number("PART").cast("long").alias("part"))
    # channel_planes takes widths in arcsec.
    beams = fits_tables.read_tables(spark, heads, "BEAMS", "BMAJ double, BMIN double, CHAN int, POL int").select("path", F.col("CHAN").alias("chan"), F.col("POL").cast("long").alias("pol"), F.col("BMAJ").alias("bmaj"), F.col("BMIN").alias("bmin"))
    found = fits.channel_planes(heads, beams).drop("path").withColumn("chan", F.col("chan").cast("long"))
    return rounded(found, "bmaj", "bmin", digits=9)

"""FITS images: headers, planes, and writing planes, as small numpy helpers that Spark maps over files."""

from __future__ import annotations

import io
from collections.abc import Iterator
from fnmatch import fnmatchcase
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructField, StructType

from .remote import SCHEMES, children, in_ranges, opened, scheme_of, written
from .schema import TILES
from .scratch import new_path

BLOCK, CARD = 2880, 80
DTYPES = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


def parse_header(data: bytes, at: int = 0) -> tuple[dict[str, str], int]:
    """Keyword to value text of the header at ``at``, and where its data begin."""
    cards: dict[str, str] = {}
    while True:
        block = data[at : at + BLOCK]
        if len(block) < BLOCK:
            raise ValueError("a header ends before its END card")
        at += BLOCK
        for i in range(0, BLOCK, CARD):
            card = block[i : i + CARD].decode("ascii", "replace")
            key = card[:8].strip()
            if key == "END":
                return cards, at
            if card[8:10] == "= ":
                raw = card[10:].strip()
                if raw.startswith("'"):
                    # A quote inside a string is doubled.
                    end = 1
                    while (end := raw.find("'", end)) >= 0 and raw[end : end + 2] == "''":
                        end += 2
                    cards[key] = raw[1 : end if end > 0 else None].replace("''", "'").rstrip()
                else:
                    cards[key] = raw.split("/")[0].strip()


def data_bytes(header: dict[str, str]) -> int:
    axes = [int(header[f"NAXIS{i}"]) for i in range(1, int(header.get("NAXIS", 0)) + 1)]
    return int(np.prod(axes)) * abs(int(header["BITPIX"])) // 8 if axes else 0


def image_hdu(data: bytes) -> tuple[dict[str, str], int]:
    """The first header-data unit with an image of two axes or more; its header and where the data begin."""
    at = 0
    while at < len(data):
        header, begin = parse_header(data, at)
        size = data_bytes(header)
        if int(header.get("NAXIS", 0)) >= 2 and size and header.get("XTENSION", "IMAGE") == "IMAGE":
            return header, begin
        at = begin + -(-size // BLOCK) * BLOCK
    raise ValueError("no image")


def planes_of(data: bytes) -> tuple[dict[str, str], np.ndarray]:
    """Header and pixels as (plane, m, l), float32; scaled, blanks as NaN."""
    header, at = image_hdu(data)
    n_l, n_m = int(header["NAXIS1"]), int(header["NAXIS2"])
    bits = int(header["BITPIX"])
    raw = np.frombuffer(data, DTYPES[bits], data_bytes(header) * 8 // abs(bits), at)
    x = raw.astype(np.float64)
    if bits > 0 and "BLANK" in header:
        x[raw == int(header["BLANK"])] = np.nan
    x = x * float(header.get("BSCALE", 1)) + float(header.get("BZERO", 0))
    return header, x.reshape(-1, n_m, n_l).astype(np.float32)


def write_plane(header: dict[str, str | float | int], pixels: np.ndarray) -> bytes:
    """A (1, 1, m, l) float32 image with the given further cards."""
    n_m, n_l = pixels.shape
    cards: dict = {"SIMPLE": True, "BITPIX": -32, "NAXIS": 4, "NAXIS1": n_l, "NAXIS2": n_m, "NAXIS3": 1, "NAXIS4": 1} | header

    body = pixels.astype(">f4").tobytes()
    return header_bytes(cards) + body.ljust(-(-len(body) // BLOCK) * BLOCK, b"\0")


def header_bytes(cards: dict[str, str | float | int | bool]) -> bytes:
    """A header of these cards, in blocks."""

    def text(v) -> str:
        if isinstance(v, bool):
            return f"{'T' if v else 'F':>20}"
        if isinstance(v, str):
            return "'" + v.replace("'", "''").ljust(8) + "'"
        return f"{v!r:>20}"

    head = "".join(f"{k:<8}= {text(v)}"[:CARD].ljust(CARD) for k, v in cards.items()) + "END".ljust(CARD)
    return head.ljust(-(-len(head) // BLOCK) * BLOCK).encode("ascii")


def list_files(spark: SparkSession, path: str, pattern: str = "*.fits") -> DataFrame:
    """(path, name, size_bytes) of files, content unread. Files without bytes are left out, as Spark does.

    Tasks list the folders, level by level, so no listing goes through the driver. Patterns of paths, single files, and
    paths that tasks can't open are listed by Spark.
    """
    if (folder := _folder(spark, path)) and not set(pattern) & set("[]{}^\\"):
        return _with_name(_listed(spark, folder, pattern)).select("path", "name", "size_bytes")
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size_bytes"))


def _folder(spark: SparkSession, path: str) -> str | None:
    """The whole name of a folder that tasks can list."""
    if set(path) & set("*?[]{}\\"):
        return None
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    name = system.makeQualified(at).toString()
    return name.rstrip("/") if scheme_of(name) in SCHEMES and system.exists(at) and system.getFileStatus(at).isDirectory() else None


def _listed(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, size_bytes) of the files at or below a folder, dealt to many tasks."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for top in batch.column(0).to_pylist():
                found = ((p, n, d) for p, n, d in children(top) if d or n and fnmatchcase(p.rpartition("/")[2], pattern))
                while some := list(islice(found, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), (pa.string(), pa.int64(), pa.bool_()))], names=["path", "size_bytes", "is_folder"])

    kinds, n, files = "path string, size_bytes long, is_folder boolean", int(spark.conf.get("spark.sql.shuffle.partitions")), []
    level = spark.createDataFrame([(folder,)], "path string")
    while True:
        at = new_path(spark, "listed")
        level.mapInArrow(rows, kinds).write.parquet(at)
        here = spark.read.schema(kinds).parquet(at)
        files.append(here.where("NOT is_folder").select("path", "size_bytes"))
        folders = here.where("is_folder").select("path")
        if not folders.take(1):
            return reduce(DataFrame.unionByName, files).repartition(n)
        level = folders.repartition(n)


def units(stream) -> Iterator[tuple[dict[str, str], int]]:
    """Header and begin of the data of each unit of a file, read block by block; data are skipped, not read."""
    begin = 0
    while True:
        raw = b""
        while True:
            block = stream.read(BLOCK)
            if not block and not raw and begin:
                return
            if len(block) < BLOCK:
                raise ValueError("a header ends before its END card")
            raw += block
            if any(block[i : i + 8] == b"END     " for i in range(0, BLOCK, CARD)):
                break
        header, _ = parse_header(raw)
        yield header, begin + len(raw)
        begin += len(raw) + -(-(data_bytes(header) + int(header.get("PCOUNT", 0)) * ("XTENSION" in header)) // BLOCK) * BLOCK
        stream.seek(begin)


def image_units(stream) -> Iterator[tuple[dict[str, str], int]]:
    """The units that are images of two axes or more."""
    for header, begin in units(stream):
        if int(header.get("NAXIS", 0)) >= 2 and data_bytes(header) and header.get("XTENSION", "IMAGE") == "IMAGE":
            yield header, begin


def first_image(stream) -> tuple[dict[str, str], int]:
    """Header and begin of the data of the first image."""
    found = next(image_units(stream), None)
    if found is None:
        raise ValueError("no image")
    return found


def header_of(stream) -> dict[str, str]:
    """The header of the first image of a file."""
    return first_image(stream)[0]


HEADERS = "path string, size_bytes long, header map<string,string>, needs long, problem string"


def read_headers(spark: SparkSession, path: str, pattern: str = "*.fits") -> DataFrame:
    """(path, name, size_bytes, header, needs, problem): header maps; files that can't be used say why.

    ``needs`` is how long the header says that the file is, at least. A problem begins with
    ``malformed`` if the file is no image, with ``unreadable`` if it could not be read. A task opens
    a file through pyarrow's file systems, which know local paths, HDFS and object stores, and
    reads header blocks only; files of other schemes are read whole by Spark. Each path is dealt
    with by its own scheme.
    """
    files = list_files(spark, path, pattern)
    known = in_ranges(F.col("path"))
    out = headers_by_blocks(files.where(known))
    if files.where(~known).take(1):
        other = _contents(spark, path, pattern).where(~known).select("path", F.col("length").alias("size_bytes"), "content")
        out = out.unionByName(_with_name(other.mapInArrow(lambda batches: _described(batches, lambda b, k: io.BytesIO(b.column(2)[k].as_py())), HEADERS)))
    return out


def _described(batches: Iterator[pa.RecordBatch], open_one) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        headers, needs, problems = [], [], []
        for k in range(batch.num_rows):
            header, need, problem = [], None, None
            try:
                with open_one(batch, k) as stream:
                    found, begin = first_image(stream)
                header, need = list(found.items()), begin + data_bytes(found)
            except OSError as e:
                problem = f"unreadable: {e}"
            except (ValueError, KeyError) as e:
                problem = f"malformed: {e}"
            headers.append(header)
            needs.append(need)
            problems.append(problem)
        columns = [batch.column(0), batch.column(1), pa.array(headers, pa.map_(pa.string(), pa.string())), pa.array(needs, pa.int64()), pa.array(problems, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["path", "size_bytes", "header", "needs", "problem"])


def _with_name(df: DataFrame) -> DataFrame:
    return df.withColumn("name", F.element_at(F.split("path", "/"), -1))


def headers_by_blocks(files: DataFrame) -> DataFrame:
    """``read_headers`` of the listed files (path, size_bytes) alone, a stream or not; tasks open them."""
    rows = files.select("path", "size_bytes").mapInArrow(lambda batches: _described(batches, lambda b, k: opened(b.column(0)[k].as_py())), HEADERS)
    return _with_name(rows)


def _contents(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def headers_of(files: DataFrame, content: str = "fits") -> DataFrame:
    """The other columns of ``files`` and the header map of the content that they hold."""
    keep = [c for c in files.columns if c != content]
    schema = StructType([*[files.schema[c] for c in keep], StructField("header", MapType(StringType(), StringType()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.string(), pa.string())
        for batch in batches:
            headers = pa.array([list(image_hdu(x.as_py())[0].items()) for x in batch.column(content)], kind)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], headers], names=[*keep, "header"])

    return files.mapInArrow(rows, schema)


def strips(stream, tile: int, first: int = 0, last: int | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
    """``strips_of`` the first image of a file."""
    return strips_of(stream, *first_image(stream), tile, first, last)


def strips_of(stream, header: dict[str, str], begin: int, tile: int, first: int = 0, last: int | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
    """(plane, m0, pixels as (m, l)) of an image, ``tile`` rows at a time, of strips that begin at bytes first to last.

    Rows of an image are contiguous, so a strip is one read and no plane is ever held whole.
    """
    n_l, n_m, bits = int(header["NAXIS1"]), int(header["NAXIS2"]), int(header["BITPIX"])
    width = abs(bits) // 8
    scale, zero = float(header.get("BSCALE", 1)), float(header.get("BZERO", 0))
    for plane in range(data_bytes(header) // (n_l * n_m * width)):
        for m0 in range(0, n_m, tile):
            at = begin + (plane * n_m + m0) * n_l * width
            if at < first or last is not None and at >= last:
                continue
            rows = min(tile, n_m - m0)
            stream.seek(at)
            data = stream.read(rows * n_l * width)
            if len(data) < rows * n_l * width:
                raise ValueError("the file ends before its data do")
            raw = np.frombuffer(data, DTYPES[bits])
            x = raw.astype(np.float64)
            if bits > 0 and "BLANK" in header:
                x[raw == int(header["BLANK"])] = np.nan
            yield plane, m0, (x * scale + zero).reshape(rows, n_l).astype(np.float32)


_TILE_TYPES = [pa.int64()] * 7 + [pa.int32()] * 2 + [pa.list_(pa.float32())]


def _cut(stream, place, tile: int, first: int, last: int | None) -> Iterator[pa.RecordBatch]:
    for plane, m0, x in strips(stream, tile, first, last):
        if (key := place(plane)) is not None:
            out = [(*key, l0 // tile, m0 // tile, l0, m0, *y.T.shape, y.T.reshape(-1)) for l0, y in ((l0, x[:, l0 : l0 + tile]) for l0 in range(0, x.shape[1], tile))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*out), _TILE_TYPES)], names=[c.split()[0] for c in TILES.split(", ")])


def read_tiles(spark: SparkSession, inventory: DataFrame, root: str, tile: int = 512, pattern: str = "*.fits", range_bytes: int = 64 << 20) -> DataFrame:
    """Pixel tiles of the inventory's planes: path, time_idx, freq_idx, pol_idx, and plane if files have several.

    The paths go to the tasks and are opened there: a file that the inventory doesn't name is never
    touched, and no pixels are joined. A long file is several rows of ``range_bytes``, each read by
    the task it is dealt to. Without a column plane, plane k of a file is channel freq_idx + k.
    Paths that tasks can't open are read whole by Spark, below ``root``.
    """
    own = inventory if "plane" in inventory.columns else inventory.withColumn("plane", F.lit(None).cast("int"))
    files = own.groupBy("path").agg(F.collect_list(F.struct("plane", "time_idx", "freq_idx", "pol_idx")).alias("planes"))
    sizes = list_files(spark, root, pattern).select("path", "size_bytes") if "size_bytes" not in inventory.columns else inventory.select("path", "size_bytes").distinct()
    ranges = files.join(sizes, "path").select("path", "planes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size_bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("first"))

    def place_of(found: list[dict]):
        """plane -> its place in the cube, or None."""
        if found[0]["plane"] is None:
            r = found[0]
            return lambda k: (r["time_idx"], r["freq_idx"] + k, r["pol_idx"])
        return {r["plane"]: (r["time_idx"], r["freq_idx"], r["pol_idx"]) for r in found}.get

    def by_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, planes, first in zip(*(c.to_pylist() for c in batch.columns)):
                with opened(name) as stream:
                    yield from _cut(stream, place_of(planes), tile, first, first + range_bytes)

    def by_content(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for planes, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from _cut(io.BytesIO(data.as_py()), place_of(planes), tile, 0, None)

    known = in_ranges(F.col("path"))
    # Rows of a path and a number; each is to be a task's work, so they are dealt to many tasks.
    n = max(1, min(10_000, int(spark.conf.get("spark.sql.shuffle.partitions")) * 4))
    out = ranges.where(known).repartition(n, "path", "first").mapInArrow(by_ranges, TILES)
    if files.where(~known).take(1):
        contents = _contents(spark, root, pattern).where(~in_ranges(F.col("path"))).select("path", "content").join(files, "path")
        out = out.unionByName(contents.select("planes", "content").mapInArrow(by_content, TILES))
    return out


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes the column fits of each row to ``folder``/name in tasks; (path, size_bytes) of the files."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, data = batch.column(0).to_pylist(), batch.column(1)
            for name, x in zip(names, data):
                written(f"{folder}/{name}", x.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{x}" for x in names]), pa.array([len(x.as_py()) for x in data], pa.int64())], names=["path", "size_bytes"])

    return files.select("name", "fits").mapInArrow(rows, "path string, size_bytes long")


def plane_cards(planes: DataFrame, n_l: int, n_m: int, origin: str) -> DataFrame:
    """(time_idx, freq_idx, pol_idx, cards): sky coordinates, frequency, time, beam and provenance of each plane.

    ``planes``: time_idx, mjd, freq_idx, freq_hz, pol_idx, stokes, ra0_deg, dec0_deg, cdelt_deg,
    bmaj, bmin, bpa, source; whatever is NULL has no card.
    """
    texts = {"CTYPE1": F.lit("RA---SIN"), "CTYPE2": F.lit("DEC--SIN"), "CTYPE3": F.lit("FREQ"), "CTYPE4": F.lit("STOKES"), "CUNIT1": F.lit("deg"), "CUNIT2": F.lit("deg"), "ORIGIN": F.lit(origin), "SRCFILE": F.col("source")}
    numbers = {
        "CRVAL1": F.col("ra0_deg"), "CRVAL2": F.col("dec0_deg"), "CRPIX1": F.lit(n_l // 2 + 1), "CRPIX2": F.lit(n_m // 2 + 1), "CDELT1": -F.col("cdelt_deg"), "CDELT2": F.col("cdelt_deg"), "CRVAL3": F.col("freq_hz"), "RESTFREQ": F.col("freq_hz"),
        "CRVAL4": F.col("stokes"), "MJD-OBS": F.col("mjd"), "BMAJ": F.col("bmaj"), "BMIN": F.col("bmin"), "BPA": F.col("bpa"),
    }
    card = lambda k, t, x: F.struct(F.lit(k).alias("key"), t.alias("text"), x.cast("double").alias("number"))
    none = F.lit(None)
    cards = [card(k, t, none) for k, t in texts.items()] + [card(k, none.cast("string"), x) for k, x in numbers.items()]
    return planes.select("time_idx", "freq_idx", "pol_idx", F.filter(F.array(*cards), lambda c: c["text"].isNotNull() | c["number"].isNotNull()).alias("cards"))


def export_planes(tiles: DataFrame, n_l: int, n_m: int, header: dict[str, str | float | int] | None = None, cards: DataFrame | None = None) -> DataFrame:
    """(time_idx, freq_idx, pol_idx, fits): one image file for each plane; a plane fits one task.

    ``header`` is for all planes, ``cards`` (see ``plane_cards``) for each its own.
    """
    import pandas as pd

    key = ["time_idx", "freq_idx", "pol_idx"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        plane = np.full((n_m, n_l), np.nan, np.float32)
        for r in pdf.itertuples():
            plane[r.m0 : r.m0 + r.n_m, r.l0 : r.l0 + r.n_l] = np.asarray(r.data, np.float32).reshape(r.n_l, r.n_m).T
        first = pdf.iloc[0]
        own = {c["key"]: c["number"] if c["text"] is None else c["text"] for c in (first.cards if first.cards is not None else ())}
        return pd.DataFrame([{"time_idx": first.time_idx, "freq_idx": first.freq_idx, "pol_idx": first.pol_idx, "fits": write_plane((header or {}) | own, plane)}])

    none = F.lit(None).cast("array<struct<key:string,text:string,number:double>>").alias("cards")
    rows = tiles.join(cards.select(*key, "cards"), key, "left") if cards is not None else tiles.select("*", none)
    return rows.groupBy(*key).applyInPandas(one, "time_idx long, freq_idx long, pol_idx long, fits binary")


def channel_planes(cube_header: DataFrame, beams: DataFrame) -> DataFrame:
    """One row for each channel of spectral cubes: frequency CRVAL + (chan + 1 - CRPIX) CDELT, its beam in degrees.

    ``cube_header``: path, n_chan, crval, crpix, cdelt, and columns that stay; ``beams``: path, chan, pol, bmaj, bmin in arcsec.
    Both may come from files, whose list says little of what is in them, so neither is broadcast, small as it may look to Spark.
    """
    more = [c for c in cube_header.columns if c not in ("path", "n_chan", "crval", "crpix", "cdelt")]
    rows = cube_header.select("*", F.explode(F.sequence(F.lit(0), F.col("n_chan") - 1)).alias("chan"))
    freq = F.col("crval") + (F.col("chan") + 1 - F.col("crpix")) * F.col("cdelt")
    return rows.withColumn("freq_hz", freq).hint("merge").join(beams.withColumns({"bmaj": F.col("bmaj") / 3600, "bmin": F.col("bmin") / 3600}), ["path", "chan"], "left").select("path", "chan", "pol", "freq_hz", "bmaj", "bmin", *more)

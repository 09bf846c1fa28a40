"""FITS images as a Spark data source: ``spark.read.format("fits")``, after ``register(spark)``.

Option ``content`` is ``headers`` (a row for each image of each file) or ``tiles`` (a row for each
tile of each plane); ``tile`` and ``pattern`` as in ``fits``. Filters on path, name and
size_bytes are applied to the listing, so a file that they exclude is never opened. Headers are read
in blocks and tiles in ranges of ``rangeBytes``: a long file is several partitions, and short files
share one (``filesPerTask`` at the most).

The listing is the planner's, as for Spark's own file sources. For paths that only Spark can open,
and for files that a table names, ``fits.read_headers`` and ``fits.read_tiles`` are the way;
``arriving_headers`` reads the headers of a stream of files.
"""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith

from . import fits
from .remote import opened, scheme_of

HEADERS = "path string, name string, size_bytes long, unit int, header map<string,string>"
TILES = "path string, name string, size_bytes long, unit int, plane int, l0 long, m0 long, n_l int, n_m int, data array<float>"
TESTS = {
    EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v,
    StringContains: lambda x, v: v in x, StringEndsWith: lambda x, v: x.endswith(v), StringStartsWith: lambda x, v: x.startswith(v),
}
LISTED = ("path", "name", "size_bytes")


class Range(InputPartition):
    """Images of files that begin, tiles whose strips begin, at bytes first to last; last None: all."""

    def __init__(self, files: list[tuple[str, int]], first: int = 0, last: int | None = None):
        super().__init__(None)
        self.files, self.first, self.last = files, first, last


def listed(path: str, pattern: str) -> list[tuple[str, int]]:
    """(path, size) of the files at or below a path."""
    from pyarrow import fs

    scheme = scheme_of(path)
    rest = path[len(scheme) + 1 :] if path.startswith(f"{scheme}:") else path
    if scheme != "file":
        system, at = fs.FileSystem.from_uri(path)
        prefix = f"{scheme}://"
    else:
        system, at, prefix = fs.LocalFileSystem(), "/" + rest.lstrip("/") if rest.startswith("/") else rest, ""
    info = system.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted((prefix + x.path, x.size) for x in found if x.type == fs.FileType.File and fnmatch(x.base_name, pattern))


class FitsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("a path is needed")
        self.path, self.pattern = options["path"], options.get("pattern", "*.fits")
        self.tiles, self.tile = options.get("content", "headers") == "tiles", int(options.get("tile", 512))
        self.range_bytes, self.together = int(options.get("rangebytes", 64 << 20)), int(options.get("filespertask", 256))
        self.tests: list[tuple] = []

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if type(f) in TESTS and len(f.attribute) == 1 and f.attribute[0] in LISTED and getattr(f, "value", None) is not None:
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[Range]:
        files = []
        for path, size in listed(self.path, self.pattern):
            row = {"path": path, "name": path.rpartition("/")[2], "size_bytes": size}
            if all(TESTS[kind](row[column], value) for column, kind, value in self.tests):
                files.append((path, size))
        if not self.tiles:
            return [Range(files[k : k + self.together]) for k in range(0, len(files), self.together)] or [Range([])]
        # A long file is several partitions; short ones share one, up to its bytes.
        out, some, held = [], [], 0
        for path, size in files:
            if size > self.range_bytes:
                out += [Range([(path, size)], first, first + self.range_bytes) for first in range(0, size, self.range_bytes)]
                continue
            if some and (len(some) == self.together or held + size > self.range_bytes):
                out.append(Range(some))
                some, held = [], 0
            some.append((path, size))
            held += size
        return out + [Range(some)]

    def read(self, partition: Range) -> Iterator[tuple]:
        for path, size in partition.files:
            own = path, path.rpartition("/")[2], size
            with opened(path) as stream:
                if not self.tiles:
                    for unit, (header, _) in enumerate(fits.image_units(stream)):
                        yield *own, unit, header
                    continue
                units = list(fits.image_units(stream))
                for unit, (header, begin) in enumerate(units):
                    for plane, m0, x in fits.strips_of(stream, header, begin, self.tile, partition.first, partition.last):
                        for l0 in range(0, x.shape[1], self.tile):
                            y = x[:, l0 : l0 + self.tile].T
                            yield *own, unit, plane, l0, m0, *y.shape, y.reshape(-1).tolist()


class FitsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> str:
        return TILES if self.options.get("content", "headers") == "tiles" else HEADERS

    def reader(self, schema) -> FitsReader:
        return FitsReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets Spark hand filters to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FitsSource)


def arriving_headers(spark: SparkSession, path: str, pattern: str = "*.fits") -> DataFrame:
    """``fits.read_headers`` of files as they arrive below ``path``; Spark's log of files seen makes each come once."""
    kinds = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(kinds).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return fits.headers_by_blocks(files.select("path", F.col("length").alias("size_bytes")))

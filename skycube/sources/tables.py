"""Text inputs: quality CSVs and candidate pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Header labels of index pages, in lower case, and of detection tables.
LABELS = {
    "rank": ("#",),
    "date": ("date",),
    "bands": ("bands",),
    "peak_jy": ("pb-corr peak (jy)",),
    "detections": ("detections",),
    "snr": ("snr",),
    "elevation": ("elevation",),
    "n_epoch": ("n_i_epoch", "n_v_epoch"),
    "night_noise": ("night noise (x cell)",),
    "tess": ("tess",),
    "verdict": ("verdict",),
    "fp_reason": ("fp reason",),
    "cross_match": ("cross-match",),
    "note": ("note",),
}
NUMBERS = ("peak_jy", "detections", "snr", "elevation")
DETECTION = ("lst", "date", "band", "snr", "ra", "dec")


def flux_checks(spark: SparkSession, paths: str | list[str], coverage: DataFrame) -> DataFrame:
    """Rows of flux-check CSVs beside their run's coverage row (joined by run, from the path)."""
    rows = spark.read.option("header", "true").schema("imfit_flux double, imfit_err double, elevation double, model_flux double, source string, freq double").csv(paths)
    return rows.withColumn("run", F.regexp_extract(F.input_file_name(), r"(Run_[0-9]{8}_[0-9]{6})", 1)).join(coverage, "run")


def dewarp_shifts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(freq_mhz, median_shift_arcmin, path); text that is no number is NULL."""
    rows = spark.read.option("header", "true").csv(paths)
    return rows.select(F.col("freq_mhz").try_cast("double").alias("freq_mhz"), F.col("median_shift_arcmin").try_cast("double").alias("median_shift_arcmin"), F.input_file_name().alias("path"))


class _Page(HTMLParser):
    """What a candidate page holds: rows of tables, and the fields of its location bar.

    A row is (outermost table, whether it lies in a table of class idx, data-sid, whether it has
    header cells, cells).
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[int, bool, str | None, bool, list[str]]] = []
        self.position: str | None = None
        self._tables: list[bool] = []
        self._n_tables = 0
        self._bar = 0  # open div elements since the location bar
        self._row: list | None = None
        self._cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        named = dict(attrs)
        classes = (named.get("class") or "").split()
        if tag == "table":
            self._n_tables += not self._tables
            self._tables.append("idx" in classes or (bool(self._tables) and self._tables[-1]))
        elif tag == "tr" and self._tables:
            self._row = [self._n_tables, self._tables[-1], named.get("data-sid"), False, []]
        elif tag in ("td", "th") and self._row is not None:
            self._cell = []
            self._row[3] |= tag == "th"
        elif tag == "div" and (self._bar or "locbar" in classes):
            self._bar += 1
        elif tag == "input" and self._bar and "lv" in classes and self.position is None:
            self.position = named.get("value")

    def handle_data(self, data):
        if self._cell is not None:
            self._cell.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self._cell is not None:
            self._row[4].append(" ".join("".join(self._cell).split()))
            self._cell = None
        elif tag == "tr" and self._row is not None:
            self.rows.append(tuple(self._row))
            self._row = None
        elif tag == "table" and self._tables:
            self._tables.pop()
        elif tag == "div" and self._bar:
            self._bar -= 1


PAGE = "rows array<struct<tbl:int,idx:boolean,sid:string,header:boolean,cells:array<string>>>, position string"


def read_pages(pages: DataFrame, html: str = "html", page: str = "page_id") -> DataFrame:
    """(page, rows, position) of each page, parsed once; a page fits a task."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("tbl", pa.int32()), ("idx", pa.bool_()), ("sid", pa.string()), ("header", pa.bool_()), ("cells", pa.list_(pa.string()))]))
        for batch in batches:
            rows, positions = [], []
            for text in batch.column(1).to_pylist():
                found = _Page()
                found.feed(text or "")
                found.close()
                rows.append([dict(zip(("tbl", "idx", "sid", "header", "cells"), r)) for r in found.rows])
                positions.append((found.position or "").strip() or None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind), pa.array(positions, pa.string())], names=["page", "rows", "position"])

    return pages.select(F.col(page).cast("string").alias("page"), F.col(html).alias("html")).mapInArrow(parsed, "page string, " + PAGE)


def candidates(read: DataFrame) -> DataFrame:
    """Candidate rows of index pages: those with a source id in a table of class idx.

    A cell's column is told by the page's first header row, whatever its order; labels that no
    column has are left out. Numbers that are none are NULL.
    """
    r = F.filter("rows", lambda x: x["idx"])
    labels = F.transform(F.get(F.filter(r, lambda x: x["header"]), F.lit(0))["cells"], lambda c: F.lower(F.trim(c)))
    found = read.select("page", labels.alias("labels"), F.explode(F.filter(r, lambda x: (x["sid"] != "") & ~x["header"])).alias("r"))

    def cell(names: tuple[str, ...]) -> Column:
        # Of labels that stand for one column the last wins.
        at = [F.array_max(F.transform(F.col("labels"), lambda c, i: F.when(c.isin(*names), i)))]
        return F.coalesce(F.get("r.cells", at[0].cast("int")), F.lit(""))

    columns = {c: cell(names) for c, names in LABELS.items()}
    return found.select("page", F.col("r.sid").alias("source_id"), *[(x.try_cast("double") if c in NUMBERS else x).alias(c) for c, x in columns.items()])


def detections(read: DataFrame) -> DataFrame:
    """LST, date, band, SNR, RA, Dec rows of source pages; short rows, bad hours, dates and numbers go.

    They follow, in the same outermost table, the first row whose first six cells are those labels.
    """
    first = F.transform("rows", lambda x, i: F.when(F.transform(F.slice(x["cells"], 1, 6), lambda c: F.lower(F.trim(c))) == F.array(*[F.lit(c) for c in DETECTION]), F.struct(x["tbl"].alias("tbl"), i.alias("i"))))
    heads = F.array_compact(first)
    after = F.filter(F.transform("rows", lambda x, i: F.struct(x["cells"].alias("cells"), F.exists(heads, lambda h: (h["tbl"] == x["tbl"]) & (h["i"] < i)).alias("ok"))), lambda x: x["ok"] & (F.size(x["cells"]) >= 6))
    rows = read.select("page", F.explode(after).alias("r")).select("page", "r.cells")
    c = lambda i: F.trim(F.get("cells", F.lit(i)))
    hour = F.get(F.regexp_extract_all(c(0), F.lit(r"^([0-9]{1,2})h$"), F.lit(1)), F.lit(0)).try_cast("int")
    out = rows.select("page", hour.alias("lst_hour"), F.try_to_timestamp(c(1), F.lit("yyyy-MM-dd")).cast("date").alias("date"), c(2).alias("band"), F.replace(c(3), F.lit(",")).try_cast("double").alias("snr"), c(4).try_cast("double").alias("ra"), c(5).try_cast("double").alias("dec"))
    return out.where("lst_hour <= 23 AND date IS NOT NULL AND snr IS NOT NULL AND ra IS NOT NULL AND dec IS NOT NULL")


def combined_positions(read: DataFrame) -> DataFrame:
    """(page, position, ra, dec): the first field of the location bar; NULL where a page has none or it is no pair of degrees."""
    part = lambda k: F.get(F.split("position", r"[\s,]+"), F.lit(k)).try_cast("double")
    return read.select("page", "position", part(0).alias("ra"), part(1).alias("dec"))

"""Binary tables of FITS files: records decoded in tasks, by ranges of rows, heap included."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StringType, StructType

from . import fits
from .remote import opened

#: Codes of the format, fixed: their numpy types in big-endian order. X is bits, A text, P and Q point into the heap.
CODES = {"L": "S1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8", "C": ">c8", "M": ">c16"}
#: An unsigned integer is stored less half its range.
TFORM = re.compile(r"^\s*([0-9]*)([LXBIJKAEDCMPQ])([LXBIJKAEDCM]?)")


def table_units(stream) -> Iterator[tuple[dict[str, str], int]]:
    """Header and begin of the data of each binary table in a file; data are skipped, not read."""
    for header, begin in fits.units(stream):
        if header.get("XTENSION") == "BINTABLE":
            yield header, begin


def fields(header: dict[str, str]) -> dict[str, dict]:
    """Each column's count, code, heap code, offset in a record, scale, zero, null and unit, by its name in upper case."""
    out, at = {}, 0
    for i in range(1, int(header["TFIELDS"]) + 1):
        found = TFORM.match(header[f"TFORM{i}"])
        if not found:
            raise ValueError(f"unknown TFORM{i}: {header[f'TFORM{i}']}")
        count, code, heap = int(found[1] or 1), found[2], found[3]
        width = -(-count // 8) if code == "X" else count if code == "A" else count * 8 if code == "P" else count * 16 if code == "Q" else count * np.dtype(CODES[code]).itemsize
        out[header.get(f"TTYPE{i}", f"COL{i}").upper()] = {
            "count": count, "code": code, "heap": heap, "at": at, "width": width, "scale": float(header.get(f"TSCAL{i}", 1)), "zero": float(header.get(f"TZERO{i}", 0)),
            "null": int(header[f"TNULL{i}"]) if f"TNULL{i}" in header else None, "unit": header.get(f"TUNIT{i}", ""),
        }
        at += width
    if at > int(header["NAXIS1"]):
        raise ValueError("the fields are longer than a record")
    return out


def _values(raw: np.ndarray, f: dict) -> np.ndarray:
    """Numbers of one type as they are meant: scaled, NULL marks as NaN; whole numbers stay whole where nothing asks otherwise."""
    if f["null"] is not None and raw.dtype.kind in "iu":
        out = raw.astype(np.float64) * f["scale"] + f["zero"]
        out[raw == f["null"]] = np.nan
        return out
    if f["scale"] != 1 or f["zero"] != 0:
        whole = raw.dtype.kind in "iu" and f["scale"] == 1 and f["zero"] == int(f["zero"]) and abs(f["zero"]) < 2**62
        return raw.astype(np.int64) + int(f["zero"]) if whole else raw * f["scale"] + f["zero"]
    return raw


def decode(records: np.ndarray, f: dict, heap: bytes) -> list:
    """One Python value a record: a number, text, truth, or a list of them where a field has several or lies in the heap."""
    own = np.ascontiguousarray(records[:, f["at"] : f["at"] + f["width"]])
    code, n = f["code"], f["count"]
    if code == "A":
        return [bytes(r).split(b"\0")[0].decode("ascii", "replace").rstrip() for r in own]
    if code == "X":
        return np.unpackbits(own, axis=1)[:, :n].astype(bool).tolist()
    if code in "PQ":
        pairs = own.view(">i4" if code == "P" else ">i8").reshape(len(own), -1)[:, :2].tolist()
        if f["heap"] == "A":
            return [heap[at : at + k].decode("ascii", "replace").rstrip() for k, at in pairs]
        kind = CODES[f["heap"]]
        return [_values(np.frombuffer(heap, kind, k, at), f).tolist() if k else [] for k, at in pairs]
    x = own.view(CODES[code]).reshape(len(own), n)
    x = x == b"T" if code == "L" else _values(x, f)
    return [None if isinstance(v, float) and np.isnan(v) else v for v in x[:, 0].tolist()] if n == 1 else x.tolist()


def read_tables(spark: SparkSession, files: DataFrame, extension: str, columns: str, rows_at_once: int = 100_000) -> DataFrame:
    """(path, row, ``columns``) of the binary table ``extension`` of each file of ``files`` (path).

    ``columns`` is DDL with the table's own names; one that a table lacks is NULL. Records are read by
    ranges, the heap only where a column needs it. Files without such a table give no rows.
    """
    schema = StructType.fromDDL(columns)
    names = [c.name for c in schema]
    arrow = to_arrow_type(StructType.fromDDL(f"path string, row long, {columns}"))

    def fit(v, kind):
        if v is None or isinstance(kind, ArrayType):
            return v if v is None or isinstance(v, list) else [v]
        v = v[0] if isinstance(v, list) else v
        return v if isinstance(kind, StringType) else None if isinstance(v, float) and np.isnan(v) else kind.fromInternal(v) if not isinstance(v, (int, float)) else float(v) if kind.typeName() in ("double", "float") else int(v)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with opened(path) as stream:
                    for header, begin in list(table_units(stream)):
                        if header.get("EXTNAME", "").upper() != extension.upper():
                            continue
                        known, width, n = fields(header), int(header["NAXIS1"]), int(header["NAXIS2"])
                        heap = b""
                        if any(known[c.upper()]["code"] in "PQ" for c in names if c.upper() in known):
                            stream.seek(begin + int(header.get("THEAP", width * n)))
                            heap = stream.read(int(header.get("PCOUNT", 0)))
                        for first in range(0, n, rows_at_once):
                            k = min(rows_at_once, n - first)
                            stream.seek(begin + first * width)
                            data = stream.read(k * width)
                            if len(data) < k * width:
                                raise ValueError(f"{path} ends within its table")
                            records = np.frombuffer(data, np.uint8).reshape(k, width)
                            found = [[fit(v, c.dataType) for v in decode(records, known[c.name.upper()], heap)] if c.name.upper() in known else [None] * k for c in schema]
                            yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip([[path] * k, range(first, first + k), *found], arrow)], names=[t.name for t in arrow])

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.select("path").repartition(n, "path").mapInArrow(rows, f"path string, row long, {columns}")


#: Units of angles, in degrees.
DEGREES = {"": 1.0, "deg": 1.0, "arcmin": 1 / 60, "arcsec": 1 / 3600, "rad": 57.29577951308232, "mas": 1 / 3_600_000}


def beams(spark: SparkSession, files: DataFrame, unit: str = "arcsec") -> DataFrame:
    """(path, chan, pol, bmaj, bmin, bpa) of the BEAMS tables of spectral cubes; widths of ``unit`` in degrees."""
    rows = read_tables(spark, files, "BEAMS", "BMAJ double, BMIN double, BPA double, CHAN int, POL int")
    return rows.select("path", F.col("CHAN").alias("chan"), F.col("POL").alias("pol"), (F.col("BMAJ") * DEGREES[unit]).alias("bmaj"), (F.col("BMIN") * DEGREES[unit]).alias("bmin"), F.col("BPA").alias("bpa"))


def write_table(extension: str, columns: dict[str, tuple[str, list]], cards: dict | None = None) -> bytes:
    """A binary table: columns by name as (TFORM, values); a value is a number, a text, or a list where the form has several or is in the heap."""
    heap, fields_of = b"", []
    n = len(next(iter(columns.values()))[1]) if columns else 0
    for form, values in columns.values():
        found = TFORM.match(form)
        count, code, inner = int(found[1] or 1), found[2], found[3]
        if code == "A":
            fields_of.append(np.frombuffer(b"".join(str(v).encode("ascii").ljust(count)[:count] for v in values), np.uint8).reshape(n, count))
        elif code in "PQ":
            pairs = []
            for v in values:
                data = str(v).encode("ascii") if inner == "A" else np.asarray(v, CODES[inner]).tobytes()
                pairs.append((len(v), len(heap)))
                heap += data
            kind = ">i4" if code == "P" else ">i8"
            fields_of.append(np.array(pairs, kind).reshape(n, 2).view(np.uint8))
        elif code == "X":
            fields_of.append(np.packbits(np.array(values, bool).reshape(n, count), axis=1))
        else:
            x = np.array([[b"T" if y else b"F" for y in np.atleast_1d(v)] for v in values], "S1") if code == "L" else np.array(values, CODES[code])
            fields_of.append(np.ascontiguousarray(x.reshape(n, count)).view(np.uint8).reshape(n, -1))
    records = np.concatenate(fields_of, axis=1) if fields_of else np.zeros((n, 0), np.uint8)
    head = {"XTENSION": "BINTABLE", "BITPIX": 8, "NAXIS": 2, "NAXIS1": records.shape[1], "NAXIS2": n, "PCOUNT": len(heap), "GCOUNT": 1, "TFIELDS": len(columns), "EXTNAME": extension}
    for i, (name, (form, _)) in enumerate(columns.items(), 1):
        head |= {f"TTYPE{i}": name, f"TFORM{i}": form}
    body = records.tobytes() + heap
    return fits.header_bytes(head | (cards or {})) + body.ljust(-(-len(body) // fits.BLOCK) * fits.BLOCK, b"\0")

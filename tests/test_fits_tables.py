"""Binary tables: every code of the format, scaled, empty and in the heap."""

import io

import numpy as np
import pytest

from skycube.sources import fits, fits_tables


def empty_primary():
    return fits.header_bytes({"SIMPLE": True, "BITPIX": 8, "NAXIS": 0, "EXTEND": True})


COLUMNS = {
    "FLAG": ("1L", [True, False, True]), "BITS": ("11X", [[k % (i + 2) == 0 for k in range(11)] for i in range(3)]), "BYTE": ("1B", [0, 200, 255]), "SHORT": ("1I", [-5, 0, 32767]), "INT": ("1J", [-(2**31), 7, 2**31 - 1]),
    "LONG": ("1K", [-(2**63), 0, 2**63 - 1]), "NAME": ("6A", ["ab", "", "sixsix"]), "REAL": ("1E", [1.5, -2.25, 0.0]), "DOUBLE": ("1D", [1e300, -1e-300, 0.1]), "THREE": ("3D", [[1, 2, 3], [4, 5, 6], [7, 8, 9]]),
    "MANY": ("1PE(4)", [[1.0, 2.0], [], [3.5, 4.5, 5.5, 6.5]]), "FAR": ("1QJ(2)", [[1], [2, 3], []]), "TEXTS": ("1PA(9)", ["heap text", "", "x"]), "EMPTY": ("0A", ["", "", ""]),
}


def test_every_code_is_read_back():
    data = empty_primary() + fits_tables.write_table("T", COLUMNS)
    (header, begin), = fits_tables.table_units(io.BytesIO(data))
    known, width, n = fits_tables.fields(header), int(header["NAXIS1"]), int(header["NAXIS2"])
    records = np.frombuffer(data, np.uint8, n * width, begin).reshape(n, width)
    heap = data[begin + n * width : begin + n * width + int(header["PCOUNT"])]
    for name, (_, values) in COLUMNS.items():
        assert fits_tables.decode(records, known[name], heap) == values, name
    assert len(data) % fits.BLOCK == 0


def test_scales_nulls_and_unsigned_numbers():
    data = fits_tables.write_table("T", {"A": ("1I", [1, 2, -99]), "U": ("1J", [-(2**31), 0, 2**31 - 1]), "S": ("1B", [0, 128, 255]), "V": ("1PI(2)", [[1, 2], [3], []])}, {"TSCAL1": 0.5, "TZERO1": 10.0, "TNULL1": -99, "TZERO2": float(2**31), "TSCAL4": 2.0})
    (header, begin), = fits_tables.table_units(io.BytesIO(data))
    known, width = fits_tables.fields(header), int(header["NAXIS1"])
    records = np.frombuffer(data, np.uint8, 3 * width, begin).reshape(3, width)
    heap = data[begin + 3 * width :][: int(header["PCOUNT"])]
    got = {c: fits_tables.decode(records, f, heap) for c, f in known.items()}
    assert got == {"A": [10.5, 11.0, None], "U": [0, 2**31, 2**32 - 1], "S": [0, 128, 255], "V": [[2.0, 4.0], [6.0], []]}
    with pytest.raises(ValueError, match="TFORM1"):
        fits_tables.fields({"TFIELDS": "1", "TFORM1": "3Z", "NAXIS1": "3"})
    with pytest.raises(ValueError, match="longer"):
        fits_tables.fields({"TFIELDS": "1", "TFORM1": "3D", "NAXIS1": "8"})


def test_units_behind_a_heap_are_found(spark, tmp_path):
    """Two tables, the first with a heap that fills blocks of its own, and an image behind; records in small ranges."""
    heap = [list(range(k)) for k in range(0, 900, 9)]
    image = fits.write_plane({"XTENSION": "IMAGE"}, np.ones((2, 2), np.float32)).replace(b"SIMPLE  =                    T", b"XTENSION= 'IMAGE   '          ")
    data = empty_primary() + fits_tables.write_table("FIRST", {"X": ("1PJ(900)", heap)}) + fits_tables.write_table("BEAMS", {"BMAJ": ("1E", [3600.0 * k for k in range(50)]), "CHAN": ("1J", list(range(50)))}) + image
    (tmp_path / "a b.fits").write_bytes(data)
    (tmp_path / "none.fits").write_bytes(fits.write_plane({}, np.ones((2, 2), np.float32)))
    files = fits.list_files(spark, str(tmp_path))
    got = fits_tables.read_tables(spark, files, "beams", "CHAN int, BMAJ double, POL int, NAME string", rows_at_once=7).orderBy("row").collect()
    assert [(r["row"], r.CHAN, r.BMAJ, r.POL, r.NAME) for r in got] == [(k, k, 3600.0 * k, None, None) for k in range(50)]
    assert [r.bmaj for r in fits_tables.beams(spark, files).orderBy("chan").collect()] == pytest.approx([float(k) for k in range(50)])
    found = fits_tables.read_tables(spark, files, "FIRST", "X array<int>").orderBy("row").collect()
    assert [r.X for r in found] == heap
    assert [h["NAXIS"] for h, _ in fits.image_units(io.BytesIO(data))] == ["4"]


def test_beams_of_many_files_are_not_sent_to_all_tasks(spark):
    """A list of files says little of how much is in them, so Spark's check of sizes would send the beams of a million files to the driver."""
    from compare import SMALL

    from skycube.queries import QUERIES

    for name in ("s12_beam_tables", "s12_channel_planes"):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan

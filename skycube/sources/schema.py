"""Table schemas, and the checks at load."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS = "time_idx long, mjd double, freq_idx long, freq_hz double, pol_idx long, stokes int, l_idx long, m_idx long, l double, m double, flux double"
TILES = "time_idx long, freq_idx long, pol_idx long, tile_l long, tile_m long, l0 long, m0 long, n_l int, n_m int, data array<float>"
FILES = "path string, name string, size_bytes long, header map<string,string>"
DIMENSIONS = ("time_idx", "freq_idx", "pol_idx", "l_idx", "m_idx")
VARIABLES = ("flux",)


class CubeError(ValueError):
    """A table is not the cube that an operator needs."""


def check_cells(df: DataFrame) -> DataFrame:
    """The cube's dimensions and variables must be there; more columns may be."""
    for what, names in (("dimensions", DIMENSIONS), ("variables", VARIABLES)):
        if missing := sorted(set(names) - set(df.columns)):
            raise CubeError(f"missing {what}: {', '.join(missing)}")
    return df


def nan_to_null(df: DataFrame, *columns: str) -> DataFrame:
    """Aggregates skip NULL, not NaN: a missing pixel is NULL from here on."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def finite(c):
    return c.isNotNull() & (F.abs(c) < float("inf"))

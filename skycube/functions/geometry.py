"""Sky geometry as Column expressions. Angles are degrees unless named otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SITE_LAT, SITE_LON = 37.2339, -118.2817
# Mean sidereal time at Greenwich, hours: value at J2000.0 and hours a day.
GMST_AT_J2000, GMST_RATE, J2000_MJD = 18.697374558, 24.06570982441908, 51544.5


def lst_hours(mjd: Column, lon: float = SITE_LON) -> Column:
    """Mean local sidereal time in [0, 24). UT1-UTC is left out."""
    return F.pmod(F.lit(GMST_AT_J2000) + F.lit(GMST_RATE) * (mjd - J2000_MJD) + F.lit(lon / 15), F.lit(24.0))


def project(ra: Column, dec: Column, ra0: Column, dec0: Column) -> tuple[Column, Column, Column]:
    """Direction cosines (l, m) of a position about a centre, and whether it is in the visible half."""
    return project_from(ra, F.sin(F.radians(dec)), F.cos(F.radians(dec)), ra0, dec0)


def project_from(ra: Column, sin_dec: Column, cos_dec: Column, ra0: Column, dec0: Column) -> tuple[Column, Column, Column]:
    """``project`` of a position whose declination's sine and cosine are there already."""
    a, d0 = F.radians(ra - ra0), F.radians(dec0)
    side = cos_dec * F.cos(a)
    return cos_dec * F.sin(a), sin_dec * F.cos(d0) - side * F.sin(d0), sin_dec * F.sin(d0) + side * F.cos(d0) > 0


def unproject(l: Column, m: Column, ra0: Column, dec0: Column) -> tuple[Column, Column]:  # noqa: E741
    """Right ascension in [0, 360) and declination of direction cosines; null beyond the horizon."""
    d0 = F.radians(dec0)
    c = F.sqrt(F.when(l * l + m * m <= 1, 1 - l * l - m * m))
    dec = F.degrees(F.asin(c * F.sin(d0) + m * F.cos(d0)))
    return F.pmod(ra0 + F.degrees(F.atan2(l, c * F.cos(d0) - m * F.sin(d0))), F.lit(360.0)), dec


def lst_lm(ra: Column, dec: Column, mjd: Column, lat: float = SITE_LAT, lon: float = SITE_LON) -> tuple[Column, Column, Column]:
    """(l, m, visible) for a zenith image at a time: the projection about (LST, latitude)."""
    return project(ra, dec, lst_hours(mjd, lon) * 15, F.lit(lat))


def world_to_pixel(ra: Column, dec: Column, wcs: dict[str, Column], n_l: int, n_m: int) -> tuple[Column, Column]:
    """Nearest 0-based pixel of a SIN header (half to even); null when hidden or outside."""
    l, m, seen = project(ra, dec, wcs["crval1"], wcs["crval2"])  # noqa: E741
    x = F.rint(F.degrees(l) / wcs["cdelt1"] + wcs["crpix1"] - 1)
    y = F.rint(F.degrees(m) / wcs["cdelt2"] + wcs["crpix2"] - 1)
    inside = seen & x.between(0, n_l - 1) & y.between(0, n_m - 1)
    return F.when(inside, x.cast("long")), F.when(inside, y.cast("long"))


def header_to_pixel(ra: Column, dec: Column, header: Column, n_l: int, n_m: int) -> tuple[Column, Column]:
    """Nearest 0-based pixel by a SIN header given as a map of texts, with CDELT, PC or CD; null when hidden or outside."""
    return numbers_to_pixel(ra, dec, header_numbers(header), n_l, n_m)


def header_numbers(header: Column) -> Column:
    """Centre, reference pixel and matrix of a SIN header given as a map of texts. Texts are read here, once a header."""
    x = lambda key, default=None: F.coalesce(header[key].try_cast("double"), F.lit(default).cast("double"))
    cd = [F.coalesce(header[f"CD{i}_{j}"].try_cast("double"), x(f"CDELT{i}") * x(f"PC{i}_{j}", float(i == j))).alias(f"cd{i}_{j}") for i in (1, 2) for j in (1, 2)]
    return F.struct(*[x(key).alias(key.lower()) for key in ("CRVAL1", "CRVAL2", "CRPIX1", "CRPIX2")], *cd)


def numbers_to_pixel(ra: Column, dec: Column, wcs: Column, n_l: int, n_m: int) -> tuple[Column, Column]:
    """``header_to_pixel`` of ``header_numbers``."""
    l, m, seen = project(ra, dec, wcs["crval1"], wcs["crval2"])  # noqa: E741
    l, m = F.degrees(l), F.degrees(m)  # noqa: E741
    det = wcs["cd1_1"] * wcs["cd2_2"] - wcs["cd1_2"] * wcs["cd2_1"]
    i = F.rint((wcs["cd2_2"] * l - wcs["cd1_2"] * m) / det + wcs["crpix1"] - 1)
    j = F.rint((wcs["cd1_1"] * m - wcs["cd2_1"] * l) / det + wcs["crpix2"] - 1)
    inside = seen & i.between(0, n_l - 1) & j.between(0, n_m - 1)
    return F.when(inside, i.cast("long")), F.when(inside, j.cast("long"))


def pixel_to_world(i: Column, j: Column, wcs: dict[str, Column]) -> tuple[Column, Column]:
    l = F.radians((i + 1 - wcs["crpix1"]) * wcs["cdelt1"])  # noqa: E741
    m = F.radians((j + 1 - wcs["crpix2"]) * wcs["cdelt2"])
    return unproject(l, m, wcs["crval1"], wcs["crval2"])


def beam_pixels(bmaj: Column, bmin: Column, bpa: Column, dl: float, dm: float, lm_unit: str = "reference") -> tuple[Column, Column]:
    """Beam width along x and y in pixels, 0.5 at least.

    ``lm_unit="reference"`` divides degrees by the raw axis steps; ``"radian"`` converts the
    steps to degrees first.
    """
    unit = 180 / 3.141592653589793 if lm_unit == "radian" else 1.0
    s, c = F.sin(F.radians(bpa)), F.cos(F.radians(bpa))
    x = F.sqrt((bmaj * s) ** 2 + (bmin * c) ** 2) / abs(dm * unit)
    y = F.sqrt((bmaj * c) ** 2 + (bmin * s) ** 2) / abs(dl * unit)
    return F.greatest(x, F.lit(0.5)), F.greatest(y, F.lit(0.5))


def separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Angle between two positions (haversine)."""
    h = F.sin(F.radians(dec2 - dec1) / 2) ** 2 + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * F.sin(F.radians(ra2 - ra1) / 2) ** 2
    return F.degrees(2 * F.asin(F.least(F.lit(1.0), F.sqrt(h))))


def _sexagesimal(value: Column, pattern: str) -> Column:
    tenths = F.rint(F.abs(value) * 36000).cast("long")
    return F.format_string(pattern, (tenths / 36000).cast("long"), F.floor(tenths / 600) % 60, (tenths % 600) / 10)


def format_ra(ra: Column) -> Column:
    """hh:mm:ss.s"""
    return _sexagesimal(F.pmod(ra, F.lit(360.0)) / 15, "%02d:%02d:%04.1f")


def format_dec(dec: Column) -> Column:
    """+dd:mm:ss.s"""
    return F.concat(F.when(dec < 0, "-").otherwise("+"), _sexagesimal(dec, "%02d:%02d:%04.1f"))


NUMBER = r"([+-]?[0-9]+(?:\.[0-9]*)?)"
PAIR = rf"^\s*{NUMBER}\s*[, ]\s*{NUMBER}\s*$"
JNAME = r"^J([0-9]{2})([0-9]{2})([0-9]{2}(?:\.[0-9]+)?)([+-])([0-9]{2})([0-9]{2})([0-9]{2}(?:\.[0-9]+)?)$"


def parse_coordinates(text: Column) -> tuple[Column, Column]:
    """Position from ``ra dec`` in degrees or ``Jhhmmss.s+ddmmss``; null if out of range or another form."""
    part = lambda k: F.regexp_extract(text, JNAME, k).try_cast("double")
    a, d = (F.regexp_extract(text, PAIR, k).try_cast("double") for k in (1, 2))
    named = F.rlike(text, F.lit(JNAME))
    ra = F.when(named, (part(1) + part(2) / 60 + part(3) / 3600) * 15).otherwise(a)
    dec = F.when(named, (part(5) + part(6) / 60 + part(7) / 3600) * F.when(F.regexp_extract(text, JNAME, 4) == "-", -1).otherwise(1)).otherwise(d)
    ok = ra.between(0, 360) & dec.between(-90, 90)
    return F.when(ok, ra), F.when(ok, dec)

"""What names, headers and times of files say, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MHZ = r"(?:^|_)([0-9]+(?:\.[0-9]+)?)MHz(?=[_\-.]|$)"
STOKES = (r"MHz[_-]([IV])[_-]", r"[_-]([IV])[_-]image", r"[_-]([IV])[_-](?:Taper|deep|[0-9]+min)", r"_([IV])_", r"[_-]([IV])(?:\.[A-Za-z.]+)?$")
STAMP = r"([0-9]{8}_[0-9]{6})"
LST_STAMP = r"([0-9]{8}_LST[0-9]{2}h_t[0-9]{4})"
MJD_UNIX = 40587


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, NULL without one; evaluated once."""
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(0))


def subband_mhz(name: Column) -> Column:
    return found(name, MHZ).try_cast("double")


def stokes(name: Column, header: Column | None = None) -> Column:
    """Stokes code: the first pattern that the name has, the header's, or 1 (I)."""
    letter = reduce(lambda a, b: F.coalesce(a, b), [found(name, p) for p in STOKES])
    code = F.create_map(F.lit("I"), F.lit(1), F.lit("V"), F.lit(4))[letter]
    return F.coalesce(code, header.try_cast("int") if header is not None else F.lit(None).cast("int"), F.lit(1))


def time_key(name: Column, directory: Column | None = None, date_obs: Column | None = None) -> Column:
    """``YYYYMMDD_HHMMSS`` or the LST form, from the name, the header's date, the directory."""
    options = [found(name, LST_STAMP), found(name, STAMP)]
    if date_obs is not None:
        options.append(F.date_format(F.try_to_timestamp(date_obs), "yyyyMMdd_HHmmss"))
    if directory is not None:
        options += [found(directory, r"([0-9]{8}_LST[0-9]{2}h)"), F.concat(found(directory, r"([0-9]{8})"), F.lit("_000000"))]
    return F.coalesce(*options)


def frequency(header: Column, name: Column | None = None) -> Column:
    """Hz from RESTFREQ, RESTFRQ, CRVAL3, FREQ, or the name's subband."""
    options = [header[k].try_cast("double") for k in ("RESTFREQ", "RESTFRQ", "CRVAL3", "FREQ")]
    return F.coalesce(*options, *([subband_mhz(name) * 1e6] if name is not None else []))


def key_timestamp(key: Column) -> Column:
    return F.try_to_timestamp(found(key, STAMP), F.lit("yyyyMMdd_HHmmss"))


def mixed_time_key(value: Column) -> Column:
    """A time key from text that may be a key already, an MJD, a Unix time in s or ns, or an ISO date; NULL for none."""
    x = value.try_cast("double")
    us = F.when(x > 1e15, x / 1e3).when(x > 1e6, x * 1e6).when(x > 0, (x - MJD_UNIX) * 86_400_000_000)
    numeric = F.date_format(F.timestamp_micros(F.rint(us / 1e6).cast("long") * 1_000_000), "yyyyMMdd_HHmmss")
    return F.coalesce(found(value, LST_STAMP), found(value, STAMP), numeric, F.date_format(F.try_to_timestamp(value), "yyyyMMdd_HHmmss"))


def mjd(ts: Column) -> Column:
    """Modified Julian date of a timestamp."""
    return F.unix_micros(ts.cast("timestamp")) / 86_400_000_000 + MJD_UNIX


def mjd_timestamp(value: Column) -> Column:
    return F.timestamp_micros(F.rint((value - MJD_UNIX) * 86_400_000_000).cast("long"))


def beam_reason(bmaj: Column, bmin: Column) -> Column:
    """Why a beam can't be used; null for a good one. Header values are text."""

    def one(name: str, raw: Column) -> Column:
        x = raw.try_cast("double")
        return (
            F.when(raw.isNull() | (raw == ""), f"{name} missing")
            .when(x.isNull(), f"{name} not a number")
            .when(F.isnan(x) | (F.abs(x) == float("inf")), f"{name} not finite")
            .when(x <= 0, f"{name} not positive")
        )

    return F.coalesce(one("BMAJ", bmaj), one("BMIN", bmin))


def truncated_reason(size: Column, naxis1: Column, naxis2: Column, bitpix: Column) -> Column:
    """Why a file is too short for what its header says; null if it isn't."""
    need = naxis1 * naxis2 * F.abs(bitpix) / 8
    return F.when(size == 0, "empty").when(size < need, "truncated")


def elapsed_days(value: Column, first: Column, largest: Column) -> Column:
    """Days since the first sample; the unit (MJD, s, ns) shows in the largest magnitude."""
    unit = F.when(largest > 1e15, 86400e9).when(largest > 1e6, 86400.0).otherwise(1.0)
    return (value - first) / unit


def band_mhz(band: Column) -> Column:
    return found(band, r"^([0-9]+(?:\.[0-9]+)?)\s*MHz$").try_cast("double")


def lst_hour(text: Column) -> Column:
    hour = found(text, r"^([0-9]{1,2})h$").try_cast("int")
    return F.when(hour <= 23, hour)


def candidate_url(base: str, source: Column) -> Column:
    return F.concat(F.lit(base), F.replace(F.url_encode(source), F.lit("+"), F.lit("%20")))

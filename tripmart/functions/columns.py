"""Scalar expressions shared by the layers. Each returns a Column and never triggers a job."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EARTH_RADIUS_KM = 6371.0088


def typed(df: DataFrame, schema: T.StructType) -> list[Column]:
    """Every field of `schema`, tolerantly cast; a column that `df` lacks becomes a typed null."""
    have = set(df.columns)
    return [
        (F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType))
        .alias(f.name)
        for f in schema.fields
    ]


def pseudonym(col: Column, pepper: str = "") -> Column:
    """SHA-256 of the text; null stays null. Without a pepper equal text gives equal keys anywhere."""
    return F.sha2(F.concat(F.lit(pepper), col) if pepper else col, 256)


def fingerprint(df: DataFrame, exclude: Iterable[str]) -> Column:
    """Content hash over all columns but `exclude`, by name, so column order does not matter.

    JSON with nulls kept tells (null, 'a') from ('a', null) and is safe against delimiters in values.
    """
    cols = _business_columns(df, exclude)
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


def fingerprint_joined(df: DataFrame, exclude: Iterable[str], delimiter: str = "|") -> Column:
    """Compatible form of `fingerprint` over delimiter-joined text; nulls are skipped, so it can collide."""
    cols = _business_columns(df, exclude)
    return F.sha2(F.concat_ws(delimiter, *[F.col(f"`{c}`").cast("string") for c in cols]), 256)


def _business_columns(df: DataFrame, exclude: Iterable[str]) -> list[str]:
    out = set(exclude)
    return sorted(c for c in df.columns if c not in out)


def message(columns: Sequence[str]) -> Column:
    """The row as one JSON text with null fields kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def calendar(ts: str = "booking_timestamp") -> list[Column]:
    """Booking date and hour, for reports that need no timestamp."""
    return [F.to_date(ts).alias("booking_date"), F.hour(ts).alias("booking_hour")]


def money(col: Column | str) -> Column:
    """Exact two-digit decimal, so that sums do not depend on the order of rows."""
    return (F.col(col) if isinstance(col, str) else col).cast("decimal(18,2)")


def sum_money(col: Column | str) -> Column:
    return F.sum(money(col)).cast("double")


def band(value: Column, bands: Sequence[tuple]) -> Column:
    """Label of the first band (label, upper bound) with value <= bound; null stays null."""
    return _first_band(value, [(upper, F.lit(label)) for label, upper in bands])


def _first_band(value: Column, bounded: Sequence[tuple]) -> Column:
    out = None
    for upper, result in bounded:
        hit = value.isNotNull() if upper == float("inf") else value <= F.lit(upper)
        out = F.when(hit, result) if out is None else out.when(hit, result)
    return out


def band_value(value: Column, bands: Sequence[tuple], position: int) -> Column:
    """Number at `position` of the first band (upper, n1, n2, ...) that holds `value`."""
    return _first_band(value, [(b[0], F.lit(float(b[position]))) for b in bands])


def in_any_range(value: Column, ranges: Sequence[tuple]) -> Column:
    """True inside any of the ranges, ends included."""
    out = F.lit(False)
    for low, high in ranges:
        out = out | value.between(low, high)
    return out


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance on the mean sphere; within about 0.5 % of the ellipsoid."""
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    h = (F.sin(half_lat) * F.sin(half_lat)
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon))
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def minutes_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(60e6)


def active(flag: str = "is_active") -> Column:
    """A row with no flag counts as active."""
    return F.coalesce(F.col(flag), F.lit(True))

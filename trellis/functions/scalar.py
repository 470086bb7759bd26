"""Scalar functions whose meaning differs from the built-in ones of nearly the same name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column) -> Column:
    """Halves go up: round(-2.5) is -2."""
    return F.floor(x + F.lit(0.5))


def encode_for_uri(s: Column) -> Column:
    out = F.url_encode(s)
    for a, b in ((r"\+", "%20"), (r"\*", "%2A"), ("%7E", "~")):
        out = F.regexp_replace(out, a, b)
    return out


def before(s: Column, sep: Column) -> Column:
    at = F.position(sep, s)
    return F.when(at > 0, F.substring(s, F.lit(1), at - 1)).otherwise(F.lit(""))


def after(s: Column, sep: Column) -> Column:
    at = F.position(sep, s)
    return F.when(at > 0, F.substring(s, at + F.char_length(sep), F.char_length(s))).otherwise(F.lit(""))


def regex_pattern(pattern: str, flags: str = "") -> str:
    """A pattern with its flags: i, s, m, x as in Java, q for a literal."""
    if "q" in flags:
        pattern = "\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    inline = "".join(f for f in "imsx" if f in flags)
    return f"(?{inline}){pattern}" if inline else pattern


def sequence(start: Column, end: Column, step: Column) -> Column:
    """Inclusive; empty where the step leads away from the end (Spark would turn round)."""
    fits = ((step > 0) & (start <= end)) | ((step < 0) & (start >= end))
    return F.when(fits, F.sequence(start, end, step)).otherwise(F.array().cast("array<bigint>"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


EARTH_METRES = 6371008.8


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_METRES) * F.asin(F.least(F.sqrt(a), F.lit(1.0)))

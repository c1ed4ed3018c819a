"""Scalar rules on text, times and bytes, all as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and formats of catalogue records.
EMAIL_PATTERN = r"^[\w\.-]+@[\w\.-]+\.\w+$"
IDENTIFIER_TYPES = ["DOI", "CSTR", "InternalID"]
DATE_FORMAT = "yyyy-MM-dd"
KEYWORD_SEPARATOR = ";"


def uri_dataset(uri: Column) -> Column:
    """``scheme://host/first`` of a URI: the name of the dataset it belongs to."""
    return F.regexp_extract(uri, r"^([^:/?#]+://[^/?#]*/[^/?#]*)", 1)


def uri_relative_path(uri: Column) -> Column:
    """The path after the first segment, with a leading slash; no query, no fragment."""
    return F.concat(F.lit("/"), F.regexp_extract(uri, r"^[^:/?#]+://[^/?#]*/[^/?#]*/([^?#]*)", 1))


def keywords(text: Column) -> Column:
    return F.split(text, KEYWORD_SEPARATOR)


def iso_date(text: Column) -> Column:
    """A date written ``2024-01-31``, else null."""
    exact = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), text)
    return F.try_to_date(exact, "yyyy-M-d")


def valid_email(text: Column) -> Column:
    # word characters are Unicode ones, as in the catalogue's own check
    return text.rlike("(?U)" + EMAIL_PATTERN)


def valid_identifier(kind: Column) -> Column:
    return kind.isin(IDENTIFIER_TYPES)


def valid_url(text: Column) -> Column:
    return text.rlike(r"^https?://[^\s/?#]+\S*$")


def epoch_days(ts: Column) -> Column:
    """Whole days since 1970-01-01 as a double."""
    return F.date_diff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("double")


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of a zone-free timestamp, whatever the session zone."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds = (ts.cast("timestamp_ntz") - start).cast("interval second").cast("decimal(20,6)")
    return (seconds * 1_000_000).cast("bigint")


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def digest(data: Column, algorithm: str = "md5") -> Column:
    """Hex digest of text or bytes: md5, sha1, sha224, sha256, sha384 or sha512."""
    if algorithm == "md5":
        return F.md5(data)
    if algorithm == "sha1":
        return F.sha1(data)
    return F.sha2(data, int(algorithm.removeprefix("sha")))


def base64_matches(encoded: Column, expected_digest: Column, algorithm: str = "md5") -> Column:
    """Whether base64 text decodes to bytes with the expected digest."""
    return digest(F.unbase64(encoded), algorithm) == expected_digest


def decode_map(column: Column) -> Column:
    """A map of bytes to bytes as a map of text to text."""
    keys = F.transform(F.map_keys(column), lambda k: F.decode(k, "UTF-8"))
    values = F.transform(F.map_values(column), lambda v: F.decode(v, "UTF-8"))
    return F.map_from_arrays(keys, values)


def ratio(numerator: Column, denominator: Column) -> Column:
    """A rate that is 0 where no time has passed."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))

"""Validators as boolean Columns that are never null, and errors as arrays of codes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats, and hex digits of each hash. A text ends at \z: $ would let a line feed follow.
OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
DOTTED = rf"({OCTET}\.){{3}}{OCTET}"
GROUP = "[0-9a-fA-F]{1,4}"
IPV6 = "^(" + "|".join([f"({GROUP}:){{7}}{GROUP}", "::"] + [f"({GROUP}:){{{n}}}(:{GROUP}){{1,{7 - n}}}" for n in range(1, 7)] + [f":(:{GROUP}){{1,7}}", f"({GROUP}:){{1,7}}:"]) + r")\z"
UUID4 = r"^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z"
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
UTC = r"^(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?Z\z"
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+\z"
URL = r"^[a-zA-Z][a-zA-Z0-9+.-]*://\S+\z"
HOSTNAME = r"^[a-zA-Z0-9]([a-zA-Z0-9.-]*[a-zA-Z0-9])?\z"
SEMVER = r"^(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)(-[0-9A-Za-z-]+(\.[0-9A-Za-z-]+)*)?(\+[0-9A-Za-z-]+(\.[0-9A-Za-z-]+)*)?\z"
HASHES = {"md5": 32, "sha1": 40, "sha256": 64, "sha512": 128}
#: Hex digits of any hash, characters of a host name at most.
LEAST_HASH, MOST_HASH, MOST_HOSTNAME = 32, 128, 253


def matches(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(pattern), F.lit(False))


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def exact_ipv4(text: Column) -> Column:
    return matches(text, rf"^{DOTTED}\z")


def exact_ipv6(text: Column) -> Column:
    """A dotted address may stand for the last two groups, and a zone may follow after %."""
    address = F.regexp_replace(text, r"%[^%]+\z", "")
    return matches(F.regexp_replace(address, rf":{DOTTED}\z", ":0:0"), IPV6)


def exact_ip(text: Column) -> Column:
    return exact_ipv4(text) | exact_ipv6(text)


def is_ipv4(text: Column) -> Column:
    return exact_ipv4(stripped(text))


def is_ipv6(text: Column) -> Column:
    return exact_ipv6(stripped(text))


def is_ip(text: Column) -> Column:
    return is_ipv4(text) | is_ipv6(text)


def is_hash(text: Column, length: int | None = None) -> Column:
    found = matches(stripped(text), rf"^[0-9a-fA-F]{{{LEAST_HASH},{MOST_HASH}}}\z")
    return found if length is None else found & (F.length(stripped(text)) == length)


def is_email(text: Column) -> Column:
    return matches(stripped(text), EMAIL)


def is_url(text: Column) -> Column:
    """Absolute, of any scheme."""
    return matches(stripped(text), URL)


def is_hostname(text: Column) -> Column:
    return matches(stripped(text), HOSTNAME) & (F.coalesce(F.length(stripped(text)), F.lit(0)) <= MOST_HOSTNAME)


def is_uuid(text: Column) -> Column:
    """Of any version and in any notation: with prefix urn:uuid:, in braces, without hyphens."""
    digits = F.regexp_replace(F.regexp_replace(F.regexp_replace(stripped(text), "urn:|uuid:", ""), r"^[{}]+|[{}]+\z", ""), "-", "")
    return matches(digits, r"^[0-9a-fA-F]{32}\z")


def is_uuid4(text: Column) -> Column:
    return matches(text, UUID4)


def is_canonical_uuid(text: Column) -> Column:
    return matches(text, UUID)


def utc_time(text: Column) -> Column:
    """The time of an RFC 3339 text that ends in Z, else null."""
    return F.when(matches(text, UTC), F.try_to_timestamp(text))


def in_range(value: Column, low: float, high: float) -> Column:
    return F.coalesce(value.between(low, high), F.lit(False))


def non_empty(text: Column) -> Column:
    return F.coalesce(F.length(text) > 0, F.lit(False))


def failures(rules: dict[str, Column]) -> Column:
    """Names of all rules that do not hold, in order; null counts as not holding."""
    named = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    return F.array_except(named, F.array(F.lit(None).cast("string")))  # array_compact() would have the rules interpreted


def valid_regex(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True

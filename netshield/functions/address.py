"""IP address expressions.

Addresses compare as fixed-width upper-case hex text (8 digits for IPv4, 32 for IPv6), so one
string comparison orders both families without a UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4_TEXT = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_V4 = rf"\A{_V4_TEXT}\z"
_V4_TAIL = rf"(?<=:){_V4_TEXT}\z"
_HEXTET = r"[0-9a-fA-F]{1,4}"
_RUN = rf"{_HEXTET}(?::{_HEXTET})*"
_V6 = (
    rf"\A(?:{_HEXTET}(?::{_HEXTET}){{7}}"
    rf"|(?!(?::*{_HEXTET}(?=:|\z)){{8}})(?:{_RUN})?::(?:{_RUN})?)\z"
)


def is_ipv4(ip: Column) -> Column:
    """True for a dotted quad without leading zeros; anything else, NULL included, is False."""
    return F.coalesce(ip.rlike(_V4), F.lit(False))


def _v4_hex(ip: Column) -> Column:
    octets = [F.split_part(ip, F.lit("."), F.lit(i)).try_cast("bigint") for i in (1, 2, 3, 4)]
    return F.concat(*[F.lpad(F.hex(octet), 2, "0") for octet in octets])


def _hextet_digits(text: Column) -> Column:
    """Every hextet padded to four digits, colons dropped."""
    longer = F.regexp_replace(text, _HEXTET, "000$0")
    return F.translate(
        F.regexp_replace(longer, r"[0-9a-fA-F]{0,3}([0-9a-fA-F]{4})(?=:|\z)", "$1"), ":", "")


def _v6_digits(ip: Column) -> Column:
    """Hex text of an IPv6 address without dotted tail; NULL when malformed."""
    left = _hextet_digits(F.split_part(ip, F.lit("::"), F.lit(1)))
    right = _hextet_digits(F.split_part(ip, F.lit("::"), F.lit(2)))
    filled = F.concat(F.rpad(left, F.lit(32) - F.length(right), F.lit("0")), right)
    return F.when(ip.rlike(_V6), F.upper(filled))


def _v6_hex(ip: Column) -> Column:
    dotted = F.concat(
        F.left(_v6_digits(F.regexp_replace(ip, _V4_TAIL, "0:0")), F.lit(24)),
        _v4_hex(F.regexp_substr(ip, F.lit(_V4_TAIL))))
    return F.when(ip.contains("."), dotted).otherwise(_v6_digits(ip))


def ip_hex(ip: Column) -> Column:
    """Sortable fixed-width hex text of an address; NULL when it is not a valid address."""
    return F.when(ip.rlike(_V4), _v4_hex(ip)).when(ip.contains(":"), _v6_hex(ip))


def hex_family(digits: Column) -> Column:
    """4 or 6, from the width of the hex text."""
    return F.when(F.length(digits) == 8, 4).when(F.length(digits) == 32, 6)


def prefix_bound(digits: Column, plen: Column, fill: str) -> Column:
    """First (``fill='0'``) or last (``fill='F'``) address of a prefix, host bits replaced."""
    whole = F.floor(plen / 4).cast("int")
    spare = plen % 4
    digit = F.conv(F.substring(digits, whole + 1, F.lit(1)), 16, 10).try_cast("int")
    step = F.element_at(F.array(F.lit(16), F.lit(8), F.lit(4), F.lit(2)), spare + 1)
    first = digit - digit % step
    edge = first if fill == "0" else first + step - 1
    kept = F.concat(
        F.left(digits, whole), F.when(spare == 0, F.lit("")).otherwise(F.hex(edge.cast("bigint")))
    )
    return F.rpad(kept, F.length(digits), fill)

"""IPv4 expressions: text to number, range tests, host hints."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from netquarry.functions.lists import INTERNAL_RANGES

# One decimal octet without leading zeros, and a whole address of them.
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
STRICT_QUAD = rf"^{OCTET}(?:\.{OCTET}){{3}}$"
# What host inventories keep: four groups of one to three digits.
LOOSE_QUAD = r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"


def ip_to_long(c: Column) -> Column:
    """Dotted quad to bigint; anything else, IPv6 included, is null."""
    octets = F.transform(F.split(c, r"\."), lambda o: o.cast("bigint"))
    return F.when(
        c.rlike(STRICT_QUAD),
        F.aggregate(octets, F.lit(0).cast("bigint"), lambda total, o: total * 256 + o),
    )


def cidr_bounds(cidr: str) -> tuple[int, int, int] | None:
    """(lowest address, highest address, prefix length), or None for a bad CIDR."""
    try:
        net = ipaddress.ip_network(str(cidr), strict=False)
    except ValueError:
        return None
    if net.version != 4:
        return None
    return int(net.network_address), int(net.broadcast_address), net.prefixlen


def cidr_regex(cidr: str) -> str | None:
    """Pattern of the addresses in a network: fixed octets, one range of values, any octet."""
    bounds = cidr_bounds(cidr)
    if bounds is None:
        return None
    parts = []
    for shift in (24, 16, 8, 0):
        low, high = (bounds[0] >> shift) & 255, (bounds[1] >> shift) & 255
        if (low, high) == (0, 255):
            parts.append(OCTET)
        else:
            parts.append("(?:" + "|".join(str(v) for v in range(low, high + 1)) + ")")
    return r"\.".join(parts)


def in_networks(c: Column, cidrs: Iterable[str]) -> Column:
    """Membership in a short literal list of networks; bad CIDRs are ignored.

    One regular expression per list: the address is matched once, however many networks.
    """
    patterns = [p for p in map(cidr_regex, cidrs) if p]
    if not patterns:
        return F.lit(False)
    return F.coalesce(c.rlike("^(?:" + "|".join(patterns) + ")$"), F.lit(False))


def is_internal(c: Column) -> Column:
    return in_networks(c, INTERNAL_RANGES)


def is_external(c: Column) -> Column:
    """A dotted quad outside the internal ranges."""
    return F.coalesce(c.rlike(LOOSE_QUAD), F.lit(False)) & ~is_internal(c)


def ip_values(c: Column) -> Column:
    """Comma-joined text to an array of the dotted quads in it."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x.rlike(LOOSE_QUAD))


def first_value(c: Column) -> Column:
    """First entry of comma-joined text, null when empty. Single values are not taken apart."""
    several = F.nullif(F.trim(F.substring_index(c, ",", 1)), F.lit(""))
    return F.when(c.contains(","), several).when(c != "", c)


def ttl_to_os(c: Column) -> Column:
    """Operating-system family from a time-to-live value."""
    ttl = c.try_cast("int")
    return (
        F.when(ttl.isNull(), "unknown")
        .when(ttl <= 32, "windows-old/printer")
        .when(ttl <= 64, "linux/macos")
        .when(ttl <= 128, "windows")
        .otherwise("network-device")
    )

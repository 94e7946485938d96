"""Address functions."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, functions as F

from .. import constants as C
from .text import py_strip


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _any_prefix(v: Column, prefixes: list[str]) -> Column:
    out = None
    for p in prefixes:
        c = v.startswith(p)
        out = c if out is None else (out | c)
    return out


def ipv4_to_long(col) -> Column:
    """dotted quad -> a*2^24 + b*2^16 + c*2^8 + d.

    Only the first four parts are used (extra parts ignored), there is no range
    check, and any unparsable part, fewer than four parts or a value beyond a
    long gives 0.
    """
    parts = F.split(_c(col).cast("string"), r"\.")

    def part(i):
        # int() accepts surrounding whitespace and a sign, not decimals; the
        # string -> bigint cast trims whitespace itself
        return F.get(parts, i).try_cast("bigint")

    total = part(3)
    for i, weight in enumerate((16_777_216, 65_536, 256)):
        total = F.try_add(total, F.try_multiply(part(i), F.lit(weight).cast("bigint")))
    return F.coalesce(total, F.lit(0).cast("bigint"))


def is_external_ip(col) -> Column:
    """0 for blanks, private prefixes, 172.16-31, loopback/any; else 1."""
    v = py_strip(F.coalesce(_c(col).cast("string"), F.lit("nan")))
    second = F.get(F.split(v, r"\."), 1).try_cast("int")
    internal = (
        (v == "")
        | F.lower(v).isin(C.EXTERNAL_IP_BLANKS)
        | _any_prefix(v, C.INTERNAL_IP_PREFIXES)
        | (F.startswith(v, F.lit("172.")) & second.between(16, 31))
        | v.isin(C.INTERNAL_IP_EXACT)
    )
    return F.when(internal, 0).otherwise(1)


# FIXED VALUES: the special-purpose address registries as Python's ipaddress
# module applies them: private networks and the public exceptions inside them.
PRIVATE_V4 = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16),
    ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.0.170", 31), ("192.0.2.0", 24),
    ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24),
    ("203.0.113.0", 24), ("240.0.0.0", 4), ("255.255.255.255", 32),
]
PUBLIC_V4 = [("192.0.0.9", 32), ("192.0.0.10", 32)]
PRIVATE_V6 = [
    ("::1", 128), ("::", 128), ("::ffff:0:0", 96), ("64:ff9b:1::", 48), ("100::", 64),
    ("2001::", 23), ("2001:db8::", 32), ("2002::", 16), ("fc00::", 7), ("fe80::", 10),
]
PUBLIC_V6 = [
    ("2001:1::1", 128), ("2001:1::2", 128), ("2001:3::", 32), ("2001:4:112::", 48),
    ("2001:20::", 28), ("2001:30::", 28),
]

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_QUAD = rf"({_OCTET}\.){{3}}{_OCTET}"


def _in_v4(value: Column, networks: list[tuple[str, int]]) -> Column:
    """Whether a 32-bit number lies in one of the networks."""
    out = F.lit(False)
    for net, size in networks:
        low = int(ipaddress.IPv4Address(net))
        out = out | value.between(low, low + (1 << (32 - size)) - 1)
    return out


def _in_v6(groups: Column, networks: list[tuple[str, int]]) -> Column:
    """Whether eight 16-bit groups lie in one of the networks."""
    out = F.lit(False)
    for net, size in networks:
        whole = ipaddress.IPv6Address(net).packed
        hit = F.lit(True)
        for i in range(0, -(-size // 16)):
            spare = max(0, 16 * (i + 1) - size)
            want = int.from_bytes(whole[2 * i:2 * i + 2], "big") >> spare
            hit = hit & (F.shiftright(F.get(groups, F.lit(i)), spare) == want)
        out = out | hit
    return out


def _v4_public(value: Column) -> Column:
    return ~_in_v4(value, PRIVATE_V4) | _in_v4(value, PUBLIC_V4)


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _all_groups(sides: Column) -> Column:
    """Group texts of the one or two sides of ``::``, filled up to eight; null
    if their number is wrong."""
    def groups(i: int) -> Column:
        side = F.coalesce(F.get(sides, F.lit(i)), F.lit(""))
        return F.filter(F.split(side, ":"), lambda g: side != "")

    def filled(both: Column) -> Column:
        missing = F.lit(8) - F.size(both["l"]) - F.size(both["r"])
        return F.when(F.size(sides) == 1, F.when(missing == 0, both["l"])).when(
            (F.size(sides) == 2) & (missing >= 1),
            F.concat(both["l"], F.array_repeat(F.lit("0"), missing), both["r"]))
    return _let(F.struct(groups(0).alias("l"), groups(1).alias("r")), filled)


def _unquad(low: Column) -> Column:
    """A dotted tail written as two groups."""
    tail = F.regexp_extract(low, rf":({_QUAD})$", 1)
    return _let(F.struct(tail.alias("t"), ipv4_to_long(tail).alias("n")), lambda x: F.when(x["t"] == "", low).otherwise(
        F.concat(F.substring(low, F.lit(1), F.length(low) - F.length(x["t"])),
                 F.lower(F.hex(F.shiftright(x["n"], 16))), F.lit(":"),
                 F.lower(F.hex(x["n"].bitwiseAND(F.lit(0xFFFF)))))))


def ipv6_groups(text: Column) -> Column:
    """The eight groups of an IPv6 text as an array of numbers, or null if it
    is not one.  A dotted tail stands for two groups, ``::`` for one or more."""
    low = F.regexp_replace(F.lower(text), r"%[^%]+$", "")
    texts = _let(low, lambda x: _let(F.split(_unquad(x), "::"), _all_groups))
    return _let(texts, lambda g: F.when(F.forall(g, lambda x: x.rlike("^[0-9a-f]{1,4}$")),
                                        F.transform(g, lambda x: F.conv(x, 16, 10).cast("int"))))


def _v6_public(groups: Column) -> Column:
    mapped = F.get(groups, F.lit(6)).cast("bigint") * 65_536 + F.get(groups, F.lit(7))
    return F.when(_in_v6(groups, [("::ffff:0:0", 96)]), _let(mapped, _v4_public)).otherwise(
        ~_in_v6(groups, PRIVATE_V6) | _in_v6(groups, PUBLIC_V6))


def is_external_ip_strict(col) -> Column:
    """``ipaddress.ip_address(x).is_private`` -> 0, public -> 1, invalid -> 0.

    IPv4 text must be four decimal octets 0-255 without leading zeros.  IPv6
    text is parsed to its eight groups; an IPv4-mapped address is judged by
    the IPv4 address inside it."""
    v = _c(col).cast("string")
    public = F.when(v.rlike(rf"^{_QUAD}$"), _let(ipv4_to_long(v), _v4_public)).when(
        v.contains(":"), _let(ipv6_groups(v), _v6_public))
    return F.coalesce(public, F.lit(False)).cast("int")

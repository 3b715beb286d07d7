"""Addresses and networks as Columns."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

_V4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$"

#: The private, loopback and link-local networks.
PRIVATE_NETWORKS = [
    "10.0.0.0/8",
    "172.16.0.0/12",
    "192.168.0.0/16",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "::1/128",
    "fc00::/7",
    "fe80::/10",
]


def ipv4_number(column: Column) -> Column:
    """Dotted address to a long, NULL for anything else."""
    parts = F.split(column, r"\.")
    number = F.lit(0).cast("long")
    for index in range(4):
        number = number * 256 + F.get(parts, F.lit(index)).try_cast("long")
    return F.when(column.rlike(_V4), number)


def ipv6_hex(column: Column) -> Column:
    """IPv6 address to 32 hex digits, NULL for anything else."""
    text = F.lower(column)
    halves = F.split(text, "::", -1)

    def groups(side: Column) -> Column:
        return F.when(side == "", F.array().cast("array<string>")).otherwise(F.split(side, ":"))

    left = groups(F.get(halves, F.lit(0)))
    right = groups(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
    missing = F.lit(8) - F.size(left) - F.size(right)
    filled = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
    digits = F.array_join(F.transform(filled, lambda g: F.lpad(g, 4, "0")), "")
    # without a double colon all eight groups must be there
    whole = (F.size(halves) == 2) | ((F.size(halves) == 1) & (F.size(left) == 8))
    shaped = text.rlike("^[0-9a-f:]+$") & text.contains(":") & whole
    return F.when(shaped & F.forall(filled, lambda g: F.length(g).between(1, 4)) & (F.length(digits) == 32), digits)


def in_networks(column: Column, networks: list[str]) -> Column:
    """True when the address lies in one of the networks; both families."""
    tests = []
    v4, v6 = ipv4_number(column), ipv6_hex(column)
    for text in networks:
        network = ipaddress.ip_network(text, strict=False)
        first, last = int(network.network_address), int(network.broadcast_address)
        if network.version == 4:
            tests.append(v4.between(F.lit(first).cast("long"), F.lit(last).cast("long")))
        else:
            tests.append(v6.between(F.lit(f"{first:032x}"), F.lit(f"{last:032x}")))
    result = F.lit(False)
    for test in tests:
        result = result | F.coalesce(test, F.lit(False))
    return result


def ip_scope(column: Column) -> Column:
    """``private`` or ``public``; NULL for text that is no address."""
    known = ipv4_number(column).isNotNull() | ipv6_hex(column).isNotNull()
    return F.when(known, F.when(in_networks(column, PRIVATE_NETWORKS), F.lit("private")).otherwise(F.lit("public")))

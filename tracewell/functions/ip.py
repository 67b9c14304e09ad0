"""IP addresses as 16 bytes, IPv4 mapped into IPv6, and back to canonical text.

IPv4 stays in generated code. IPv6 texts take a longer way through bound values (``_let``), which
only their rows evaluate.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_MAPPED = "00000000000000000000FFFF"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _v4_hex(text: Column) -> Column:
    octets = F.split(text, r"\.")
    return F.concat(*(F.lpad(F.hex(F.try_element_at(octets, F.lit(i)).try_cast("int")), 2, "0") for i in range(1, 5)))


def normalize_ip(text: Column) -> Column:
    """16 bytes of an address in text, null where it is none.

    IPv4 octets take no leading zeros. IPv6 takes one ``::`` for at least one zero group, a dotted
    tail and a zone (dropped; not after a mapped IPv4 address). Give it a plain column: the
    expression names its argument several times.
    """
    v4 = F.concat(F.lit(_MAPPED), _v4_hex(text))
    return F.unhex(F.when(text.rlike(rf"^{_V4}\z"), v4).when(text.contains(":") & ~text.endswith("%"), _let(text, _v6_hex)))


def _v6_hex(text: Column) -> Column:
    bare = F.regexp_replace(text, "%.+$", "")

    def dotted(bare: Column) -> Column:
        tail = F.regexp_extract(bare, rf":({_V4})\z", 1)
        packed = _let(tail, _v4_hex)
        head = F.substring(bare, F.lit(1), F.length(bare) - F.length(tail))
        return F.when(tail == "", bare).otherwise(F.concat(head, F.substring(packed, 1, 4), F.lit(":"), F.substring(packed, 5, 4)))

    def filled(halves: Column) -> Column:
        part = lambda i: F.filter(F.split(F.coalesce(F.try_element_at(halves, F.lit(i)), F.lit("")), ":"), lambda g: F.element_at(halves, i) != "")
        short = F.size(halves) == 2
        zeros = 8 - F.size(part(1)) - F.size(part(2))
        return F.when(short & (zeros >= 1), F.concat(part(1), F.array_repeat(F.lit("0"), zeros), part(2))).when((F.size(halves) == 1) & (F.size(part(1)) == 8), part(1))

    def packed(groups: Column) -> Column:
        good = F.forall(groups, lambda g: g.rlike(r"^[0-9A-Fa-f]{1,4}\z"))
        return F.when(good, F.array_join(F.transform(groups, lambda g: F.lpad(F.upper(g), 4, "0")), ""))

    whole = _let(_let(F.split(_let(bare, dotted), "::", -1), filled), packed)
    return F.when(text.contains("%"), _let(whole, lambda h: F.when(~h.startswith(_MAPPED), h))).otherwise(whole)


def format_ip(address: Column) -> Column:
    """Text of 16 bytes: dotted if IPv4-mapped, else shortest IPv6; ``?`` at another length, null for null."""
    octet = lambda i: F.conv(F.hex(F.substring(address, 13 + i, 1)), 16, 10)
    dotted = F.concat_ws(".", *(octet(i) for i in range(4)))
    mapped = F.substring(address, 1, 12) == F.lit(bytearray.fromhex(_MAPPED))
    return F.when(address.isNull(), F.lit(None).cast("string")).when(F.length(address) != 16, F.lit("?")).when(mapped, dotted).otherwise(_let(F.lower(F.hex(address)), _v6_text))


def _v6_text(digits: Column) -> Column:
    group = lambda i: F.regexp_replace(F.substring(digits, F.lit(1) + i * 4, F.lit(4)), "^0{1,3}", "")
    full = F.concat(F.lit(":"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), group), ":"), F.lit(":"))

    def shortened(full: Column) -> Column:
        text = F.substring(full, F.lit(2), F.length(full) - 2)
        for k in range(2, 9):  # the longest run of zero groups, leftmost, becomes ``::``
            run = ":0" * k + ":"
            at = F.instr(full, run)
            left, right = F.substring(full, F.lit(2), at - 2), F.substring(full, at + len(run), F.length(full))
            text = F.when(at > 0, F.concat(left, F.lit("::"), F.regexp_replace(right, ":$", ""))).otherwise(text)
        return text

    return _let(full, shortened)


def in_network(address: Column, network: str) -> Column:
    """Whether 16-byte addresses lie in a CIDR network; a range of bytes, so it is pushed to the scan."""
    net = ipaddress.ip_network(network, strict=False)
    ends = [pack_ip(str(net[i])) for i in (0, -1)]
    return (address >= F.lit(bytearray(ends[0]))) & (address <= F.lit(bytearray(ends[1])))


def pack_ip(text: str) -> bytes | None:
    """The same as ``normalize_ip`` for one literal, on the driver."""
    try:
        address = ipaddress.ip_address(text)
    except ValueError:
        return None
    if address.version == 4:
        return bytes.fromhex(_MAPPED) + address.packed
    return None if "%" in text and address.packed.startswith(bytes.fromhex(_MAPPED)) else address.packed

"""Address expressions: canonical text, 32-hex keys, CIDR membership, network ids.

An address becomes a fixed-width 32-digit hex string (IPv4 in its mapped form), so CIDR
membership is a plain string range that stays inside generated code and can be used for
row-group skipping. No UDF is involved.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretally.config import (
    LOOPBACK_AND_LINK_LOCAL,
    PRIVATE_SUBNETS,
    PUBLIC_NETWORK_ID,
    UNKNOWN_PRIVATE_NETWORK_ID,
)

# Address and identifier formats.
_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IPV4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
_MAPPED = "00000000000000000000ffff"
_UUID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def _as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _v4_hex(ip: Column) -> Column:
    octets = F.split(ip, r"\.")
    return F.concat(
        *[F.lpad(F.lower(F.hex(F.get(octets, F.lit(i)).cast("int"))), 2, "0") for i in range(4)]
    )


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _v6_hex(ip: Column) -> Column:
    """Expand one IPv6 text to 32 hex digits; NULL when it is not an address."""

    def plain(text: Column) -> Column:
        """No dotted tail left."""

        def halves(parts: Column) -> Column:
            left = F.filter(F.split(F.get(parts, F.lit(0)), ":"), lambda g: g != "")
            right = F.filter(F.split(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), ":"), lambda g: g != "")

            def packed(sides: Column) -> Column:
                missing = F.lit(8) - F.size(sides["l"]) - F.size(sides["r"])
                zeros = F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0)))
                groups = F.concat(sides["l"], zeros, sides["r"])
                fits = F.when(F.size(parts) == 2, missing >= 1).otherwise(missing == 0)
                text32 = F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), "")
                return F.when(fits & (F.size(parts) <= 2), text32)

            return _let(F.struct(left.alias("l"), right.alias("r")), packed)

        wrong = text.rlike(r"[0-9a-f]{5,}|^:[^:]|[^:]:$|:::") | ~text.rlike(r"^[0-9a-f:]*$")
        return F.when(~wrong, _let(F.split(text, "::"), halves))

    def with_tail(tail: Column) -> Column:
        digits = _v4_hex(tail)
        head = F.substring(ip, F.lit(1), F.length(ip) - F.length(tail))
        return F.concat(head, F.substring(digits, 1, 4), F.lit(":"), F.substring(digits, 5, 4))

    tail = F.regexp_extract(ip, r"(([0-9]{1,3}\.){3}[0-9]{1,3})$", 1)
    text = F.when(ip.contains("."), F.when(tail.rlike(_IPV4), _let(tail, with_tail))).otherwise(ip)
    return _let(text, plain)


def ip_hex(ip: Column | str) -> Column:
    """32-digit hex key of an address, NULL when the text is no address."""
    ip = F.lower(F.trim(_as_col(ip)))
    return F.when(ip.rlike(_IPV4), F.concat(F.lit(_MAPPED), _v4_hex(ip))).when(
        ip.contains(":"), _v6_hex(ip)
    )


def ip_text(hex_key: Column | str) -> Column:
    """Canonical text of a hex key: dotted for mapped IPv4, compressed for IPv6."""
    key = _as_col(hex_key)
    dotted = F.concat_ws(
        ".", *[F.conv(F.substring(key, 25 + 2 * i, 2), 16, 10) for i in range(4)]
    )
    groups = F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda i: F.regexp_replace(F.substring(key, i * 4 + 1, F.lit(4)), "^0{1,3}", ""),
    )

    def compress(full: Column) -> Column:
        # The longest, leftmost run of zero groups (two or more) collapses to "::".
        short = full
        for run in range(2, 9):
            zeros = ":".join(["0"] * run)
            found = full.rlike(rf"(^|:){zeros}(:|$)")
            cut = F.regexp_replace(full, rf"^(.*?)(^|:){zeros}(:|$)(.*)$", "$1::$4")
            short = F.when(found, cut).otherwise(short)
        return short

    return F.when(key.startswith(_MAPPED), dotted).otherwise(_let(F.array_join(groups, ":"), compress))


def _v4_key(column: str) -> Column:
    ip = F.trim(F.col(column))
    return F.when(ip.rlike(_IPV4), F.concat(F.lit(_MAPPED), _v4_hex(ip)))


def with_addresses(df: DataFrame, columns: dict[str, str], canonical: bool = False) -> DataFrame:
    """Add hex keys (new column -> address column) once per row.

    The keys come out of generators over one struct, which keeps the optimizer from
    copying the parsing expression into every range comparison that uses a key. The
    first one handles IPv4 in generated code, with the shared pieces evaluated once; the
    second fills in IPv6, whose array functions only run for texts with a colon. With
    ``canonical`` the address columns are replaced by their canonical text.
    """
    first = [_v4_key(column).alias(f"_v4_{key}") for key, column in columns.items()]
    kept = [f"`{c}`" for c in df.columns if c not in columns]
    plain = df.select(*kept, F.inline(F.array(F.struct(*first))))
    second = []
    for key, column in columns.items():
        v4, ip = F.col(f"_v4_{key}"), F.lower(F.trim(F.col(column)))
        second.append(F.when(v4.isNotNull(), v4).when(ip.contains(":"), _v6_hex(ip)).alias(key))
        if canonical:
            text = F.when(v4.isNotNull(), ip).when(ip.contains(":"), _let(_v6_hex(ip), ip_text))
            second.append(text.alias(column))
    replaced = set(columns.values()) if canonical else set()
    rest = [f"`{c}`" for c in df.columns if c not in columns and c not in replaced]
    return plain.select(*rest, F.inline(F.array(F.struct(*second))))


def is_ip(ip: Column | str) -> Column:
    return ip_hex(ip).isNotNull()


def cidr_bounds(cidr: str) -> tuple[str, str]:
    """First and last hex key of a CIDR (a bare address is a /32 or /128)."""
    net = ipaddress.ip_network(cidr, strict=False)
    prefix = _MAPPED if net.version == 4 else ""
    width = 8 if net.version == 4 else 32
    low, high = int(net.network_address), int(net.broadcast_address)
    return prefix + format(low, f"0{width}x"), prefix + format(high, f"0{width}x")


def cidr_ranges(spark: SparkSession, lists: dict[str, tuple[str, ...]]) -> DataFrame:
    """Configured subnets as de-duplicated (list, lo, hi) rows."""
    rows = sorted({(name, *cidr_bounds(c)) for name, cidrs in lists.items() for c in cidrs})
    return spark.createDataFrame(rows, "list string, lo string, hi string")


def in_subnets(hex_key: Column | str, cidrs: tuple[str, ...]) -> Column:
    """Membership of a hex key in a configured subnet list, as inlined ranges."""
    key = _as_col(hex_key)
    bounds = sorted({cidr_bounds(c) for c in cidrs})
    hit = F.lit(False)
    for low, high in bounds:
        hit = hit | (key == low if low == high else key.between(low, high))
    return F.coalesce(hit, F.lit(False))


def membership_mask(key: Column, lists: list[tuple[str, ...]]) -> Column:
    """Bit i is set when the key lies in a subnet of list i; 0 for NULL.

    The subnets of all lists cut the address space into segments of equal membership; a
    balanced tree of comparisons finds the segment, so a row costs a handful of
    comparisons and the generated code stays small enough to be compiled.
    """
    bounds = [[cidr_bounds(c) for c in cidrs] for cidrs in lists]
    starts = {"0" * 32}
    for low, high in (pair for group in bounds for pair in group):
        starts.add(low)
        after = int(high, 16) + 1
        if after < 1 << 128:
            starts.add(format(after, "032x"))
    segments: list[tuple[str, int]] = []
    for start in sorted(starts):
        mask = sum(
            1 << i for i, group in enumerate(bounds) if any(lo <= start <= hi for lo, hi in group)
        )
        if not segments or segments[-1][1] != mask:
            segments.append((start, mask))

    def find(part: list[tuple[str, int]]) -> Column:
        if len(part) == 1:
            return F.lit(part[0][1])
        middle = len(part) // 2
        return F.when(key < part[middle][0], find(part[:middle])).otherwise(find(part[middle:]))

    return F.when(key.isNull(), 0).otherwise(find(segments))


def with_membership(
    df: DataFrame, columns: dict[str, str], lists: dict[str, tuple[str, ...]]
) -> DataFrame:
    """Add one struct of list memberships per hex key (new column -> key column).

    Like :func:`with_addresses` this uses a generator, so the comparisons are planned and
    evaluated once and every rule built on them reads plain bits.
    """
    masks = [
        membership_mask(F.col(key), list(lists.values())).alias(f"_mask_{column}")
        for column, key in columns.items()
    ]
    marked = df.select("*", F.inline(F.array(F.struct(*masks))))
    for column in columns:
        bits = [
            (F.col(f"_mask_{column}").bitwiseAND(1 << i) != 0).alias(name) for i, name in enumerate(lists)
        ]
        marked = marked.withColumn(column, F.struct(*bits)).drop(f"_mask_{column}")
    return marked


# Ranges that never belong to the public network.
NON_PUBLIC = PRIVATE_SUBNETS + LOOPBACK_AND_LINK_LOCAL


def network_id(private: Column, agent: Column | str) -> Column:
    """Network identity of a host: public, the sensor's own, or unknown-private.

    ``private`` is membership in ``NON_PUBLIC``.
    """
    agent = _as_col(agent)
    return (
        F.when(~private, PUBLIC_NETWORK_ID)
        .when(agent.rlike(_UUID), F.lower(agent))
        .otherwise(UNKNOWN_PRIVATE_NETWORK_ID)
    )


def conn_key(*parts: Column | str) -> Column:
    """MD5 over the concatenated parts; NULL parts count as empty text."""
    return F.md5(F.concat(*[F.coalesce(_as_col(p).cast("string"), F.lit("")) for p in parts]))


def internal_to_external(
    src_hex: Column | str,
    dst_hex: Column | str,
    internal: tuple[str, ...],
    special: tuple[str, ...],
) -> Column:
    """Internal source talking to a routable external destination."""
    dst = _as_col(dst_hex)
    return (
        in_subnets(src_hex, internal)
        & dst.isNotNull()
        & ~in_subnets(dst, internal)
        & ~in_subnets(dst, special)
    )


def port_label(proto, src_port, dst_port, service) -> Column:
    """``port:proto:service``, or ``icmp:type/code``."""
    proto, src_port = _as_col(proto), _as_col(src_port)
    dst_port, service = _as_col(dst_port), _as_col(service)
    return F.when(
        proto == "icmp",
        F.concat(proto, F.lit(":"), src_port.cast("string"), F.lit("/"), dst_port.cast("string")),
    ).otherwise(
        F.concat(
            dst_port.cast("string"), F.lit(":"), proto, F.lit(":"), F.coalesce(service, F.lit(""))
        )
    )

"""Canonical forms of content hashes and peer addresses, as native columns.

A hash is named by 40 hex digits; letter case, a leading ``urn:btih:`` and outer
blanks do not matter. Anything else, and null, names no hash and gives null.

An address is compared by value: IPv6 text in any of its spellings gives the
same 32 hex digits. An IPv4-mapped IPv6 address stays an IPv6 address.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

URN_PREFIX = "urn:btih:"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def canonical_hash(c: Column | str) -> Column:
    """40 lower-case hex digits, or null. A pattern, since that names its input once: what is
    made of several tests of one text is computed several times inside a generator."""
    bare = F.regexp_extract(F.lower(_col(c)), rf"^\s*(?:{URN_PREFIX})?([0-9a-f]{{40}})\s*$", 1)
    return F.nullif(bare, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once; plain column nesting would copy
    its expression to every place that body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ipv4_hex(ip: Column) -> Column:
    """8 hex digits of a dotted quad, or null."""
    digits = F.transform(F.split(ip, r"\."), lambda o: F.lpad(F.lower(F.hex(o.try_cast("int"))), 2, "0"))
    ok = ip.rlike(r"^(0*(25[0-5]|2[0-4]\d|1?\d?\d)\.){3}0*(25[0-5]|2[0-4]\d|1?\d?\d)$")
    return F.when(ok, F.array_join(digits, ""))


def _padded(groups: Column) -> Column:
    return F.array_join(F.transform(F.filter(groups, lambda g: g != ""), lambda g: F.lpad(g, 4, "0")), "")


def _plain_v6_hex(ip: Column) -> Column:
    def halves_to_hex(halves: Column) -> Column:
        def filled(sides: Column) -> Column:
            left, right = sides["l"], sides["r"]
            missing = F.lit(32) - F.length(left) - F.length(right)
            return F.when(
                F.when(F.size(halves) == 2, missing >= 4).otherwise(missing == 0),
                F.concat(left, F.repeat(F.lit("0"), missing), right),
            )

        sides = F.struct(
            _padded(F.split(halves[0], ":")).alias("l"),
            _padded(F.split(F.coalesce(F.get(halves, F.lit(1)), F.lit("")), ":")).alias("r"),
        )
        return F.when(F.size(halves) <= 2, let(sides, filled))

    shaped = ip.rlike("^(:|[0-9a-f]{1,4}:)[0-9a-f:]*[0-9a-f:]$") & ~ip.rlike("[0-9a-f]{5}|:::|^:[^:]|[^:]:$")
    return F.when(shaped, let(F.split(ip, "::"), halves_to_hex))


def ipv6_hex(ip: Column) -> Column:
    """32 hex digits of an IPv6 address in any spelling, or null."""

    def with_quad(low: Column) -> Column:
        quad = ipv4_hex(F.substring_index(low, ":", -1))
        spelled = F.concat(
            F.regexp_replace(low, r"[0-9.]+$", ""),
            let(quad, lambda q: F.concat(F.substring(q, 1, 4), F.lit(":"), F.substring(q, 5, 4))),
        )
        return F.when(low.contains("."), let(spelled, _plain_v6_hex)).otherwise(_plain_v6_hex(low))

    return let(F.lower(ip), with_quad)


def address_key(ip: Column | str) -> Column:
    """'4' and 8 hex digits, or '6' and 32 hex digits; null for no address."""
    return let(
        F.trim(_col(ip)),
        lambda a: F.when(a.contains(":"), F.concat(F.lit("6"), ipv6_hex(a))).otherwise(F.concat(F.lit("4"), ipv4_hex(a))),
    )


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once per row. A filter on a plain
    computed column is pushed below it and computes it again; nothing is pushed
    through a generator."""
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.explode(F.array(made)).alias("__made")).select("*", "__made.*").drop("__made")


def _four_digit_groups(text: Column) -> Column:
    """'db8:1' -> '0db80001', without a lambda, so that it stays in generated code."""
    longer = F.regexp_replace(F.concat(F.lit(":"), text), ":([0-9a-f]{1,4})(?=:|$)", ":000$1")
    return F.replace(F.regexp_replace(longer, ":0*([0-9a-f]{4})(?=:|$)", "$1"), F.lit(":"), F.lit(""))


def with_socket_key(df: DataFrame, source: Column | str, name: str) -> DataFrame:
    """Adds a peer in socket form (``ip:port`` or ``[v6]:port``) as one
    comparable text: the address key, a dash and four hex digits of the port.
    Null for null and for what is no socket address. The steps are separate
    projections, so that no step is computed twice."""
    c = F.col
    steps = [
        {"__a": F.trim(_col(source))},
        {
            "__ip6": F.when(c("__a").startswith("["), F.lower(F.regexp_extract("__a", r"^\[([0-9A-Fa-f:.]+)\]:[0-9]{1,9}$", 1))),
            # a split by a plain character needs no pattern
            "__q": F.when(c("__a").rlike("^[0-9]+[.][0-9.]+:[0-9]{1,9}$"), F.split(F.substring_index("__a", ":", 1), r"\.")),
            "__port": F.substring_index("__a", ":", -1).try_cast("int"),
        },
        {
            **{f"__o{i}": F.when(F.size("__q") == 4, F.get("__q", F.lit(i)).try_cast("int")) for i in range(4)},
            "__cut": F.when(~c("__ip6").rlike("[0-9a-f]{5}|:::|::.*::|^:[^:]|[^:]:$"), F.instr("__ip6", "::")),
        },
        {
            "__k4": F.when(
                c("__o0").between(0, 255) & c("__o1").between(0, 255) & c("__o2").between(0, 255) & c("__o3").between(0, 255),
                F.hex(c("__o0") * F.lit(1 << 24).cast("long") + c("__o1") * 65536 + c("__o2") * 256 + c("__o3")),
            ),
            "__l": F.when((c("__ip6") != "") & c("__cut").isNotNull(), _four_digit_groups(F.substring_index("__ip6", "::", 1))),
            "__r": F.when(c("__cut") > 0, _four_digit_groups(F.expr("substring(__ip6, __cut + 2)"))).otherwise(F.lit("")),
        },
        {"__fill": F.lit(32) - F.length("__l") - F.length("__r")},
        {
            "__k6": F.when(c("__ip6").contains("."), ipv6_hex(c("__ip6"))).when(
                F.when(c("__cut") > 0, c("__fill") >= 4).otherwise(c("__fill") == 0),
                F.concat("__l", F.repeat(F.lit("0"), c("__fill")), "__r"),
            ),
        },
        {
            name: F.when(
                c("__port").between(0, 65535),
                F.concat(
                    F.when(c("__k6").rlike("^[0-9a-f]{32}$"), F.concat(F.lit("6"), c("__k6")))
                    .when(c("__k4").isNotNull(), F.concat(F.lit("4"), F.lpad(F.lower(c("__k4")), 8, "0"))),
                    F.lit("-"), F.lpad(F.lower(F.hex("__port")), 4, "0"),
                ),
            )
        },
    ]
    made = [n for step in steps for n in step if n != name]
    for step in steps:
        df = df.select("*", *[e.alias(n) for n, e in step.items()])
    return df.drop(*made)


def address_family(key: Column | str) -> Column:
    """4 or 6 from an address or socket key; null stays null."""
    return F.substring(_col(key), 1, 1).cast("tinyint")

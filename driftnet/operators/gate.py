"""From packets to announcements: gates, routing, labels, tokens and ports.

All rules are column expressions, so that cheap tests on raw columns come
before any decoding and are pushed down. Null inputs give null, or the label
that the rule names.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_PACKET = 8192
# fixed values: labels of message and query types
MESSAGE_TYPES = ("q", "r", "e")
QUERY_TYPES = ("ping", "find_node", "get_peers", "announce_peer", "vote")


def packet_status(data: Column, magic: bytes = b"d") -> Column:
    """ok, dropped_size or dropped_magic. The size is tested first; an empty or
    null packet has no magic byte."""
    first = F.substring(data, 1, 1)
    return (
        F.when(F.octet_length(data) > MAX_PACKET, "dropped_size")
        .when(F.coalesce(F.octet_length(data), F.lit(0)) == 0, "dropped_magic")
        .when(first != F.lit(magic), "dropped_magic")
        .otherwise("ok")
    )


def message_label(y: Column) -> Column:
    return F.when(y.isin(*MESSAGE_TYPES), y).otherwise("unknown")


def query_label(q: Column) -> Column:
    return F.when(q.isin(*QUERY_TYPES), q).otherwise("other_or_invalid")


def effective_port(implied: Column, port: Column, source_port: Column) -> Column:
    """The port a peer listens on: a non-zero implied flag or a missing flag
    without a port mean the source port; a zero flag without a port means 0."""
    return (
        F.when(implied != 0, source_port)
        .when(implied == 0, F.coalesce(port, F.lit(0)))
        .otherwise(F.coalesce(port, source_port))
    )


def token_for(ip: Column, secret: str) -> Column:
    """8-byte token of an address as 16 hex digits; the port does not enter."""
    return F.substring(F.sha1(F.concat(ip, F.lit(secret)).cast("binary")), 1, 16)


def token_status(token: Column, ip: Column, secret: str) -> Column:
    """missing, invalid_token or ok; token is hex text of 8 bytes."""
    return F.when(token.isNull(), "missing").when((F.length(token) == 16) & (token == token_for(ip, secret)), "ok").otherwise("invalid_token")


def family_wanted(family: Column, netmode: str) -> Column:
    if netmode not in ("v4", "v6", "dual"):
        raise ValueError(netmode)
    return F.lit(True) if netmode == "dual" else family == (4 if netmode == "v4" else 6)


def user_predicate(test: Callable[[str], bool], on_failure: bool | None = False) -> Callable[[Column | str], Column]:
    """A user's function of a text as a column function. Where it raises, the result is on_failure,
    or with None the query fails; a null text is not asked about and gives false."""

    def one(text: str | None) -> bool:
        if text is None:
            return False
        try:
            return bool(test(text))
        except Exception:
            if on_failure is None:
                raise
            return on_failure

    @F.pandas_udf(T.BooleanType())
    def ask(texts: pd.Series) -> pd.Series:
        return pd.Series([one(t) for t in texts], dtype=bool)

    return ask


def discover(messages: DataFrame, secret: str, hash_filter: Column | None = None) -> DataFrame:
    """Each announce message with the stage that ends it (``outcome``): not_announce,
    no_args, missing, invalid_token, bad_hash, filtered, no_port or discovered.

    Expects y, q, has_args, token, info_hash (hex), implied, port, source_ip, source_port.
    """
    port = effective_port(F.col("implied"), F.col("port"), F.col("source_port"))
    token = token_status(F.col("token"), F.col("source_ip"), secret)
    passes = F.lit(True) if hash_filter is None else F.coalesce(hash_filter, F.lit(False))
    outcome = (
        F.when(~F.coalesce(F.col("y") == "q", F.lit(False)), "not_announce")
        .when(~F.coalesce(F.col("has_args"), F.lit(False)), "no_args")
        .when(~F.coalesce(F.col("q") == "announce_peer", F.lit(False)), "not_announce")
        .when(token != "ok", token)
        .when(~F.coalesce(F.length("info_hash") == 40, F.lit(False)), "bad_hash")
        .when(~passes, "filtered")
        .when(~F.coalesce(port > 0, F.lit(False)), "no_port")
        .otherwise("discovered")
    )
    return messages.withColumn("peer_port", port).withColumn("outcome", outcome)


def find_node_message(own_id: Column, target: Column) -> Column:
    """The bencoded request for the nodes near a target, as bytes."""
    return F.concat(F.lit(b"d1:ad2:id20:"), own_id, F.lit(b"6:target20:"), target, F.lit(b"e1:q9:find_node1:t2:\x00\x011:y1:qe"))


def response_kind(y: Column, q: Column, has_args: Column) -> Column:
    """What a message is answered with: nothing, the own id and a token, or nodes
    as well. Each query with arguments is answered, an announce with a bad token too."""
    asked = F.coalesce((y == "q") & has_args, F.lit(False))
    return F.when(~asked, "none").when(q.isin("get_peers", "find_node"), "id_token_nodes").otherwise("id_token")

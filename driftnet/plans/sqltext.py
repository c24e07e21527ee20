"""Pieces of SQL for the oracle queries."""

from __future__ import annotations

from driftnet.functions.identity import URN_PREFIX


def canonical_hash(c: str) -> str:
    return f"nullif(regexp_extract(lower({c}), '^\\s*(?:{URN_PREFIX})?([0-9a-f]{{40}})\\s*$', 1), '')"


def _groups(text: str) -> str:
    return f"array_to_string(list_transform(list_filter(string_split({text}, ':'), lambda g: g <> ''), lambda g: lpad(g, 4, '0')), '')"


#: announces with h (canonical hash), peer (socket key) and delay_s.
ANNOUNCES = f"""ann0 AS (
  SELECT *, {canonical_hash('info_hash')} AS h, lower(split_part(substr(peer_addr, 2), ']', 1)) AS ip6,
    regexp_extract(peer_addr, ':([0-9]+)$', 1) AS port_text FROM announces
), ann1 AS (
  SELECT *, {_groups("split_part(ip6, '::', 1)")} AS lh,
    CASE WHEN contains(ip6, '::') THEN {_groups("split_part(ip6, '::', 2)")} ELSE '' END AS rh FROM ann0
), ann AS (
  SELECT *, CASE WHEN peer_addr LIKE '[%' THEN '6' || lh || repeat('0', 32 - length(lh) - length(rh)) || rh
    ELSE '4' || array_to_string(list_transform(string_split(split_part(peer_addr, ':', 1), '.'), lambda o: printf('%02x', o::INT)), '') END
    || '-' || printf('%04x', port_text::INT) AS peer,
    CAST(floor((epoch_us(received_at) - epoch_us(discovered_at)) / 1000000) AS BIGINT) AS delay_s
  FROM ann1
)"""
#: torrents with h (canonical hash).
TORRENTS = f"tor AS (SELECT *, {canonical_hash('info_hash')} AS h FROM torrents)"

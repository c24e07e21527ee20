"""Queries over the whole path: packets to announcements, answers, fetches and the metric
series that they raise. The tables hold no wire data, so each announcement is written as
a packet (its kind by its number) and each record as a fetch; the SQL twins work the
same counts out from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftnet.functions.identity import address_key, canonical_hash
from driftnet.operators import fetch, gate, metrics, nodes, wire
from driftnet.plans.catalogue import SECRET
from driftnet.plans.registry import Catalogue
from driftnet.plans.sqltext import ANNOUNCES, TORRENTS
from driftnet.schemas import OPTIONS
from driftnet.session import cut_lineage
from driftnet.sources.tables import table

CATALOGUE = Catalogue()
query = CATALOGUE.query
KINDS = 12


def _sha(*parts: Column) -> Column:
    return F.unhex(F.sha1(F.concat(*parts).cast("binary")))


def captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(delivery_id, kind, data, source_ip, source_port): each announcement as a packet."""
    a = table(spark, sf_dir, "announces").where(F.col("peer_ip").isNotNull() & F.col("peer_port").isNotNull())
    own = _sha(F.col("delivery_id").cast("string"))
    h = F.coalesce(F.unhex(canonical_hash("info_hash")), F.lit(b"ten bytes!"))
    token = F.unhex(gate.token_for(F.col("peer_ip"), SECRET))
    kind = F.pmod("delivery_id", F.lit(KINDS)).cast("int")

    def asked(name: bytes, *fields: Column) -> Column:
        return F.concat(F.lit(b"d1:ad"), wire.bytes_field("id", own), *fields, F.lit(b"e1:q%d:%s1:t2:aa1:y1:qe" % (len(name), name)))

    port = F.concat(F.lit(b"4:porti"), F.col("peer_port").cast("string").cast("binary"), F.lit(b"e"))
    hash_ = wire.bytes_field("info_hash", h)
    shapes = [
        F.concat(F.lit(b"d"), F.lit(b"x" * 9000)), F.lit(b"x1"), F.lit(b"d1:y1:q"),
        F.concat(F.lit(b"d1:rd"), wire.bytes_field("id", own), wire.bytes_field("nodes", F.concat(own, F.lit(b"abcdef"))), F.lit(b"e1:t2:aa1:y1:re")),
        F.lit(b"d1:t2:aa1:y1:ee"), F.lit(b"d1:t2:aa1:y1:ze"), asked(b"ping"), asked(b"get_peers", hash_),
        asked(b"announce_peer", hash_, port), asked(b"announce_peer", hash_, port, wire.bytes_field("token", F.lit(b"badtoken"))),
        asked(b"announce_peer", hash_, port, wire.bytes_field("token", token)), asked(b"announce_peer", hash_, port, wire.bytes_field("token", token)),
    ]
    data = F.lit(None).cast("binary")
    for k, shape in enumerate(shapes):
        data = F.when(kind == k, shape).otherwise(data)
    return a.select("delivery_id", kind.alias("kind"), data.alias("data"), F.col("peer_ip").alias("source_ip"), F.col("peer_port").alias("source_port"))


def _wanted() -> Column:
    return ~F.col("info_hash").startswith("0")


PKT_SQL = f"""{ANNOUNCES}, pk AS (SELECT delivery_id, CAST(delivery_id % {KINDS} AS INT) AS k, h, peer_ip, peer_port, CASE WHEN h IS NULL THEN 24 ELSE 34 END AS hb FROM ann WHERE peer_ip IS NOT NULL AND peer_port IS NOT NULL),
  pb AS (SELECT *, CASE k WHEN 0 THEN 9001 WHEN 1 THEN 2 WHEN 2 THEN 7 WHEN 3 THEN 83 WHEN 4 THEN 15 WHEN 5 THEN 15 WHEN 6 THEN 56 WHEN 7 THEN 61 + hb
    ELSE 66 + hb + 8 + length(peer_port::VARCHAR) + CASE WHEN k > 8 THEN 17 ELSE 0 END END AS size FROM pk)"""
_SERIES = """SELECT 'dht_udp_bytes_received_total' AS metric, NULL::VARCHAR AS label_key, NULL::VARCHAR AS label_value, CAST(sum(size) AS BIGINT) AS value FROM pb
  UNION ALL SELECT 'dht_udp_packets_received_total', 'status', CASE k WHEN 0 THEN 'dropped_size' WHEN 1 THEN 'dropped_magic' ELSE 'ok' END AS s, count(*) FROM pb GROUP BY s
  UNION ALL SELECT 'dht_messages_parse_error_total', NULL, NULL, count(*) FROM pb WHERE k = 2 HAVING count(*) > 0
  UNION ALL SELECT 'dht_messages_processed_total', 'type', CASE k WHEN 3 THEN 'r' WHEN 4 THEN 'e' WHEN 5 THEN 'unknown' ELSE 'q' END AS s, count(*) FROM pb WHERE k > 2 GROUP BY s
  UNION ALL SELECT 'dht_queries_total', 'q', CASE k WHEN 6 THEN 'ping' WHEN 7 THEN 'get_peers' ELSE 'announce_peer' END AS s, count(*) FROM pb WHERE k > 5 GROUP BY s
  UNION ALL SELECT 'dht_announce_peer_blocked_total', 'reason', CASE k WHEN 9 THEN 'invalid_token' ELSE 'filtered' END AS s, count(*) FROM pb WHERE k = 9 OR (k > 9 AND h LIKE '0%') GROUP BY s
  UNION ALL SELECT 'dht_info_hashes_discovered_total', NULL, NULL, count(*) FROM pb WHERE k > 9 AND h NOT LIKE '0%' HAVING count(*) > 0
  UNION ALL SELECT 'dht_nodes_discovered_total', 'ip_version', 'v4', count(*) FROM pb WHERE k = 3 HAVING count(*) > 0"""


@query(f"WITH {PKT_SQL} {_SERIES}")
def metrics_received(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series of received packets, one pass over them."""
    return wire.totals(wire.received(captured(spark, sf_dir), SECRET, _wanted()))


@query(f"""WITH {PKT_SQL} SELECT delivery_id, h AS info_hash, peer_port FROM pb WHERE k > 9 AND h NOT LIKE '0%' AND peer_port > 0""")
def discovered_from_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Announcements that packets lead to, through gate, decoder, token, filter and port."""
    found = wire.received(captured(spark, sf_dir), SECRET, _wanted()).where(F.col("outcome") == "discovered")
    return found.select("delivery_id", "info_hash", "peer_port")


# -- answers -----------------------------------------------------------------


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(family, blob) of eight sampled nodes of each family; two rows."""
    n = table(spark, sf_dir, "nodes").where(F.col("node_id").isNotNull()).select("seq", "node_id", "ip", "port", F.col("family").cast("int").alias("family"), F.col("shard").cast("int").alias("shard"))
    picked = [nodes.sample_per_shard(n.where(F.col("family") == f), 8, "seed") for f in (4, 6)]
    rec = F.hex(nodes.compact_record(F.col("node_id"), F.substring(address_key("ip"), 2, 32), F.col("port")))
    parts = F.array_sort(F.collect_list(F.struct("shard", rec.alias("r"))))
    return picked[0].unionByName(picked[1]).groupBy("family").agg(F.unhex(F.array_join(F.transform(parts, lambda x: x["r"]), "")).alias("blob"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(delivery_id, answer) of each query with arguments, also of those that are refused."""
    got = wire.received(captured(spark, sf_dir), SECRET, _wanted())
    asked = got.where((F.col("y") == "q") & F.col("has_args")).withColumn("family", F.when(F.col("source_ip").contains(":"), 6).otherwise(4))
    with_nodes = asked.join(F.broadcast(_records(spark, sf_dir)), "family", "left")  # a row per family
    a = F.col("m.value.a")
    reference = F.coalesce(a["id"], a["target"], a["info_hash"])
    wants = F.col("q").isin("get_peers", "find_node")
    token = F.unhex(gate.token_for(F.col("source_ip"), SECRET))
    data = wire.response(
        F.col("m.value.t"), reference, F.unhex(F.sha1(F.lit(b"own"))), token,
        F.when(wants & (F.col("family") == 4), F.col("blob")), F.when(wants & (F.col("family") == 6), F.col("blob")),
    )
    return with_nodes.select("delivery_id", "q", data.alias("answer"))


_HEX4 = "array_to_string(list_transform(string_split(ip, '.'), lambda o: printf('%02X', o::INT)), '')"
_SIDE = "array_to_string(list_transform(list_filter(string_split({0}, ':'), lambda g: g <> ''), lambda g: lpad(g, 4, '0')), '')"
ANSWER_SQL = f"""nd AS (SELECT *, lower(ip) AS i, row_number() OVER (PARTITION BY family, shard ORDER BY sha1('seed' || seq::VARCHAR)) AS rn FROM nodes WHERE node_id IS NOT NULL),
  n1 AS (SELECT *, {_SIDE.format("split_part(i, '::', 1)")} AS lh, CASE WHEN contains(i, '::') THEN {_SIDE.format("split_part(i, '::', 2)")} ELSE '' END AS rh,
    row_number() OVER (PARTITION BY family ORDER BY shard) AS place FROM nd WHERE rn = 1),
  n2 AS (SELECT family, string_agg(hex(node_id) || CASE WHEN family = 4 THEN {_HEX4} ELSE upper(lh || repeat('0', 32 - length(lh) - length(rh)) || rh) END || printf('%04X', port), '' ORDER BY shard) AS blob
    FROM n1 WHERE place <= 8 GROUP BY family),
  an AS (SELECT pb.*, n2.blob, CASE WHEN contains(peer_ip, ':') THEN 6 ELSE 4 END AS fam FROM pb LEFT JOIN n2 ON n2.family = CASE WHEN contains(peer_ip, ':') THEN 6 ELSE 4 END WHERE k > 5),
  aw AS (SELECT delivery_id, k, lower(hex('d1:rd2:id20:'::BLOB) || upper(substr(sha1(delivery_id::VARCHAR), 1, 12)) || upper(substr(sha1('own'), 13)) ||
    CASE WHEN k = 7 AND blob IS NOT NULL THEN hex(CAST((CASE fam WHEN 4 THEN '5:nodes' ELSE '6:nodes6' END || (length(blob) // 2) || ':') AS BLOB)) || blob ELSE '' END
    || hex('5:token8:'::BLOB) || upper(substr(sha1(peer_ip || '{SECRET}'), 1, 16)) || hex('e1:t2:aa1:y1:re'::BLOB)) AS answer FROM an)"""


@query(f"WITH {PKT_SQL}, {ANSWER_SQL} SELECT delivery_id, answer FROM aw")
def response_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bencoded answer to each query, with whole node records of the requester's family."""
    return answers(spark, sf_dir).select("delivery_id", F.lower(F.hex("answer")).alias("answer"))


_SENT = """SELECT 'dht_udp_bytes_sent_total' AS metric, NULL::VARCHAR AS label_key, NULL::VARCHAR AS label_value, CAST(sum(length(answer) // 2) AS BIGINT) AS value FROM aw HAVING count(*) > 0
  UNION ALL SELECT 'dht_udp_packets_sent_total', 'type', 'response', count(*) FROM aw HAVING count(*) > 0"""


# -- fetches -----------------------------------------------------------------

CUT = 64  # a small piece, so that records have several


def fetches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(fetches, messages): a fetch per record, with each way to end by its number."""
    t = table(spark, sf_dir, "torrents").where(F.col("name").isNotNull() & F.col("total_size").isNotNull())
    i = F.col("delivery_id")
    name = F.col("name").cast("binary")
    raw = F.when(i % 19 == 0, F.concat(F.lit(b"d4:name1:xe"), name)).otherwise(
        F.concat(F.lit(b"d6:lengthi"), F.col("total_size").cast("string").cast("binary"), F.lit(b"e"), wire.bytes_field("name", name), F.lit(b"12:piece lengthi16384ee"))
    )
    made = t.select(i.alias("fetch_id"), raw.alias("raw"))
    i = F.col("fetch_id")
    connection = F.when(i % 11 == 0, "failed").when(i % 11 == 1, "timeout").otherwise("success")
    digest = F.when(i % 17 == 0, F.sha1(F.concat(F.lit(b"x"), "raw"))).otherwise(F.sha1("raw"))
    every = made.select("fetch_id", connection.alias("connection"), (i % 13 != 0).alias("extension"), digest.alias("digest"))
    size = F.octet_length("raw")
    shaken = made.select(
        "fetch_id", F.lit(0).cast("long").alias("seq"), F.lit("handshake").alias("kind"), F.when(i % 23 == 0, 11 << 20).otherwise(size).cast("long").alias("size"),
        F.when(i % 29 == 0, 0).otherwise(3).alias("ext_id"), F.lit(None).cast("int").alias("piece"), F.lit(None).cast("binary").alias("data"),
    )
    last = F.floor((size - 1) / CUT).cast("int")
    # the first piece comes twice, at first with other bytes of the same length; every 31st fetch lacks its last piece
    order = F.explode(F.concat(F.array(F.lit(-1)), F.sequence(F.lit(0), last)))
    pieces = made.select("fetch_id", "raw", last.alias("last"), order.alias("at")).where(~((i % 31 == 0) & (F.col("at") == F.col("last"))))
    at = F.greatest("at", F.lit(0))
    data = F.substring(F.col("raw"), at * CUT + 1, F.lit(CUT))
    sent = pieces.select(
        "fetch_id", (F.col("at") + 2).cast("long").alias("seq"), F.lit("data").alias("kind"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("int").alias("ext_id"),
        at.alias("piece"), F.when(F.col("at") < 0, F.rpad(F.lit(b"?"), F.octet_length(data), F.lit(b"?"))).otherwise(data).alias("data"),
    )
    return every, shaken.unionByName(sent)


FETCH_SQL = f"""fx AS (SELECT delivery_id AS i, total_size, strlen(name) AS nb, CASE WHEN delivery_id % 19 = 0 THEN 11 + strlen(name)
    ELSE 10 + length(total_size::VARCHAR) + 1 + 6 + length(strlen(name)::VARCHAR) + 1 + strlen(name) + 23 END AS size FROM torrents WHERE name IS NOT NULL AND total_size IS NOT NULL),
  fy AS (SELECT *, (size - 1) // {CUT} AS lst FROM fx),
  fo AS (SELECT *, least(size, {CUT}) + size - CASE WHEN i % 31 = 0 THEN size - lst * {CUT} ELSE 0 END
      AS downloaded,
    CASE WHEN i % 11 = 0 THEN 'connect_failed' WHEN i % 11 = 1 THEN 'connect_timeout' WHEN i % 13 = 0 THEN 'no_extension_support' WHEN i % 29 = 0 THEN 'timeout' WHEN i % 23 = 0 THEN 'size_limit'
      WHEN i % 31 = 0 AND lst > 0 THEN 'timeout' WHEN i % 31 = 0 THEN 'sha1_mismatch' WHEN i % 17 = 0 THEN 'sha1_mismatch' WHEN i % 19 = 0 OR total_size <= 0 THEN 'parse_error' ELSE 'success' END AS outcome FROM fy)"""
_FETCHED = """SELECT 'dht_metadata_fetch_attempts_total' AS metric, NULL::VARCHAR AS label_key, NULL::VARCHAR AS label_value, count(*) AS value FROM fo HAVING count(*) > 0
  UNION ALL SELECT 'dht_metadata_connection_result_total', 'result', CASE outcome WHEN 'connect_failed' THEN 'failed' WHEN 'connect_timeout' THEN 'timeout' ELSE 'success' END AS s, count(*) FROM fo GROUP BY s
  UNION ALL SELECT 'dht_metadata_handshake_result_total', 'result', 'no_extension_support', count(*) FROM fo WHERE outcome = 'no_extension_support' HAVING count(*) > 0
  UNION ALL SELECT 'dht_metadata_handshake_result_total', 'result', 'success', count(*) FROM fo WHERE outcome IN ('success', 'parse_error') HAVING count(*) > 0
  UNION ALL SELECT 'dht_metadata_bytes_downloaded_total', NULL, NULL, CAST(sum(downloaded) AS BIGINT) FROM fo WHERE outcome NOT IN ('connect_failed', 'connect_timeout', 'no_extension_support', 'size_limit') HAVING count(*) > 0
  UNION ALL SELECT 'dht_metadata_fetch_fail_total', 'reason', outcome, count(*) FROM fo WHERE outcome IN ('size_limit', 'sha1_mismatch', 'parse_error') GROUP BY outcome
  UNION ALL SELECT 'dht_metadata_fetch_fail_total', 'reason', 'timeout', count(*) FROM fo WHERE outcome IN ('size_limit', 'sha1_mismatch', 'timeout') HAVING count(*) > 0
  UNION ALL SELECT 'dht_metadata_fetch_success_total', NULL, NULL, count(*) FROM fo WHERE outcome = 'success' HAVING count(*) > 0
  UNION ALL SELECT 'dht_metadata_size_bytes', 'below', CAST(CAST(1 AS BIGINT) << length(bin(total_size)) AS VARCHAR) AS s, count(*) FROM fo WHERE outcome = 'success' GROUP BY s"""


@query(f"WITH {FETCH_SQL} SELECT outcome, count(*) AS n, CAST(sum(CASE WHEN outcome = 'success' THEN total_size ELSE 0 END) AS BIGINT) AS total_size FROM fo GROUP BY 1")
def fetch_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetches by the stage that ends them, from their messages."""
    done = fetch.fetch_stages(*fetches(spark, sf_dir), piece=CUT)
    return done.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("info.total_size"), F.lit(0)).cast("long").alias("total_size"))


@query(f"WITH {PKT_SQL}, {ANSWER_SQL}, {FETCH_SQL} {_SERIES} UNION ALL {_SENT} UNION ALL {_FETCHED}")
def metrics_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counted series, from packets, answers and fetches by one union."""
    got = wire.received(captured(spark, sf_dir), SECRET, _wanted()).select("samples")
    out = wire.sent(answers(spark, sf_dir), "answer", "response").select("samples")
    fetched = fetch.fetch_stages(*fetches(spark, sf_dir), piece=CUT).select("samples")
    return wire.totals(got.unionByName(out).unionByName(fetched))


# -- the crawl ---------------------------------------------------------------


def crawl(known: DataFrame, reply: DataFrame, pressure: list[float], family: int, capacity: int) -> DataFrame:
    """(turn, seq, request) of an iterated crawl: each turn the pressure gives the batch,
    nodes are popped from the frontier, requests are written, and the nodes that answer
    (reply: asked seq -> node) are pushed behind what is left, at the capacity per shard.

    A frontier holds at most ``capacity`` nodes per shard however many turns there are; it is
    written to the shared folder after each turn, which cuts the lineage."""
    frontier = known.where(F.col("family") == family).select("seq", "node_id", "family", "shard", "address")
    out = None
    for turn, p in enumerate(pressure):
        held = nodes.bounded_queues(frontier, capacity)
        frontier = cut_lineage(frontier.join(held.select("seq"), "seq", "left_semi"))
        batch = metrics.batch_of(p)
        popped = nodes.pop_batch(frontier, batch, family) if batch else frontier.limit(0)
        popped = cut_lineage(popped.select("seq", "node_id", "family", "shard", "address"))
        own = F.unhex(F.sha1(F.col("seq").cast("string").cast("binary")))
        target = F.unhex(F.sha1(F.concat(F.lit("t"), F.col("seq").cast("string")).cast("binary")))
        message = gate.find_node_message(nodes.neighbour_id(F.col("node_id"), own), target)
        asked = popped.select(F.lit(turn).alias("turn"), "seq", F.lower(F.hex(message)).alias("request"))
        out = asked if out is None else out.unionByName(asked)
        fresh = reply.join(popped.select(F.col("seq").alias("asked")), "asked", "left_semi").select(
            (F.col("seq") + (turn + 1) * (1 << 40)).alias("seq"), "node_id", "family", "shard", "address"
        )
        frontier = frontier.join(popped.select("seq"), "seq", "left_anti").unionByName(fresh)
    return out


def crawl_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four turns, one at each pressure tier and one after: each asked node answers with the next one known."""
    known = table(spark, sf_dir, "nodes").where(F.col("node_id").isNotNull()).select(
        "seq", "node_id", F.col("family").cast("int").alias("family"), F.col("shard").cast("int").alias("shard"), F.concat_ws("|", "ip", "port").alias("address")
    )
    reply = known.where(F.col("family") == 4).select("*", (F.col("seq") - 1).alias("asked"))
    return crawl(known, reply, [0.2, 0.8, 0.95, 0.1], 4, nodes.shard_capacity(OPTIONS["node_queue_capacity"]))


CATALOGUE.queries["crawl_turns"] = crawl_turns

"""Named queries: each stage of the pipeline over the captured tables, with its SQL twin.

Where a table of captured packets would be needed, the stored tables stand in:
``documents.raw`` for packets, ``events`` for messages, ``nodes`` for the frontier,
``announces`` and ``torrents`` for discoveries and records.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftnet.functions import bencode
from driftnet.functions.identity import address_family, address_key, canonical_hash, with_socket_key
from driftnet.operators import gate, metadata, metrics, nodes
from driftnet.plans.registry import Catalogue
from driftnet.plans.sqltext import ANNOUNCES, TORRENTS
from driftnet.schemas import OPTIONS
from driftnet.session import cut_lineage
from driftnet.sources.tables import table

CATALOGUE = Catalogue()
query = CATALOGUE.query
SECRET = "s3"
STATS_QUEUE = 20  # with one item a minute dispatched: small, so that it fills and empties
HASH_QUEUE = OPTIONS["hash_queue_capacity"]
NODE_CAPACITY = nodes.shard_capacity(OPTIONS["node_queue_capacity"])  # of a shard and family


class _Count:
    """count(*) as bigint, made when it is used: columns need a running session."""

    def alias(self, name: str) -> Column:
        return F.count(F.lit(1)).cast("long").alias(name)


COUNT = _Count()


def big(c: Column) -> Column:
    return c.cast("long")


def announced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_socket_key(table(spark, sf_dir, "announces"), "peer_addr", "peer").withColumn("h", canonical_hash("info_hash"))


def recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "torrents").withColumn("h", canonical_hash("info_hash"))


def frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nodes")
    return n.select("*", F.concat_ws("|", "ip", "port").alias("address"))


# -- gates and routing -------------------------------------------------------


@query("""SELECT CASE WHEN octet_length(raw) > 8192 THEN 'dropped_size' WHEN coalesce(octet_length(raw), 0) = 0 THEN 'dropped_magic'
  WHEN substr(hex(raw), 1, 2) <> '3C' THEN 'dropped_magic' ELSE 'ok' END AS status,
  count(*) AS packets, CAST(coalesce(sum(octet_length(raw)), 0) AS BIGINT) AS bytes FROM documents GROUP BY 1""")
def packet_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("raw")
    return d.groupBy(gate.packet_status(F.col("raw"), b"<").alias("status")).agg(
        COUNT.alias("packets"), F.coalesce(F.sum(big(F.octet_length("raw"))), F.lit(0)).cast("long").alias("bytes")
    )


@query("""SELECT CASE event_type WHEN 'click' THEN 'q' WHEN 'view' THEN 'r' WHEN 'error' THEN 'e' ELSE 'unknown' END AS type, count(*) AS messages
  FROM events GROUP BY 1""")
def message_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.when(F.col("event_type") == "click", "q").when(F.col("event_type") == "view", "r").when(F.col("event_type") == "error", "e").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").groupBy(gate.message_label(y).alias("type")).agg(COUNT.alias("messages"))


def _query_of_k() -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in (*gate.QUERY_TYPES, "scrape", "x")]), F.col("k") % 7 + 1)



def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


EVENTS_SQL = "ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"


@query(f"""WITH {EVENTS_SQL} SELECT CASE k % 7 WHEN 0 THEN 'ping' WHEN 1 THEN 'find_node' WHEN 2 THEN 'get_peers' WHEN 3 THEN 'announce_peer'
  WHEN 4 THEN 'vote' ELSE 'other_or_invalid' END AS q, count(*) AS queries FROM ev GROUP BY 1""")
def query_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy(gate.query_label(_query_of_k()).alias("q")).agg(COUNT.alias("queries"))


@query("""SELECT CASE WHEN sensor IS NOT NULL THEN 'id' WHEN info_hash IS NOT NULL THEN 'target' WHEN peer_addr IS NOT NULL THEN 'info_hash' ELSE 'none' END
  AS taken_from, count(*) AS n, count(DISTINCT coalesce(sensor, info_hash, peer_addr)) AS ids FROM announces GROUP BY 1""")
def reference_id_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "announces")
    source = F.when(F.col("sensor").isNotNull(), "id").when(F.col("info_hash").isNotNull(), "target").when(F.col("peer_addr").isNotNull(), "info_hash").otherwise("none")
    return a.groupBy(source.alias("taken_from")).agg(COUNT.alias("n"), F.count_distinct(F.coalesce("sensor", "info_hash", "peer_addr")).alias("ids"))


TOKEN_SQL = f"""tok AS (SELECT *, CASE WHEN k % 7 = 0 THEN NULL WHEN k % 5 = 0 THEN 'x' || substr(sha1(user_id::VARCHAR || '{SECRET}'), 2, 15)
  ELSE substr(sha1(user_id::VARCHAR || '{SECRET}'), 1, 16) END AS token FROM ev)"""
STATUS_SQL = f"CASE WHEN token IS NULL THEN 'missing' WHEN length(token) = 16 AND token = substr(sha1(user_id::VARCHAR || '{SECRET}'), 1, 16) THEN 'ok' ELSE 'invalid_token' END"


def _with_token(ev: DataFrame) -> DataFrame:
    own = gate.token_for(F.col("user_id").cast("string"), SECRET)
    return ev.withColumn("token", F.when(F.col("k") % 7 == 0, None).when(F.col("k") % 5 == 0, F.concat(F.lit("x"), F.substring(own, 2, 15))).otherwise(own))


@query(f"WITH {EVENTS_SQL}, {TOKEN_SQL} SELECT {STATUS_SQL} AS status, count(*) AS n FROM tok GROUP BY 1")
def token_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _with_token(_events(spark, sf_dir))
    return ev.groupBy(gate.token_status(F.col("token"), F.col("user_id").cast("string"), SECRET).alias("status")).agg(COUNT.alias("n"))


@query(f"SELECT user_id, substr(sha1(user_id::VARCHAR || '{SECRET}'), 1, 16) AS token, count(*) AS answers FROM events GROUP BY 1")
def token_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One token per address, whatever the query."""
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(COUNT.alias("answers"))
    return per.select("user_id", gate.token_for(F.col("user_id").cast("string"), SECRET).alias("token"), "answers")


PORT_SQL = """prt AS (SELECT *, CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 1 END AS implied, CASE WHEN k % 4 = 0 THEN NULL ELSE k * 100 END AS port,
  CAST(1024 + user_id % 1000 AS INT) AS src FROM {0})"""
EFFECTIVE_SQL = "CASE WHEN implied <> 0 THEN src WHEN implied = 0 THEN coalesce(port, 0) ELSE coalesce(port, src) END"


def _with_ports(ev: DataFrame) -> DataFrame:
    return ev.select(
        "*", F.when(F.col("k") % 3 == 1, 0).when(F.col("k") % 3 == 2, 1).alias("implied"),
        F.when(F.col("k") % 4 != 0, F.col("k") * 100).alias("port"), (1024 + F.col("user_id") % 1000).cast("int").alias("source_port"),
    )


@query(f"WITH {EVENTS_SQL}, {PORT_SQL.format('ev')} SELECT event_id, CAST({EFFECTIVE_SQL} AS INT) AS peer_port, {EFFECTIVE_SQL} > 0 AS kept FROM prt")
def effective_port(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = gate.effective_port(F.col("implied"), F.col("port"), F.col("source_port"))
    return _with_ports(_events(spark, sf_dir)).select("event_id", p.alias("peer_port"), (p > 0).alias("kept"))


@query(f"""WITH {EVENTS_SQL}, {TOKEN_SQL}, {PORT_SQL.format('tok')}, st AS (SELECT *, {STATUS_SQL} AS status, sha1(event_id::VARCHAR) AS hash, {EFFECTIVE_SQL} AS eff FROM prt)
  SELECT CASE WHEN event_type <> 'click' THEN 'not_announce' WHEN k % 11 = 0 THEN 'no_args' WHEN status <> 'ok' THEN status WHEN k % 13 = 0 THEN 'bad_hash'
  WHEN hash NOT LIKE '%7' AND hash LIKE '0%' THEN 'filtered' WHEN NOT eff > 0 THEN 'no_port' ELSE 'discovered' END AS outcome, count(*) AS n,
  CAST(sum(eff) AS BIGINT) AS ports FROM st GROUP BY 1""")
def announce_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _with_ports(_with_token(_events(spark, sf_dir)))
    h = F.sha1(F.col("event_id").cast("string").cast("binary"))
    messages = ev.select(
        F.when(F.col("event_type") == "click", "q").otherwise("r").alias("y"), F.lit("announce_peer").alias("q"), (F.col("k") % 11 != 0).alias("has_args"), "token",
        F.when(F.col("k") % 13 == 0, F.substring(h, 1, 38)).otherwise(h).alias("info_hash"), "implied", "port", F.col("user_id").cast("string").alias("source_ip"), "source_port",
    )
    wanted = F.col("info_hash").endswith("7") | ~F.col("info_hash").startswith("0")
    return gate.discover(messages, SECRET, wanted).groupBy("outcome").agg(COUNT.alias("n"), F.sum("peer_port").cast("long").alias("ports"))


@query(f"WITH {ANNOUNCES} SELECT h AS info_hash, count(*) AS n FROM ann WHERE h LIKE 'a%' GROUP BY 1")
def hash_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return announced(spark, sf_dir).where(F.col("h").startswith("a")).groupBy(F.col("h").alias("info_hash")).agg(COUNT.alias("n"))


@query(CATALOGUE.sql["hash_filter"])
def hash_filter_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same predicate as user code, on distinct hashes only."""

    @F.pandas_udf(T.BooleanType())
    def wanted(h: pd.Series) -> pd.Series:
        return h.str.startswith("a").fillna(False).astype(bool)

    per = announced(spark, sf_dir).where(F.col("h").isNotNull()).groupBy(F.col("h").alias("info_hash")).agg(COUNT.alias("n"))
    return per.where(wanted("info_hash"))


@query(f"WITH {ANNOUNCES}, {TORRENTS} SELECT h AS info_hash, count(*) AS n FROM ann WHERE h IN (SELECT h FROM tor WHERE h IS NOT NULL) GROUP BY 1")
def fetch_allow_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = announced(spark, sf_dir).where(F.col("h").isNotNull()).groupBy("h").agg(COUNT.alias("n"))
    return per.join(recorded(spark, sf_dir).select("h"), "h", "left_semi").withColumnRenamed("h", "info_hash")


@query(f"WITH {ANNOUNCES}, {TORRENTS} SELECT h AS info_hash, count(*) AS n FROM ann WHERE h IS NOT NULL AND h NOT IN (SELECT h FROM tor WHERE h IS NOT NULL) GROUP BY 1")
def fetch_deny_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = announced(spark, sf_dir).where(F.col("h").isNotNull()).groupBy("h").agg(COUNT.alias("n"))
    return per.join(recorded(spark, sf_dir).select("h"), "h", "left_anti").withColumnRenamed("h", "info_hash")


@query(f"WITH {TORRENTS} SELECT h AS info_hash, count(*) AS n FROM tor GROUP BY 1")
def unset_predicate_allows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a predicate each hash passes, the ones that name none too."""
    return recorded(spark, sf_dir).groupBy(F.col("h").alias("info_hash")).agg(COUNT.alias("n"))


@query("SELECT CAST(family AS INT) AS family, mode, count(*) AS nodes FROM nodes, (VALUES ('v4'), ('v6'), ('dual')) m(mode) WHERE mode = 'dual' OR (mode = 'v4') = (family = 4) GROUP BY ALL")
def netmode_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nodes").groupBy(F.col("family").cast("int").alias("family")).agg(COUNT.alias("nodes"))
    out = [n.where(gate.family_wanted(F.col("family"), m)).select("family", F.lit(m).alias("mode"), "nodes") for m in ("v4", "v6", "dual")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT doc_id, octet_length(raw) % 26 = 0 AND octet_length(raw) > 0 AS v4_ok, octet_length(raw) % 38 = 0 AND octet_length(raw) > 0 AS v6_ok FROM documents WHERE raw IS NOT NULL")
def blob_length_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.octet_length("raw")
    d = table(spark, sf_dir, "documents").where(F.col("raw").isNotNull())
    return d.select("doc_id", ((n % nodes.V4_BYTES == 0) & (n > 0)).alias("v4_ok"), ((n % nodes.V6_BYTES == 0) & (n > 0)).alias("v6_ok"))


# -- nodes -------------------------------------------------------------------


def _compact(spark: SparkSession, sf_dir: str, family: int, width: int) -> DataFrame:
    """Nodes in blobs of up to 8 records, as a response carries them, and read back."""
    n = table(spark, sf_dir, "nodes").where((F.col("family") == family) & F.col("node_id").isNotNull())
    rec = nodes.compact_record(F.col("node_id"), F.substring(address_key("ip"), 2, 32), F.col("port"))
    blobs = n.groupBy(F.floor(F.col("seq") / 8).alias("block")).agg(F.array_sort(F.collect_list(F.struct("seq", rec.alias("r")))).alias("rs"))
    blob = F.aggregate("rs", F.lit(b""), lambda acc, x: F.concat(acc, x["r"]))
    return nodes.decode_compact(blobs.select("block", blob.alias("blob")), "blob", width).select("block", "at", "node_id", "address", "port")


@query("""SELECT CAST(floor(seq / 8) AS BIGINT) AS block, CAST(row_number() OVER (PARTITION BY floor(seq / 8) ORDER BY seq) - 1 AS BIGINT) AS at, lower(hex(node_id)) AS node_id,
  array_to_string(list_transform(string_split(ip, '.'), lambda o: printf('%02x', o::INT)), '') AS address, port FROM nodes WHERE family = 4 AND node_id IS NOT NULL""")
def compact_v4_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _compact(spark, sf_dir, 4, nodes.V4_BYTES)
    return d.withColumn("at", big(F.col("at")))


@query("""WITH n AS (SELECT *, lower(ip) AS i FROM nodes WHERE family = 6 AND node_id IS NOT NULL), g AS (SELECT *,
  array_to_string(list_transform(list_filter(string_split(split_part(i, '::', 1), ':'), lambda g: g <> ''), lambda g: lpad(g, 4, '0')), '') AS lh,
  CASE WHEN contains(i, '::') THEN array_to_string(list_transform(list_filter(string_split(split_part(i, '::', 2), ':'), lambda g: g <> ''), lambda g: lpad(g, 4, '0')), '') ELSE '' END AS rh FROM n),
  a AS (SELECT *, lh || repeat('0', 32 - length(lh) - length(rh)) || rh AS address FROM g)
  SELECT CAST(floor(seq / 8) AS BIGINT) AS block, CAST(row_number() OVER (PARTITION BY floor(seq / 8) ORDER BY seq) - 1 AS BIGINT) AS at, lower(hex(node_id)) AS node_id,
  address, port FROM a WHERE address <> repeat('0', 32) AND address NOT LIKE 'ff%'""")
def compact_v6_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _compact(spark, sf_dir, 6, nodes.V6_BYTES)
    return d.withColumn("at", big(F.col("at")))


@query("""SELECT ip, port, min(seq) AS seq, lower(hex(arg_min(coalesce(node_id, ''::BLOB), seq))) AS node_id FROM nodes GROUP BY 1, 2""")
def node_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = nodes.first_per_address(table(spark, sf_dir, "nodes"), "ip", "port")
    return first.select("ip", "port", "seq", F.lower(F.hex(F.coalesce("node_id", F.lit(b"")))).alias("node_id"))


@query("SELECT CAST(family AS INT) AS family, CAST(shard AS INT) AS shard, count(*) AS nodes, count(*) AS agrees FROM nodes GROUP BY ALL")
def shard_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes per family and shard; the shard is computed anew from address and port."""
    n = table(spark, sf_dir, "nodes").withColumn("own", nodes.shard_of(nodes.last_octet(address_key("ip")), F.col("port")))
    return n.groupBy(F.col("family").cast("int").alias("family"), F.col("shard").cast("int").alias("shard")).agg(
        COUNT.alias("nodes"), F.sum((F.col("own") == F.col("shard")).cast("long")).alias("agrees")
    )


@query()
def bounded_fifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the frontier of a crawl holds in the end, with the default capacity."""
    return nodes.bounded_queues(frontier(spark, sf_dir), NODE_CAPACITY)


POP_SQL = """WITH r AS (SELECT seq, family, shard, {turn} AS turn, row_number() OVER (PARTITION BY {turn} ORDER BY seq) AS rn FROM nodes WHERE {where}),
  t AS (SELECT * FROM r WHERE rn <= {take}), s AS (SELECT turn, coalesce(sum(count(*)) OVER (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t GROUP BY turn)
  SELECT seq, CAST(family AS INT) AS family, CAST(shard AS INT) AS shard FROM t JOIN s USING (turn) WHERE before < {count}"""


def _pop(count: int, family: int | None) -> None:
    kind = "dual" if family is None else "single"
    turn, where = ("shard * 2 + CASE WHEN family = 4 THEN 0 ELSE 1 END", "TRUE") if family is None else ("shard", f"family = {family}")
    take = -(-count // 16) // (2 if family is None else 1)

    @query(POP_SQL.format(turn=turn, where=where, take=take, count=count), name=f"pop_batch_{kind}_{count}")
    def pop(spark: SparkSession, sf_dir: str) -> DataFrame:
        some = nodes.pop_batch(table(spark, sf_dir, "nodes"), count, family)
        return some.select("seq", F.col("family").cast("int").alias("family"), F.col("shard").cast("int").alias("shard"))


for _count, _family in ((200, 4), (20, 4), (200, None), (20, None), (16, None)):
    _pop(_count, _family)


@query("""WITH d AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY sha1('seed' || seq::VARCHAR)) AS rn FROM nodes WHERE family = 4)
  SELECT seq, CAST(shard AS INT) AS shard FROM d WHERE rn = 1 ORDER BY shard LIMIT 8""")
def sample_per_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    v4 = table(spark, sf_dir, "nodes").where(F.col("family") == 4).select("seq", F.col("shard").cast("int").alias("shard"))
    return nodes.sample_per_shard(v4, 8, "seed")


@query("SELECT seq, CAST(shard AS INT) AS shard FROM nodes WHERE family = 4 ORDER BY sha1('seed' || seq::VARCHAR), seq LIMIT 50")
def reservoir_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    v4 = table(spark, sf_dir, "nodes").where(F.col("family") == 4).select("seq", F.col("shard").cast("int").alias("shard"))
    return nodes.reservoir(v4, 50, "seed")


SPLIT_SQL = """d AS (SELECT *, row_number() OVER (PARTITION BY family, shard ORDER BY sha1('seed' || seq::VARCHAR)) AS rn FROM nodes),
  e AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY shard) AS place FROM d WHERE rn = 1)"""


@query(f"WITH {SPLIT_SQL} SELECT seq, CAST(family AS INT) AS family, CAST(shard AS INT) AS shard FROM e WHERE place <= 4")
def sample_family_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nodes").select("seq", F.col("family").cast("int").alias("family"), F.col("shard").cast("int").alias("shard"))
    return nodes.sample_both_families(n, 8, "seed")


@query("SELECT seq, lower(hex(node_id)[1:12] || substr(upper(sha1(seq::VARCHAR)), 13)) AS neighbour FROM nodes WHERE node_id IS NOT NULL")
def neighbor_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nodes").where(F.col("node_id").isNotNull())
    own = F.unhex(F.sha1(F.col("seq").cast("string").cast("binary")))
    return n.select("seq", F.lower(F.hex(nodes.neighbour_id(F.col("node_id"), own))).alias("neighbour"))


@query(f"""WITH {ANNOUNCES}, {SPLIT_SQL.replace('PARTITION BY family, shard', 'PARTITION BY family, shard')}, f AS (SELECT family, CAST(count(*) AS BIGINT) AS n,
    string_agg(lower(hex(coalesce(node_id, ''::BLOB))), '' ORDER BY shard) AS blob FROM e WHERE place <= 8 GROUP BY family)
  SELECT CAST(left(peer, 1) AS INT) AS family, count(*) AS responses, CASE WHEN left(peer, 1) = '4' THEN max(blob) END AS nodes, CASE WHEN left(peer, 1) = '6' THEN max(blob) END AS nodes6
  FROM ann JOIN f ON CAST(left(peer, 1) AS INT) = f.family GROUP BY left(peer, 1)""")
def response_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampled ids that answer a requester: its own family's, the other key is left out."""
    n = table(spark, sf_dir, "nodes").select("seq", "node_id", F.col("family").cast("int").alias("family"), F.col("shard").cast("int").alias("shard"))
    picked = [nodes.sample_per_shard(n.where(F.col("family") == f), 8, "seed") for f in (4, 6)]
    ids = F.array_sort(F.collect_list(F.struct("shard", F.lower(F.hex(F.coalesce("node_id", F.lit(b"")))).alias("id"))))
    blobs = picked[0].unionByName(picked[1]).groupBy("family").agg(F.array_join(F.transform(ids, lambda x: x["id"]), "").alias("blob"))  # two rows
    asked = announced(spark, sf_dir).groupBy(address_family("peer").cast("int").alias("family")).agg(COUNT.alias("responses"))
    return asked.join(F.broadcast(blobs), "family").select(
        "family", "responses", F.when(F.col("family") == 4, F.col("blob")).alias("nodes"), F.when(F.col("family") == 6, F.col("blob")).alias("nodes6")
    )


@query("""WITH d AS (SELECT ip, port, CAST(family AS INT) AS family FROM nodes GROUP BY ALL) SELECT family, count(*) AS nodes, count(*) = 0 AS empty FROM d GROUP BY 1
  UNION ALL SELECT 0, count(*), count(*) = 0 FROM d""")
def node_pool_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "nodes").select("ip", "port", F.col("family").cast("int").alias("family")).distinct()
    per = d.groupBy("family").agg(COUNT.alias("nodes"))
    return per.unionByName(per.agg(F.lit(0).alias("family"), F.coalesce(F.sum("nodes"), F.lit(0)).alias("nodes")).select("family", "nodes")).withColumn("empty", F.col("nodes") == 0)


@query("SELECT sensor, count(*) AS n FROM announces WHERE sensor IN ('fra-a', 'ams-1') GROUP BY 1")
def bound_socket_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only what arrived at a bound socket; the list of those is short and fixed."""
    bound = spark.createDataFrame([("fra-a",), ("ams-1",)], "sensor string")
    return table(spark, sf_dir, "announces").join(F.broadcast(bound), "sensor", "left_semi").groupBy("sensor").agg(COUNT.alias("n"))


@query(f"""WITH {EVENTS_SQL} SELECT CASE WHEN event_type <> 'click' OR k % 11 = 0 THEN 'none' WHEN k % 7 IN (1, 2) THEN 'id_token_nodes' ELSE 'id_token' END AS answer, count(*) AS n
  FROM ev GROUP BY 1""")
def response_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.when(F.col("event_type") == "click", "q").otherwise("r")
    return _events(spark, sf_dir).groupBy(gate.response_kind(y, _query_of_k(), F.col("k") % 11 != 0).alias("answer")).agg(COUNT.alias("n"))


def _crawl(count_sql: str) -> str:
    own = "substr(upper(sha1(seq::VARCHAR)), 13)"
    head = "64313A6164323A696432303A"
    return f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY seq) AS rn FROM nodes WHERE family = 4 AND node_id IS NOT NULL),
  t AS (SELECT * FROM r WHERE rn <= 2), s AS (SELECT shard, coalesce(sum(count(*)) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t GROUP BY shard)
  SELECT seq, lower('{head}' || hex(node_id)[1:12] || {own} || '363A74617267657432303A' || upper(sha1('t' || seq::VARCHAR)) || '65313A71393A66696E645F6E6F6465313A74323A0001313A79313A7165') AS request, 500 AS sleep_ms
  FROM t JOIN s USING (shard) WHERE before < {count_sql}"""


@query(_crawl("20"))
def crawl_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One turn of the crawl: batch size by pressure, nodes popped, requests written."""
    tier = (20, 500)  # pressure from 0.8 to below 0.95
    known = table(spark, sf_dir, "nodes").where(F.col("node_id").isNotNull())
    own = F.unhex(F.sha1(F.col("seq").cast("string").cast("binary")))
    target = F.unhex(F.sha1(F.concat(F.lit("t"), F.col("seq").cast("string")).cast("binary")))
    popped = nodes.pop_batch(known, tier[0], 4)
    message = gate.find_node_message(nodes.neighbour_id(F.col("node_id"), own), target)
    return popped.select("seq", F.lower(F.hex(message)).alias("request"), F.lit(tier[1]).alias("sleep_ms"))


# -- records -----------------------------------------------------------------

LATEST_SQL = "lat AS (SELECT * FROM tor WHERE h IS NOT NULL QUALIFY row_number() OVER (PARTITION BY h ORDER BY timestamp DESC NULLS LAST, delivery_id DESC) = 1)"


@query(f"""WITH {ANNOUNCES}, {TORRENTS}, {LATEST_SQL} SELECT ann.sensor, lat.h AS info_hash, count(*) AS n, any_value(lat.total_size) AS total_size
  FROM ann JOIN lat ON ann.h = lat.h GROUP BY ALL""")
def metadata_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Announcements with the metadata of their hash; summed before the join, so that a hot hash is one row."""
    per = announced(spark, sf_dir).where(F.col("h").isNotNull()).groupBy("h", "sensor").agg(COUNT.alias("n"))
    records = metadata.latest_record(recorded(spark, sf_dir).select("h", "timestamp", "delivery_id", "total_size"), "h")
    return per.join(records, "h").select("sensor", F.col("h").alias("info_hash"), "n", "total_size")


@query(f"""WITH {TORRENTS}, o AS (SELECT unnest(CASE WHEN peers IS NULL OR len(peers) = 0 THEN ['connect_failed'] WHEN piece_length * 20 > 10485760 THEN ['size_limit', 'timeout']
  WHEN name IS NULL THEN ['timeout'] WHEN h IS NULL THEN ['sha1_mismatch', 'timeout'] WHEN coalesce(total_size, 0) <= 0 THEN ['parse_error'] ELSE ['success'] END) AS result FROM tor)
  SELECT result, count(*) AS n FROM o GROUP BY 1""")
def fetch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metadata.fetch_outcome(
        F.coalesce(F.size("peers") > 0, F.lit(False)), F.coalesce(F.col("piece_length") * 20, F.lit(0)), F.col("name").isNotNull(), F.col("h").isNotNull(), F.col("total_size")
    )
    return recorded(spark, sf_dir).select(F.explode(out).alias("result")).groupBy("result").agg(COUNT.alias("n"))


@query("SELECT doc_id, sha1(text) AS digest, TRUE AS complete FROM documents WHERE text IS NOT NULL AND text <> ''")
def piece_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut into pieces, put together again and hashed."""
    size = 256
    d = table(spark, sf_dir, "documents").where(F.length("text") > 0).select("doc_id", F.col("text").cast("binary").alias("raw"))
    last = ((F.octet_length("raw") - 1) / size).cast("int")
    pieces = d.select("doc_id", "raw", F.explode(F.sequence(F.lit(0), last)).alias("piece")).select(
        "doc_id", "piece", F.substring(F.col("raw"), F.col("piece") * size + 1, F.lit(size)).alias("data")
    )
    return metadata.reassembled(pieces, "doc_id").select("doc_id", F.sha1("data").alias("digest"), "complete")


@query("""SELECT l_orderkey, l_linenumber, max(({'a': l_shipdate, 'd': l_partkey * 100000 + l_suppkey})).d AS data FROM lineitem GROUP BY 1, 2""")
def piece_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("arrival"), (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("data"))
    return metadata.last_piece(p, "l_orderkey", "l_linenumber").drop("arrival")


@query("SELECT l_orderkey, count(DISTINCT l_linenumber) AS pieces, count(DISTINCT l_linenumber) = max(l_linenumber) AS complete FROM lineitem GROUP BY 1")
def piece_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return p.groupBy("l_orderkey").agg(COUNT.alias("pieces"), (F.count(F.lit(1)) == F.max("l_linenumber")).alias("complete"))


@query("SELECT doc_id, sha1(text) = CASE WHEN doc_id % 10 = 0 THEN sha1('x' || text) ELSE sha1(text) END AS intact FROM documents WHERE text IS NOT NULL")
def hash_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    raw = F.col("text").cast("binary")
    claimed = F.sha1(F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit(b"x"), raw)).otherwise(raw))
    return d.select("doc_id", (F.sha1(raw) == claimed).alias("intact"))


@query("SELECT delivery_id, coalesce(name, 'Unknown') AS name, coalesce(piece_length, 0) AS piece_length, CAST(coalesce(nullif(delivery_id % 4, 0), 15) AS INT) AS timeout_s FROM torrents")
def info_dict_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "torrents").select(
        "delivery_id", F.coalesce("name", F.lit("Unknown")).alias("name"), F.coalesce("piece_length", F.lit(0)).cast("long").alias("piece_length"),
        F.coalesce(F.nullif(F.col("delivery_id") % 4, F.lit(0)), F.lit(15)).cast("int").alias("timeout_s"),
    )


@query("""WITH f AS (SELECT delivery_id, unnest(list_filter(files, lambda x: x.size IS NOT NULL)) AS x, generate_subscripts(list_filter(files, lambda x: x.size IS NOT NULL), 1) AS i FROM torrents)
  SELECT delivery_id, CAST(i - 1 AS INT) AS at, coalesce(x.path, '') AS path, x.size AS size FROM f""")
def files_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "torrents").select("delivery_id", F.posexplode(metadata.flattened_files(F.col("files"))).alias("at", "x"))
    return t.select("delivery_id", "at", "x.path", "x.size")


@query("SELECT delivery_id, CAST(CASE WHEN files IS NULL THEN 1 ELSE len(files) END AS INT) AS n_files, CASE WHEN files IS NULL THEN name ELSE files[1].path END AS first_path FROM torrents")
def single_file_synth(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = metadata.single_file(F.col("files"), F.col("name"), F.col("total_size"))
    return table(spark, sf_dir, "torrents").select("delivery_id", F.size(files).alias("n_files"), F.get(files, F.lit(0))["path"].alias("first_path"))


@query("SELECT delivery_id, CAST(coalesce(list_sum(list_transform(files, lambda x: x.size)), 0) AS BIGINT) AS total FROM torrents WHERE coalesce(list_sum(list_transform(files, lambda x: x.size)), 0) > 0")
def zero_size_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "torrents").select("delivery_id", F.coalesce(metadata.total_of(F.col("files")), F.lit(0)).cast("long").alias("total"))
    return t.where(F.col("total") > 0)


@query("""WITH s AS (SELECT delivery_id, total_size * f AS size, f FROM torrents, (VALUES (1), (1024), (1048576)) v(f) WHERE total_size IS NOT NULL)
  SELECT delivery_id, f, CASE WHEN size < 1024 THEN printf('%.2f B', size::DOUBLE) WHEN size < 1048576 THEN printf('%.2f KB', size / 1024) WHEN size < 1073741824 THEN printf('%.2f MB', size / 1048576)
  WHEN size < 1099511627776 THEN printf('%.2f GB', size / 1073741824) ELSE printf('%.2f TB', size / 1099511627776) END AS shown FROM s""")
def format_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "torrents").where(F.col("total_size").isNotNull())
    s = t.select("delivery_id", F.explode(F.array(F.lit(1), F.lit(1024), F.lit(1048576))).alias("f"), "total_size")
    return s.select("delivery_id", "f", metadata.human_size(F.col("total_size").cast("decimal(20,0)") * F.col("f")).alias("shown"))


@query(f"WITH {TORRENTS} SELECT delivery_id, 'magnet:?xt=urn:btih:' || h AS link, coalesce(magnet_link = 'magnet:?xt=urn:btih:' || h, FALSE) AS as_stored FROM tor WHERE h IS NOT NULL")
def magnet_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = metadata.magnet(F.col("h"))
    return recorded(spark, sf_dir).where(F.col("h").isNotNull()).select("delivery_id", link.alias("link"), F.coalesce(F.col("magnet_link") == link, F.lit(False)).alias("as_stored"))


@query("SELECT delivery_id, CASE WHEN contains(peer_ip, ':') THEN '[' || peer_ip || ']:' || peer_port ELSE peer_ip || ':' || peer_port END AS peer FROM announces")
def peer_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "announces").select("delivery_id", metadata.socket_text(F.col("peer_ip"), F.col("peer_port")).alias("peer"))


@query(f"""WITH {ANNOUNCES}, {TORRENTS}, {LATEST_SQL}, r AS (SELECT ann.delivery_id, lat.h, lat.name, coalesce(lat.piece_length, 0) AS piece_length, ann.peer_ip, ann.peer_port, ann.discovered_at,
    list_filter(lat.files, lambda x: x.size IS NOT NULL) AS fs FROM ann JOIN lat ON ann.h = lat.h)
  SELECT h AS info_hash, 'magnet:?xt=urn:btih:' || h AS magnet_link, coalesce(name, 'Unknown') AS name, CAST(list_sum(list_transform(fs, lambda x: x.size)) AS BIGINT) AS total_size,
  CAST(len(fs) AS INT) AS n_files, piece_length, CASE WHEN contains(peer_ip, ':') THEN '[' || peer_ip || ']:' || peer_port ELSE peer_ip || ':' || peer_port END AS peer,
  CAST(floor(epoch_us(discovered_at) / 1000000) AS BIGINT) AS timestamp FROM r WHERE list_sum(list_transform(fs, lambda x: x.size)) > 0""")
def torrent_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: each announcement as a full record, flattened."""
    records = cut_lineage(metadata.latest_record(recorded(spark, sf_dir).select(F.col("h").alias("info_hash"), "timestamp", "delivery_id", "name", "files", "piece_length"), "info_hash"))
    a = table(spark, sf_dir, "announces").select(canonical_hash("info_hash").alias("info_hash"), "peer_ip", "peer_port", "discovered_at", "delivery_id")
    full = metadata.assemble(a, records.select("info_hash", "name", "files", "piece_length"), "delivery_id")
    return full.select("info_hash", "magnet_link", "name", "total_size", F.size("files").alias("n_files"), "piece_length", F.col("peers")[0].alias("peer"), "timestamp")


@query("SELECT delivery_id, name, total_size, CAST(len(files) AS INT) AS n_files, files[1].path AS first_path FROM torrents")
def record_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as JSON and read back."""
    t = table(spark, sf_dir, "torrents").select("delivery_id", F.to_json(F.struct("name", "total_size", "files")).alias("j"))
    back = t.select("delivery_id", F.from_json("j", "name string, total_size long, files array<struct<path:string,size:long>>").alias("r"))
    files = F.col("r.files")
    return back.select("delivery_id", "r.name", "r.total_size", F.when(files.isNotNull(), F.size(files)).alias("n_files"), F.get(files, F.lit(0))["path"].alias("first_path"))


@query("SELECT delivery_id, CAST(CASE WHEN total_size > 0 THEN total_size // 16384 + CASE WHEN total_size % 16384 > 0 THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS pieces FROM torrents")
def requested_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of pieces of every record, of any size or none."""
    return table(spark, sf_dir, "torrents").select("delivery_id", metadata.piece_count(F.col("total_size")).alias("pieces"))


# -- metrics -----------------------------------------------------------------


@query("SELECT metric, label_key, label_value, count(*) AS samples, CAST(sum(CAST(round(value * 1000) AS BIGINT)) AS BIGINT) AS total_milli FROM metrics WHERE value IS NOT NULL GROUP BY ALL")
def counters_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "metrics").where(F.col("value").isNotNull())
    return m.groupBy("metric", "label_key", "label_value").agg(COUNT.alias("samples"), F.sum(F.round(F.col("value") * 1000).cast("long")).alias("total_milli"))


@query("SELECT metric, label_value, max({'t': ts, 'v': value}).v AS value FROM metrics WHERE value IS NOT NULL AND ts IS NOT NULL GROUP BY ALL")
def gauges_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.last_gauge(table(spark, sf_dir, "metrics"), "metric", "label_value")


@query("SELECT CASE WHEN total_size > 0 THEN CAST(1 AS BIGINT) << length(bin(total_size)) ELSE 0 END AS below, count(*) AS n FROM torrents GROUP BY 1")
def size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "torrents").groupBy(metrics.log2_bucket(F.col("total_size")).alias("below")).agg(COUNT.alias("n"))


@query(f"""WITH RECURSIVE m AS (SELECT epoch_us(received_at) // 60000000 AS t, count(*) AS n FROM announces WHERE received_at IS NOT NULL GROUP BY 1),
  o AS (SELECT *, row_number() OVER (ORDER BY t) AS rn FROM m),
  f AS (SELECT rn, t, least(n, {STATS_QUEUE}) AS depth, n AS received, n - least(n, {STATS_QUEUE}) AS dropped FROM o WHERE rn = 1
    UNION ALL SELECT o.rn, o.t, greatest(0, f.depth - (o.t - f.t)) + least(o.n, {STATS_QUEUE} - greatest(0, f.depth - (o.t - f.t))), f.received + o.n,
      f.dropped + o.n - least(o.n, {STATS_QUEUE} - greatest(0, f.depth - (o.t - f.t))) FROM f JOIN o ON o.rn = f.rn + 1)
  SELECT t AS minute, CAST(received AS BIGINT) AS received, CAST(dropped AS BIGINT) AS dropped, CAST(depth AS BIGINT) AS queue, CAST(received - dropped - depth AS BIGINT) AS dispatched,
  round(CASE WHEN received > 0 THEN dropped / received * 100 ELSE 0 END, 6) AS drop_rate, CASE WHEN depth / {STATS_QUEUE} * 100 > 80 THEN 'warn' ELSE 'info' END AS severity FROM f""")
def stats_60s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative totals, queue and severity by the pressure of the queue, at the end of each minute."""
    a = table(spark, sf_dir, "announces").where(F.col("received_at").isNotNull())
    m = a.groupBy(F.expr("unix_micros(received_at) div 60000000").alias("t")).agg(COUNT.alias("n")).withColumn("key", F.lit("all"))
    c = metrics.admission_ticks(m, "key", "t", STATS_QUEUE, 1)
    return c.select(
        F.col("t").alias("minute"), "received", "dropped", F.col("depth").alias("queue"), (F.col("received") - F.col("dropped") - F.col("depth")).alias("dispatched"),
        F.round(metrics.drop_rate(F.col("received"), F.col("dropped")), 6).alias("drop_rate"), metrics.severity(F.col("depth") / STATS_QUEUE * 100).alias("severity"),
    )


@query("""WITH m AS (SELECT sensor, count(*) AS n, (max(epoch_us(received_at)) - min(epoch_us(received_at))) // 1000000 AS uptime FROM announces GROUP BY 1)
  SELECT sensor, n, uptime, CASE WHEN n > 0 AND uptime > 0 THEN round(n / (uptime / 60), 6) END AS per_minute FROM m""")
def throughput_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.unix_micros("received_at")
    m = table(spark, sf_dir, "announces").groupBy("sensor").agg(COUNT.alias("n"), F.max(us).alias("hi"), F.min(us).alias("lo"))
    m = m.select("sensor", "n", F.expr("(hi - lo) div 1000000").alias("uptime"))
    return m.withColumn("per_minute", F.when((F.col("n") > 0) & (F.col("uptime") > 0), F.round(F.col("n") / (F.col("uptime") / 60), 6)))


DEPTH_SQL = "dep AS (SELECT event_id, CAST(sum(CASE WHEN event_type IN ('click', 'view', 'signup') THEN 2 ELSE -1 END) OVER (ORDER BY ts, event_id) AS BIGINT) AS depth FROM events)"


@query(f"""WITH {DEPTH_SQL}, p AS (SELECT event_id, depth, depth / 8000 AS pressure FROM dep)
  SELECT event_id, depth, CASE WHEN pressure < 0.8 THEN 200 WHEN pressure < 0.95 THEN 20 ELSE 0 END AS batch, CASE WHEN pressure < 0.8 THEN 10 WHEN pressure < 0.95 THEN 500 ELSE 1000 END AS sleep_ms FROM p""")
def frontier_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    delta = F.when(F.col("event_type").isin("click", "view", "signup"), 2).otherwise(-1)
    ev = table(spark, sf_dir, "events").select("event_id", "ts", delta.alias("delta"))
    run = metrics.running_total(ev, "delta", F.date_trunc("hour", "ts"), "ts", "event_id", name="depth")
    tier = metrics.pressure_tier(F.col("depth") / 8000)
    return run.select("event_id", big(F.col("depth")).alias("depth"), tier["batch"].alias("batch"), tier["sleep_ms"].alias("sleep_ms"))


@query(f"""WITH RECURSIVE m AS (SELECT coalesce(sensor, '') AS sensor, epoch_us(received_at) // 60000000 AS t, count(*) AS n FROM announces WHERE received_at IS NOT NULL GROUP BY ALL),
  o AS (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY t) AS rn FROM m),
  f AS (SELECT sensor, rn, t, least(n, {HASH_QUEUE}) AS depth, n AS received, n - least(n, {HASH_QUEUE}) AS dropped FROM o WHERE rn = 1
    UNION ALL SELECT o.sensor, o.rn, o.t, greatest(0, f.depth - (o.t - f.t)) + least(o.n, {HASH_QUEUE} - greatest(0, f.depth - (o.t - f.t))), f.received + o.n,
      f.dropped + o.n - least(o.n, {HASH_QUEUE} - greatest(0, f.depth - (o.t - f.t))) FROM f JOIN o ON o.sensor = f.sensor AND o.rn = f.rn + 1)
  SELECT sensor, CAST(received AS BIGINT) AS received, CAST(dropped AS BIGINT) AS dropped, CAST(received - dropped AS BIGINT) AS dispatched FROM f
  QUALIFY row_number() OVER (PARTITION BY sensor ORDER BY rn DESC) = 1""")
def admission_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discoveries that a queue of the default capacity takes and drops."""
    a = table(spark, sf_dir, "announces").where(F.col("received_at").isNotNull())
    per = a.groupBy(F.coalesce("sensor", F.lit("")).alias("sensor"), F.expr("unix_micros(received_at) div 60000000").alias("t")).agg(COUNT.alias("n"))
    return metrics.admission(per, "sensor", "t", HASH_QUEUE, 1)


@query("SELECT 'announces' AS source, CAST(sum(strlen(peer_addr)) AS BIGINT) AS bytes FROM announces UNION ALL SELECT 'documents', CAST(sum(octet_length(raw)) AS BIGINT) FROM documents")
def bytes_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "announces").agg(F.sum(big(F.octet_length("peer_addr"))).alias("bytes")).select(F.lit("announces").alias("source"), "bytes")
    d = table(spark, sf_dir, "documents").agg(F.sum(big(F.octet_length("raw"))).alias("bytes")).select(F.lit("documents").alias("source"), "bytes")
    return a.unionByName(d)


@query("SELECT r_name, n_name, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 4 ELSE 6 END AS INT) AS family FROM region, nation WHERE n_nationkey % 2 = 0")
def seed_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each seed with each resolved address of the wanted family; both sides are fixed lists."""
    seeds = table(spark, sf_dir, "region").select("r_name", F.lit(4).alias("family"))
    found = table(spark, sf_dir, "nation").select("n_name", F.when(F.col("n_nationkey") % 2 == 0, 4).otherwise(6).alias("family"))
    return seeds.join(found, "family").select("r_name", "n_name", "family")


@query("SELECT CAST(shard AS INT) AS shard, CAST(family AS INT) AS family, count(*) AS n FROM nodes GROUP BY ALL")
def union_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of all shards of both families, put together shard by shard."""
    n = table(spark, sf_dir, "nodes").select(F.col("shard").cast("int").alias("shard"), F.col("family").cast("int").alias("family"))
    out = n.where(F.col("shard") == 0)
    for s in range(1, nodes.SHARDS):
        out = out.unionByName(n.where(F.col("shard") == s))
    return out.groupBy("shard", "family").agg(COUNT.alias("n"))


# -- wire format -------------------------------------------------------------


def _netstring(c: Column) -> Column:
    return F.concat(F.octet_length(c).cast("string").cast("binary"), F.lit(b":"), c)


@query("""SELECT delivery_id, CASE WHEN delivery_id % 10 <> 0 AND peer_port IS NOT NULL THEN 'announce_peer' END AS q, delivery_id % 10 <> 0 AND peer_port IS NOT NULL AS ok,
  CASE WHEN delivery_id % 10 <> 0 THEN peer_port END AS port FROM announces""")
def udf_bencode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Announce messages written as bencode, some cut short or without a port, and decoded."""
    a = table(spark, sf_dir, "announces").select("delivery_id", "peer_port")
    body = F.concat(
        F.lit(b"d1:ad4:porti"), F.coalesce(F.col("peer_port").cast("string"), F.lit("")).cast("binary"),
        F.lit(b"ee1:q13:announce_peer1:t2:aa1:y1:q"), F.when(F.col("delivery_id") % 10 == 0, F.lit(b"")).otherwise(F.lit(b"e")),
    )
    m = a.select("delivery_id", bencode.decode_message(body).alias("m"))
    return m.select("delivery_id", "m.value.q", "m.ok", "m.value.a.port")


@query("SELECT delivery_id, coalesce(name, 'Unknown') AS name, total_size, 1 AS n_files FROM torrents WHERE total_size > 0")
def udf_info_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Info dictionaries of single files, written and read back with the defaults."""
    t = table(spark, sf_dir, "torrents").where(F.col("total_size").isNotNull())
    name = F.when(F.col("name").isNotNull(), F.concat(F.lit(b"4:name"), _netstring(F.col("name").cast("binary")))).otherwise(F.lit(b""))
    raw = F.concat(F.lit(b"d6:lengthi"), F.col("total_size").cast("string").cast("binary"), F.lit(b"e"), name, F.lit(b"e"))
    m = t.select("delivery_id", bencode.decode_info(raw).alias("m")).where("m.ok")
    return m.select("delivery_id", "m.value.name", "m.value.total_size", F.size("m.value.files").alias("n_files"))


def _list_bytes(items: Column) -> Column:
    """Byte strings of an array, one after the other."""
    return F.unhex(F.array_join(F.transform(items, lambda x: F.hex(x)), ""))


@query("""WITH f AS (SELECT delivery_id, coalesce(name, 'Unknown') AS name, list_filter(files, lambda x: x.size IS NOT NULL AND x.path IS NOT NULL) AS fs FROM torrents WHERE files IS NOT NULL)
  SELECT delivery_id, name, CAST(list_sum(list_transform(fs, lambda x: x.size)) AS BIGINT) AS total_size, CAST(len(fs) AS INT) AS n_files, fs[1].path AS first_path
  FROM f WHERE list_sum(list_transform(fs, lambda x: x.size)) > 0""")
def udf_info_dict_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Info dictionaries with file lists, paths in parts, written and read back."""
    t = table(spark, sf_dir, "torrents").where(F.col("files").isNotNull())
    named = F.filter("files", lambda f: f["size"].isNotNull() & f["path"].isNotNull())
    entries = F.transform(named, lambda f: F.concat(
        F.lit(b"d6:lengthi"), f["size"].cast("string").cast("binary"), F.lit(b"e4:pathl"),
        _list_bytes(F.transform(F.split(f["path"], "/"), lambda p: _netstring(p.cast("binary")))), F.lit(b"ee"),
    ))
    name = F.when(F.col("name").isNotNull(), F.concat(F.lit(b"4:name"), _netstring(F.col("name").cast("binary")))).otherwise(F.lit(b""))
    raw = F.concat(F.lit(b"d5:filesl"), _list_bytes(entries), F.lit(b"e"), name, F.lit(b"e"))
    m = t.select("delivery_id", bencode.decode_info(raw).alias("m")).where("m.ok")
    return m.select("delivery_id", "m.value.name", "m.value.total_size", F.size("m.value.files").alias("n_files"), F.get("m.value.files", F.lit(0))["path"].alias("first_path"))


PACKET_WORKERS = 4  # what the workers' queues take in a minute


@query(f"""WITH m AS (SELECT epoch_us(received_at) // 60000000 AS minute, count(*) AS n FROM announces WHERE received_at IS NOT NULL GROUP BY 1)
  SELECT 'ok' AS status, CAST(sum(least(n, {PACKET_WORKERS})) AS BIGINT) AS packets FROM m UNION ALL SELECT 'queue_full', CAST(sum(greatest(n - {PACKET_WORKERS}, 0)) AS BIGINT) FROM m""")
def packet_queue_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets that workers take, and those dropped while all queues are full: each minute takes so many."""
    a = table(spark, sf_dir, "announces").where(F.col("received_at").isNotNull())
    m = a.groupBy(F.expr("unix_micros(received_at) div 60000000").alias("minute")).agg(COUNT.alias("n"))
    both = F.array(
        F.struct(F.lit("ok").alias("status"), F.least("n", F.lit(PACKET_WORKERS)).alias("p")), F.struct(F.lit("queue_full").alias("status"), F.greatest(F.col("n") - PACKET_WORKERS, F.lit(0)).alias("p"))
    )
    return m.select(F.inline(both)).groupBy("status").agg(F.sum("p").cast("long").alias("packets"))


@query(f"WITH {ANNOUNCES} SELECT count(*) AS rows, count(h) AS hashes, CAST(sum(octet_length(encode(peer_addr))) AS BIGINT) AS bytes FROM ann")
def metrics_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics that are observed while a query runs for another purpose: no second pass."""
    seen = Observation("announced")
    a = table(spark, sf_dir, "announces").select(canonical_hash("info_hash").alias("h"), "peer_addr")
    watched = a.observe(seen, COUNT.alias("rows"), F.count("h").alias("hashes"), F.sum(big(F.octet_length("peer_addr"))).alias("bytes"))
    watched.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["rows"], seen.get["hashes"], seen.get["bytes"])], "rows long, hashes long, bytes long")


@query(f"WITH {ANNOUNCES} SELECT h AS info_hash, count(*) AS n FROM ann WHERE h IS NOT NULL AND right(h, 1) NOT IN ('0', 'f') GROUP BY 1")
def prefetch_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's function decides which hashes are fetched; where it fails, they are not."""

    def wanted(info_hash: str) -> bool:
        if info_hash.endswith("f"):
            raise RuntimeError("the user's function failed")
        return not info_hash.endswith("0")

    per = announced(spark, sf_dir).where(F.col("h").isNotNull()).groupBy(F.col("h").alias("info_hash")).agg(COUNT.alias("n"))
    return per.where(gate.user_predicate(wanted)("info_hash"))

"""Queries over the announcement and record tables for the general problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftnet.functions.identity import canonical_hash, once, with_socket_key
from driftnet.operators.delivery import hex_of_long, keep_one, surplus_deliveries
from driftnet.operators.nested import flatten, subtype_tables
from driftnet.operators.skew import hash_profile
from driftnet.plans.sqltext import ANNOUNCES, TORRENTS
from driftnet.sources.tables import table


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both kinds of message with a fixed-width hex identifier: kind, hash,
    address and port (zero-filled for records), time."""
    a = with_socket_key(table(spark, sf_dir, "announces"), "peer_addr", "peer").select(
        F.lit("announces").alias("src"), "delivery_id", "received_at", canonical_hash("info_hash").alias("h"), "peer",
        F.unix_micros("discovered_at").alias("at"),
    )
    t = table(spark, sf_dir, "torrents").select(
        F.lit("torrents").alias("src"), "delivery_id", "received_at",
        canonical_hash("info_hash").alias("h"), F.lit("").alias("peer"), F.col("timestamp").cast("long").alias("at"),
    )
    peer = F.rpad(F.regexp_replace(F.col("peer"), "-", ""), 37, "0")
    kind = F.when(F.col("src") == "announces", "a").otherwise("b")
    return a.unionByName(t).select(
        "src", "delivery_id", "received_at",
        F.concat(F.col("h"), kind, hex_of_long(F.col("at")), F.lit("0"), peer).alias("message"),
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each surplus delivery of announces and torrents."""
    m = _messages(spark, sf_dir)
    return surplus_deliveries(m, F.col("message"), F.col("received_at"), F.col("delivery_id")).select("src", "delivery_id").distinct()


def p6_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delivery that is kept of each message, and each delivery that names none."""
    m = _messages(spark, sf_dir)
    return keep_one(m, F.col("message"), F.col("received_at"), F.col("delivery_id")).select("src", "delivery_id")


def canonical_announces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Announcements with the hash, the peer and the sensor as bytes: half as long as digits where they are shuffled."""
    a = with_socket_key(table(spark, sf_dir, "announces"), "peer_addr", "peer")
    return once(a, __h=canonical_hash("info_hash")).select(
        F.unhex("__h").alias("info_hash"), F.unhex(F.concat(F.lit("0"), F.replace("peer", F.lit("-"), F.lit("")))).alias("peer"), F.col("sensor").cast("binary").alias("sensor"), "discovered_at",
        F.floor((F.unix_micros("received_at") - F.unix_micros("discovered_at")) / 1000000).cast("long").alias("delay_s"),
    )


def p4_hash_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, peers, first and last discovery, top sensor and delay percentiles of each hash."""
    return hash_profile(canonical_announces(spark, sf_dir)).select(
        F.lower(F.hex("info_hash")).alias("info_hash"), "announces", "peers", F.unix_micros("first_at").alias("first_us"), F.unix_micros("last_at").alias("last_us"),
        F.col("top_sensor").cast("string").alias("top_sensor"), "delay_p50", "delay_p90",
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per element of each payload that parses: the supertype keys of all variants' tables."""
    out = None
    for variant, df in subtype_tables(flatten(table(spark, sf_dir, "torrent_raw"))).items():
        if variant != "record_object":
            one = df.select("raw_id", "node", "parent", "kind")
            out = one if out is None else out.unionByName(one)
    empty = spark.createDataFrame([], "raw_id long, node string, parent string, kind string")
    return (empty if out is None else out).distinct()


def p3_subtypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each subtype table, and how many of them keep more than its columns hold."""
    out = spark.createDataFrame([], "variant string, rows long, with_more long")
    for variant, df in subtype_tables(flatten(table(spark, sf_dir, "torrent_raw"))).items():
        out = out.unionByName(df.agg(F.count(F.lit(1)).alias("rows"), F.count("more").alias("with_more")).select(F.lit(variant).alias("variant"), "rows", "with_more"))
    return out


QUERIES = {
    "p3_found": p3_found,
    "p3_subtypes": p3_subtypes,
    "p4_hash_profile": p4_hash_profile,
    "p6_found": p6_found,
    "p6_kept": p6_kept,
}

_MESSAGES = f"""{ANNOUNCES}, {TORRENTS}, msg AS (
  SELECT 'announces' AS src, delivery_id, received_at, h || '/' || peer || '/' || epoch_us(discovered_at)::VARCHAR AS message FROM ann
  UNION ALL SELECT 'torrents', delivery_id, received_at, h || '/' || timestamp::VARCHAR FROM tor
), ord AS (SELECT *, row_number() OVER (PARTITION BY src, message ORDER BY received_at NULLS LAST, delivery_id) AS rn FROM msg)"""



def _held(v: str) -> str:
    return f"CASE WHEN json_type({v}) = 'VARCHAR' AND json_valid({v}->>'$') THEN CAST({v}->>'$' AS JSON) ELSE {v} END"


def _list(v: str) -> str:
    return f"CASE WHEN json_type({v}) IS NULL OR json_type({v}) = 'NULL' THEN [] WHEN json_type({v}) = 'ARRAY' THEN CAST({v} AS JSON[]) ELSE [{v}] END"


#: a list of pairs (letter, list) for each element, one round of the recursion per level
_CHILDREN = "CASE e.letter WHEN 't' THEN [{'l': 'f', 'v': e.v->'$.files'}, {'l': 'p', 'v': e.v->'$.peers'}] WHEN 'f' THEN [{'l': 'f', 'v': e.v->'$.children'}] WHEN 'p' THEN [{'l': 'h', 'v': e.v->'$.have'}] ELSE [] END"

SQL = {
    "p3_found": f"""WITH RECURSIVE r0 AS (SELECT raw_id, CAST(payload AS JSON) AS v FROM torrent_raw WHERE payload IS NOT NULL AND json_valid(payload)),
  r AS (SELECT raw_id, {_held('v')} AS v FROM r0),
  e AS (SELECT raw_id, '' AS node, NULL::VARCHAR AS parent, '' AS letter, v FROM r WHERE json_type(v) = 'OBJECT'
    UNION ALL SELECT raw_id, node, parent, letter, v FROM (
      SELECT raw_id, prefix || letter || (i - 1) AS node, parent, letter, {_held('x')} AS v FROM (
        SELECT raw_id, parent, prefix, letter, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM (
          SELECT raw_id, parent, prefix, letter, {_list('w')} AS a FROM (
            SELECT raw_id, parent, prefix, u.l AS letter, {_held('u.v')} AS w FROM (
              SELECT e.raw_id, e.node AS parent, CASE WHEN e.node = '' THEN '' ELSE e.node || '.' END AS prefix,
                unnest(CASE WHEN e.letter = '' THEN [{{'l': 't', 'v': e.v->'$.torrents'}}] ELSE {_CHILDREN} END) AS u FROM e WHERE json_type(e.v) = 'OBJECT'))))) WHERE json_type(v) <> 'NULL')
  SELECT DISTINCT raw_id, node, parent, CASE letter WHEN 't' THEN 'torrent' WHEN 'p' THEN 'peer' WHEN 'h' THEN 'have' ELSE CASE WHEN json_type(v) = 'OBJECT' AND list_contains(json_keys(v), 'dir') THEN 'dir' ELSE 'file' END END AS kind
  FROM e WHERE letter <> ''""",
    "p4_hash_profile": f"""WITH {ANNOUNCES}, s AS (SELECT h, sensor, count(*) AS n FROM ann WHERE h IS NOT NULL AND sensor IS NOT NULL GROUP BY ALL),
  m AS (SELECT h, sensor FROM s QUALIFY row_number() OVER (PARTITION BY h ORDER BY n DESC, sensor) = 1)
  SELECT a.h AS info_hash, count(*) AS announces, count(DISTINCT peer) AS peers, epoch_us(min(discovered_at)) AS first_us, epoch_us(max(discovered_at)) AS last_us,
  any_value(m.sensor) AS top_sensor, quantile_disc(delay_s, 0.5) AS delay_p50, quantile_disc(delay_s, 0.9) AS delay_p90
  FROM ann a LEFT JOIN m ON a.h = m.h WHERE a.h IS NOT NULL GROUP BY a.h""",
    "p6_found": f"WITH {_MESSAGES} SELECT DISTINCT src, delivery_id FROM ord WHERE message IS NOT NULL AND rn > 1",
    "p6_kept": f"WITH {_MESSAGES} SELECT src, delivery_id FROM ord WHERE message IS NULL OR rn = 1",
}

"""The queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftnet.functions.identity import address_family, canonical_hash, with_socket_key
from driftnet.llm import abuse, distinct, encoding, heavy, leakage, mixing, visual
from driftnet.plans.sqltext import ANNOUNCES
from driftnet.sources.tables import table


_GROUPS = ["day", "sensor", "family"]


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_socket_key(table(spark, sf_dir, "announces"), "peer_addr", "peer").select(
        F.to_date("discovered_at").cast("string").alias("day"), "sensor", address_family("peer").cast("int").alias("family"),
        canonical_hash("info_hash").alias("hash"), "peer",
    )


def p1_distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct hashes and peers per day, sensor, family and each combination."""
    parts = distinct.partial_bitmaps(_seen(spark, sf_dir), _GROUPS, {"hashes": "hash", "peers": "peer"})
    every = distinct.combinations(parts, _GROUPS)
    return distinct.estimates(every, [*_GROUPS, "grouping"], ["hashes", "peers"]).withColumn("error_bound", F.lit(distinct.ERROR_BOUND))


def p1_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The estimates against exact counts: per combination its groups, the greatest relative
    error of either field, and the groups whose errors are within the bound."""
    values = F.array(F.struct(F.lit("hashes").alias("field"), F.col("hash").alias("v")), F.struct(F.lit("peers").alias("field"), F.col("peer").alias("v")))
    fine = _seen(spark, sf_dir).select(*_GROUPS, F.inline(values)).where(F.col("v").isNotNull()).distinct()
    every = fine.select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("grouping")).select(
        "field", "v", "grouping", *[F.when(F.col("grouping").bitwiseAND(4 >> i) == 0, F.col(g)).alias(g) for i, g in enumerate(_GROUPS)]
    ).distinct()  # distinct first, so that no group is counted in one task
    exact = every.groupBy(*_GROUPS, "grouping").agg(F.sum((F.col("field") == "hashes").cast("long")).alias("h"), F.sum((F.col("field") == "peers").cast("long")).alias("p"))
    est = p1_distinct_counts(spark, sf_dir)
    same = [est[g].eqNullSafe(exact[g]) for g in [*_GROUPS, "grouping"]]
    error = F.greatest(*[F.when(c > 0, F.abs(e - c) / c).otherwise(F.lit(0.0)) for e, c in ((F.col("hashes"), F.col("h")), (F.col("peers"), F.col("p")))])
    joined = est.join(exact, same[0] & same[1] & same[2] & same[3]).select(est["grouping"], error.alias("e"))
    return joined.groupBy("grouping").agg(
        F.count(F.lit(1)).alias("groups"), F.round(F.max("e"), 6).alias("worst"), F.sum((F.col("e") <= distinct.ERROR_BOUND).cast("long")).alias("within")
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each hash that at least 0.5 % of all announcements name."""
    a = table(spark, sf_dir, "announces")
    return heavy.values_over_share(a, canonical_hash("info_hash"), 0.005).select(F.col("value").alias("info_hash"))


def p2_top_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 hashes announced most often."""
    a = table(spark, sf_dir, "announces")
    return heavy.top_values(a, canonical_hash("info_hash"), 20).select(F.col("value").alias("info_hash"), F.col("n").alias("announces"))


def torrent_texts(spark: SparkSession, sf_dir: str, path: Column) -> DataFrame:
    """(delivery_id, field, file_ord, text): names, and of each file what path
    makes of x.path. Null texts are left out."""
    t = table(spark, sf_dir, "torrents")
    name = t.select("delivery_id", F.lit("name").alias("field"), F.lit(-1).alias("file_ord"), F.col("name").alias("text"))
    files = t.select("delivery_id", F.posexplode("files").alias("file_ord", "x"))
    paths = files.select("delivery_id", F.lit("path").alias("field"), "file_ord", path.alias("text"))
    return name.unionByName(paths).where(F.col("text").isNotNull())


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each name or first part of a path that looks like a title but is written otherwise."""
    texts = torrent_texts(spark, sf_dir, F.substring_index("x.path", "/", 1))
    found = visual.recognised(texts, table(spark, sf_dir, "titles")).where(F.col("text") != F.col("title"))
    return found.select("delivery_id", "field", "file_ord", "title_id").distinct()


def p5_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of each distinct name and path."""
    texts = torrent_texts(spark, sf_dir, F.col("x.path"))
    return visual.consistent_forms(texts).select("text", "form")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each name and whole path that shows characters of a wrong encoding."""
    texts = torrent_texts(spark, sf_dir, F.col("x.path"))
    return encoding.garbled_rows(texts, ["delivery_id", "field", "file_ord"]).select("delivery_id", "field", "file_ord")


def p7_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct garbled text and its original, where that can be recovered."""
    return encoding.garbled_texts(torrent_texts(spark, sf_dir, F.col("x.path"))).select("text", "restored")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and item that share at least 12 consecutive words."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")
    return leakage.leaked_passages(docs, items, verbatim=True).select("doc_id", "item_id").distinct()


def p8_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item: documents with a passage at least 0.8 similar, the windows in them, and documents with a verbatim one."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")
    links = leakage.leaked_passages(docs, items)
    return links.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("windows").alias("windows"), F.sum((F.col("similarity") == 1).cast("long")).alias("with_verbatim")
    )


def p8_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of passages planted with 1 to 3 changed words in 12 to 60: how many are found."""
    items = table(spark, sf_dir, "eval_items")
    planted = leakage.edited_passages(items, table(spark, sf_dir, "documents"))
    links = leakage.leaked_passages(planted, items).select("doc_id", "item_id", F.lit(1).alias("hit"))
    return planted.select("doc_id", "item_id", "changed").join(links, ["doc_id", "item_id"], "left").groupBy("changed").agg(
        F.count(F.lit(1)).alias("planted"), F.count("hit").alias("found"), (F.count("hit") / F.count(F.lit(1))).alias("recall")
    )


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.count_once(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents drawn for the target mixture, in their global order."""
    return mixing.mix(_counted(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of tokens that each source reaches in the mixture."""
    counted, targets = _counted(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    return mixing.shares(counted, mixing.mix(counted, targets), targets)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = abuse.fit_model(docs, table(spark, sf_dir, "content_labels"))
    return abuse.score_documents(docs.select("doc_id", "source", "text"), model)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with abusive, hateful or sexually explicit language."""
    return _scored(spark, sf_dir).where("flagged").select("doc_id").distinct()


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with such language per source."""
    return abuse.rates_by_source(_scored(spark, sf_dir))


QUERIES = {
    "p1_distinct_counts": p1_distinct_counts,
    "p1_error": p1_error,
    "p2_found": p2_found,
    "p2_top_hashes": p2_top_hashes,
    "p5_found": p5_found,
    "p5_forms": p5_forms,
    "p7_found": p7_found,
    "p7_restored": p7_restored,
    "p8_found": p8_found,
    "p8_leaked_items": p8_leaked_items,
    "p8_recall": p8_recall,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_rates": p10_rates,
}

_POSITION = "CASE WHEN x = 0 THEN 39 ELSE least(39, bit_count((x & -x) - 1)) END"
_WORDS = r"regexp_extract_all(lower(regexp_replace(text, '[\x{ad}\x{34f}\x{180b}-\x{180f}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{fe00}-\x{fe0f}\x{feff}]', '', 'g')), '[\pL\p{Nd}]+')"
_WINDOWS = "unnest(list_transform(range(1, greatest(len(w) - 10, 1)), lambda i: array_to_string(w[i : i + 11], ' ')))"

SQL: dict[str, str] = {
    # the same bitmaps, slice by slice, from the hex digits of MD5
    "p1_distinct_counts": f"""WITH {ANNOUNCES}, v AS (
    SELECT strftime(discovered_at, '%Y-%m-%d') AS day, sensor, CAST(left(peer, 1) AS INT) AS family, unnest([{{'f': 'hashes', 'v': h}}, {{'f': 'peers', 'v': peer}}]) AS u FROM ann
  ), d AS (SELECT DISTINCT day, sensor, family, u.f AS f, CAST('0x' || substr(md5(u.v), 1, 15) AS BIGINT) AS x FROM v WHERE u.v IS NOT NULL
  ), b AS (SELECT DISTINCT day, sensor, family, f, {_POSITION} AS slice, x >> 48 AS bit FROM d
  ), g AS (SELECT CASE WHEN m & 4 = 0 THEN day END AS day, CASE WHEN m & 2 = 0 THEN sensor END AS sensor, CASE WHEN m & 1 = 0 THEN family END AS family, m AS "grouping", f, slice,
    count(DISTINCT bit) AS n FROM b, range(8) t(m) GROUP BY ALL
  ), s AS (SELECT day, sensor, family, "grouping", f, slice, n, max(CASE WHEN n > {distinct.SET_MAX} THEN slice + 1 ELSE 0 END) OVER (PARTITION BY day, sensor, family, "grouping", f) AS base FROM g
  ), e AS (SELECT day, sensor, family, "grouping", f, CAST(round(sum({distinct.SLICE_BITS} * ln({distinct.SLICE_BITS} / ({distinct.SLICE_BITS} - least(n, {distinct.SLICE_BITS - 1}))) ORDER BY slice)
      FILTER (WHERE slice >= base) * pow(2, any_value(base))) AS BIGINT) AS est FROM s GROUP BY ALL)
  SELECT day, sensor, family, CAST("grouping" AS INT) AS "grouping", coalesce(max(est) FILTER (WHERE f = 'hashes'), 0) AS hashes, coalesce(max(est) FILTER (WHERE f = 'peers'), 0) AS peers,
  CAST({distinct.ERROR_BOUND} AS DOUBLE) AS error_bound FROM e GROUP BY day, sensor, family, "grouping\"""",
    "p2_found": f"WITH {ANNOUNCES} SELECT h AS info_hash FROM ann WHERE h IS NOT NULL GROUP BY 1 HAVING count(*) * 1000 >= 5 * (SELECT count(*) FROM announces)",
    "p2_top_hashes": f"WITH {ANNOUNCES}, n AS (SELECT h AS info_hash, count(*) AS announces FROM ann WHERE h IS NOT NULL GROUP BY 1) SELECT * FROM n QUALIFY rank() OVER (ORDER BY announces DESC) <= 20",
    "p8_found": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM eval_items),
  dw AS (SELECT DISTINCT doc_id, {_WINDOWS} AS p FROM d WHERE len(w) > 11), iw AS (SELECT DISTINCT item_id, {_WINDOWS} AS p FROM i WHERE len(w) > 11)
  SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (p)""",
    # windows with a common shingle in the same place, weighed by the shingles of each word
    "p8_leaked_items": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM eval_items),
  ds0 AS (SELECT doc_id, len(w) AS n, unnest(list_transform(range(1, len(w) - 3), lambda p: {{'p': p, 's': array_to_string(w[p : p + 4], ' ')}})) AS u FROM d WHERE len(w) > 11), ds AS (SELECT doc_id, n, u.p AS p, u.s AS s FROM ds0),
  si0 AS (SELECT item_id, len(w) AS n, unnest(list_transform(range(1, len(w) - 3), lambda p: {{'p': p, 's': array_to_string(w[p : p + 4], ' ')}})) AS u FROM i WHERE len(w) > 11), si AS (SELECT item_id, n, u.p AS p, u.s AS s FROM si0),
  m AS (SELECT doc_id, item_id, ds.p - k AS a, si.p - k AS b FROM ds JOIN si USING (s), range(8) t(k) WHERE ds.p - k >= 1 AND si.p - k >= 1 AND ds.p - k + 11 <= ds.n AND si.p - k + 11 <= si.n GROUP BY ALL),
  e AS (SELECT doc_id, item_id, a, list_sum(list_transform(range(12), lambda k: CASE WHEN d.w[a + k] = i.w[b + k] THEN least(k + 1, 5, 12 - k) ELSE 0 END)) / 40 AS x
    FROM m JOIN d USING (doc_id) JOIN i USING (item_id)),
  l AS (SELECT doc_id, item_id, count(DISTINCT a) AS windows, max(x) AS similarity FROM e WHERE x >= 0.8 GROUP BY ALL)
  SELECT item_id, count(*) AS documents, CAST(sum(windows) AS BIGINT) AS windows, CAST(sum(CASE WHEN similarity = 1 THEN 1 ELSE 0 END) AS BIGINT) AS with_verbatim FROM l GROUP BY 1""",
}
SQL["p1_error"] = f"""WITH est AS ({SQL['p1_distinct_counts']}), {ANNOUNCES}, f AS (
    SELECT strftime(discovered_at, '%Y-%m-%d') AS day, sensor, CAST(left(peer, 1) AS INT) AS family, h, peer FROM ann),
  x AS (SELECT CASE WHEN m & 4 = 0 THEN day END AS day, CASE WHEN m & 2 = 0 THEN sensor END AS sensor, CASE WHEN m & 1 = 0 THEN family END AS family, CAST(m AS INT) AS "grouping",
    count(DISTINCT h) AS nh, count(DISTINCT peer) AS np FROM f, range(8) t(m) GROUP BY ALL),
  e AS (SELECT est."grouping" AS g, greatest(CASE WHEN nh > 0 THEN abs(hashes - nh) / nh ELSE 0 END, CASE WHEN np > 0 THEN abs(peers - np) / np ELSE 0 END) AS e FROM est JOIN x ON est."grouping" = x."grouping"
    AND est.day IS NOT DISTINCT FROM x.day AND est.sensor IS NOT DISTINCT FROM x.sensor AND est.family IS NOT DISTINCT FROM x.family)
  SELECT g AS "grouping", count(*) AS "groups", round(max(e), 6) AS worst, CAST(sum(CASE WHEN e <= {distinct.ERROR_BOUND} THEN 1 ELSE 0 END) AS BIGINT) AS within FROM e GROUP BY 1"""

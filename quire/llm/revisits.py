"""WARC not-modified revisits: an as-of join to the latest earlier full response.

A revisit record says that a page had not changed, and has no body of its own. It is
resolved to the latest earlier full response of the same canonical URL, if their
validators agree: entity tags (compared weakly) where both have one, else
modification dates, else payload digests. The merged headers are the stored response's,
updated by those of the revisit that a not-modified answer may change.

Scale. Records are range-partitioned by URL and time, so a URL with a third of all
records is cut over many tasks; each piece of a URL is searched alone, by a running
maximum, and what earlier pieces end with is carried over in a table with rows only for
URLs in more than one piece, at most two a partition. Bodies are never moved: the
result names the record that holds them.

Defined results: a null URL resolves to nothing (``no_response``), as does a revisit with
no earlier response; validators that differ give ``mismatch`` and name no record;
no validator in common gives ``unverified``, with the record; of responses at the same
time the greater record id counts, and those at the revisit's own time are not earlier;
null headers count as none, and of headers whose names differ in case only the last in order of code points; repeated records are resolved each; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm import common

#: Headers that a not-modified answer may bring up to date.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that do not name a resource: fixed values, extended by parameter.
TRACKING = ("ref", "gclid", "fbclid", "sessionid", "sid")
TRACKING_PREFIX = "utm_"


def canonical(url: Column, tracking=TRACKING) -> Column:
    """Host, path and sorted query of a URL, without what does not name a resource.

    Scheme, credentials, www, default port, fragment and tracking parameters go; the
    host is lower-cased; an empty path is '/', and a trailing slash goes."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_extract(bare, r"^[^/?]*", 0)
    host = F.regexp_replace(F.lower(host), r"^[^@]*@", "")
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www[0-9]*\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    named = F.filter(
        F.split(query, "&"),
        lambda p: (p != "")
        & ~F.substring_index(p, "=", 1).isin(*tracking)
        & ~p.startswith(TRACKING_PREFIX),
    )
    kept = F.array_join(F.array_sort(named), "&")
    return F.concat(host, F.when(path == "", "/").otherwise(path), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def lowered(headers: Column) -> Column:
    """Headers by lower-cased name; of names that differ in case only, the last in order of
    code points counts, as a map has no order of its own."""
    entries = F.array_sort(F.transform(
        F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))),
        lambda e: F.struct(F.lower(e["key"]).alias("key"), e["key"].alias("name"), e["value"].alias("value")),
    ))
    last = F.filter(entries, lambda e, i: ~F.get(entries, i + 1)["key"].eqNullSafe(e["key"]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))


def resolve(records: DataFrame, permitted=PERMITTED, tracking=TRACKING) -> DataFrame:
    """A row per revisit: record_id, url_key, response_id, outcome, headers.

    ``records``: record_id, kind ('response' or 'revisit'), url, ts (long), status,
    digest, headers (map of strings, any case; etag and last-modified are read there).
    Only responses with status 200 are full.
    """
    spark = records.sparkSession
    rows = records.select(
        "record_id", "kind", "ts", canonical(F.col("url"), tracking).alias("url_key"), "status", "digest",
        lowered(F.col("headers")).alias("h"),
    ).where("kind = 'revisit' OR (kind = 'response' AND status = 200)")
    body = F.struct(
        "ts", "record_id",
        F.array_sort(F.map_entries("h")).alias("entries"),
        "digest",
    )
    slim = rows.select(
        "record_id", "kind", "ts", "url_key", "digest", "h",
        F.when(F.col("kind") == "response", body).alias("full"),
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = slim.where("url_key IS NOT NULL AND ts IS NOT NULL")
    placed = common.stage(
        known.repartitionByRange(n, "url_key", "ts").withColumn("piece", F.spark_partition_id()), "warc-pieces"
    )
    earlier = (
        Window.partitionBy("url_key", "piece").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    )
    ends = placed.groupBy("url_key", "piece").agg(F.max("full").alias("last"))
    cut = ends.groupBy("url_key").agg(F.count("*").alias("pieces")).where("pieces > 1").select("url_key")
    before = Window.partitionBy("url_key").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.join(cut, "url_key").select("url_key", "piece", F.max("last").over(before).alias("carried"))
    found = (
        placed.withColumn("near", F.max("full").over(earlier))
        .where("kind = 'revisit'")
        .join(carried, ["url_key", "piece"], "left")
        .select("record_id", "url_key", "digest", "h", F.coalesce("near", "carried").alias("r"))
    )
    lost = slim.where("kind = 'revisit' AND (url_key IS NULL OR ts IS NULL)").select(
        "record_id", "url_key", "digest", "h", F.lit(None).cast(found.schema["r"].dataType).alias("r")
    )
    stored = F.map_from_entries("r.entries")
    both = found.unionByName(lost).withColumn("s", stored)
    tag = lambda c: F.regexp_replace(F.col(c)["etag"], "^W/", "")
    outcome = (
        F.when(F.col("r").isNull(), "no_response")
        .when(F.col("h")["etag"].isNotNull() & F.col("s")["etag"].isNotNull(), _agree(tag("h") == tag("s")))
        .when(
            F.col("h")["last-modified"].isNotNull() & F.col("s")["last-modified"].isNotNull(),
            _agree(F.col("h")["last-modified"] == F.col("s")["last-modified"]),
        )
        .when(F.col("digest").isNotNull() & F.col("r.digest").isNotNull(), _agree(F.col("digest") == F.col("r.digest")))
        .otherwise("unverified")
    )
    fresh = F.map_filter("h", lambda k, v: k.isin(*permitted))
    merged = F.map_concat(
        F.map_filter("s", lambda k, v: ~F.array_contains(F.map_keys(F.col("fresh")), k)), F.col("fresh")
    )
    good = F.col("outcome").isin("resolved", "unverified")
    return both.withColumn("outcome", outcome).withColumn("fresh", fresh).select(
        "record_id", "url_key",
        F.when(good, F.col("r.record_id")).alias("response_id"),
        "outcome",
        F.when(good, merged).alias("headers"),
    )


def _agree(same: Column) -> Column:
    return F.when(same, "resolved").otherwise("mismatch")


LAG = 40


def captures(pages: DataFrame) -> DataFrame:
    """A crawl made of ``pages``: each is fetched in full at time 2 * page_id, and asked
    for again, by its entity tag, LAG pages later; that answer is a revisit."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    tag = F.concat(F.lit('"'), F.md5(F.col("html").cast("binary")), F.lit('"'))
    lines = lambda *pairs: F.create_map(*[x if isinstance(x, Column) else F.lit(x) for p in pairs for x in p])
    full = rows.select(
        (F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("kind"), "url",
        (F.col("page_id") * 2).alias("ts"), F.lit(200).alias("status"), F.md5(F.col("html").cast("binary")).alias("digest"),
        lines(
            ("Content-Type", "text/html"), ("Content-Length", F.length("html").cast("string")), ("ETag", tag),
            ("Date", (F.col("page_id") * 2).cast("string")), ("Cache-Control", "max-age=60"),
        ).alias("headers"),
    )
    again = rows.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), "url",
        ((F.col("page_id") + LAG) * 2 + 1).alias("ts"), F.lit(304).alias("status"), F.lit(None).cast("string").alias("digest"),
        lines(
            ("ETag", tag), ("Date", ((F.col("page_id") + LAG) * 2 + 1).cast("string")),
            ("Cache-Control", "max-age=120"), ("Content-Length", "0"), ("Set-Cookie", "id=1"),
        ).alias("headers"),
    )
    return full.unionByName(again)


def op2_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve(captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.select(
        "record_id", "url_key", "response_id", "outcome", F.array_join(lines, "\n").alias("headers")
    )


ORACLE = rf"""
WITH bare AS (
  SELECT page_id, coalesce(html, '') AS html,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS b FROM pages),
parts AS (
  SELECT page_id, html,
         regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(b, '^[^/?]*')), '^[^@]*@', ''), ':(80|443)$', ''), '^www[0-9]*\.', '') AS host,
         regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(b, '\?(.*)$', 1), '&'),
           lambda p: p <> '' AND split_part(p, '=', 1) NOT IN ({', '.join(f"'{t}'" for t in TRACKING)})
                     AND NOT starts_with(p, '{TRACKING_PREFIX}'))), '&') AS query
  FROM bare),
keyed AS (
  SELECT page_id, html, md5(html) AS tag,
         host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS url_key
  FROM parts),
found AS (
  SELECT r.page_id, r.url_key, r.tag AS rtag, s.page_id AS spage, s.tag AS stag, s.html AS shtml
  FROM (SELECT *, (page_id + {LAG}) * 2 + 1 AS ts FROM keyed) r
  ASOF LEFT JOIN (SELECT *, page_id * 2 AS ts FROM keyed) s ON r.url_key = s.url_key AND r.ts > s.ts)
SELECT page_id * 2 + 1 AS record_id, url_key,
       CASE WHEN rtag = stag THEN spage * 2 END AS response_id,
       CASE WHEN spage IS NULL THEN 'no_response' WHEN rtag = stag THEN 'resolved' ELSE 'mismatch' END AS outcome,
       CASE WHEN rtag = stag THEN 'cache-control: max-age=120' || chr(10) || 'content-length: ' || len(shtml) || chr(10)
            || 'content-type: text/html' || chr(10) || 'date: ' || ((page_id + {LAG}) * 2 + 1) || chr(10)
            || 'etag: "' || rtag || '"' END AS headers
FROM found
"""

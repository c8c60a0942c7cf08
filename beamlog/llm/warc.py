"""WARC revisits: not-modified records get the latest earlier full response of their canonical URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

# Header fields that a 304 response may renew in the stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
# Query parameters that name a visit and not a page.
VISIT_PARAMETERS = "utm_[a-z]+|gclid|fbclid|ref|sessionid"
#: Records per time slice, on average; a URL's records are ordered within a slice, and slices among each other.
SLICE_ROWS = 50_000
#: Equal parts of the records' time range whose counts decide where slices end.
MOMENTS = 1 << 16


def canonical_url(url: Column) -> Column:
    """host[:port]/path?query: no scheme, user, www., default port, fragment, visit parameters or closing slash.

    The host is lower-cased and what is left of the query sorted. Null stays null; the empty text stays empty.
    """
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^[^/?]*", 0)), "^www[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.split(F.regexp_extract(rest, "[?](.*)$", 1), "&")
    kept = F.array_sort(F.filter(query, lambda p: (p != "") & ~p.rlike(f"^({VISIT_PARAMETERS})(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def lower_names(headers: Column) -> Column:
    """Header map with lower-case names; of names that differ in case only, the last one stays. Null is empty."""
    entries = F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>"))
    named = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(named, lambda e, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def validators_agree(stored_headers: Column, revisit: Column) -> Column:
    """Entity tags compare weakly where the revisit has one, else modification dates compare as text; without either, false."""
    tag = lambda h: F.regexp_replace(F.trim(h["etag"]), "^W/", "")
    return F.coalesce(F.when(revisit["etag"].isNotNull(), tag(stored_headers) == tag(revisit)).otherwise(F.trim(stored_headers["last-modified"]) == F.trim(revisit["last-modified"])), F.lit(False))


def resolve_revisits(records: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row per not-modified record of ``records`` (record_id, url, captured_at, status, headers, digest).

    A record with status 304 is a revisit, one with status 200 a full response; others play no part. Returned:
    record_id, canonical_url, captured_at, ref_id, outcome, digest, headers. The reference is the latest full
    response of the canonical URL strictly before the revisit (of equal times the largest record_id; a null
    time or URL has none). outcome is resolved, validator_mismatch or no_response; only a resolved row has
    the reference's digest and its headers, renewed by the revisit's permitted ones. Repeated rows repeat.

    Of full responses, or of revisits, that share a record_id, the one of the least hash of headers and digest
    counts. URLs are cut into time slices of about ``slice_rows`` records: a grouped maximum per (URL, slice) and a
    running maximum over a URL's slices bring the latest response before the slice, a window inside (URL, slice)
    those within it. A URL that holds a third of all records is thus ordered in many tasks, those of a burst too.
    Payloads are never shuffled, only digests.
    """
    rows = records.where(F.col("status").isin(200, 304)).select(
        "record_id", canonical_url(F.col("url")).alias("canonical_url"), "captured_at", F.unix_micros(F.col("captured_at").cast("timestamp")).alias("at"),
        (F.col("status") == 200).alias("full"), lower_names(F.col("headers")).alias("own"), F.col("digest").alias("own_digest"))
    rows = stored(rows, "captures")
    low, high = (x or 0 for x in rows.agg(F.min("at"), F.max("at")).first())
    moment = F.floor((F.col("at") - F.lit(low)) / F.lit(max(1, -(-(high - low + 1) // MOMENTS))))
    counts = rows.where("at is not null").groupBy(moment.alias("moment")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("moment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # MOMENTS rows at most
    slices = stored(counts.select("moment", F.floor(before / slice_rows).alias("slice")), "moments")
    placed = rows.select("record_id", "canonical_url", "captured_at", "at", "full", moment.alias("moment")).join(F.broadcast(slices), "moment", "left").drop("moment")
    response = F.when(F.col("full"), F.struct("at", "record_id"))
    known = placed.where("canonical_url is not null and at is not null")
    ends = known.groupBy("canonical_url", "slice").agg(F.max(response).alias("latest"))
    earlier = Window.partitionBy("canonical_url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # one row a slice
    carried = stored(ends.select("canonical_url", "slice", F.max("latest").over(earlier).alias("before")), "slices")
    inside = Window.partitionBy("canonical_url", "slice").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    seen = known.withColumn("within", F.max(response).over(inside)).where("not full")
    found = seen.join(carried, ["canonical_url", "slice"], "left").select("record_id", "canonical_url", "captured_at", F.coalesce("within", "before")["record_id"].alias("ref_id"))
    found = found.unionByName(placed.where("not full and (canonical_url is null or at is null)").select("record_id", "canonical_url", "captured_at", F.lit(None).cast(placed.schema["record_id"].dataType).alias("ref_id")))

    # Stored, so that nothing stands between exchange and join and AQE may split a reference that most revisits share.
    hashed = F.xxhash64(F.array_sort(F.map_entries("own")), "own_digest")
    one = lambda part, name: rows.where(part).groupBy(F.col("record_id").alias(f"{name}_id")).agg(F.min_by(F.struct("own", "own_digest"), hashed).alias("x"))
    revisits = stored(one("not full", "v").select("v_id", F.col("x.own").alias("v_headers")), "revisits")
    full = stored(one("full", "f").select("f_id", F.col("x.own").alias("f_headers"), F.col("x.own_digest").alias("f_digest")), "responses")
    both = found.join(revisits, F.col("record_id").eqNullSafe(F.col("v_id")), "left").join(full, F.col("ref_id") == F.col("f_id"), "left")
    permitted = F.map_filter("v_headers", lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("f_headers", lambda k, _: ~F.map_contains_key(permitted, k)), permitted)
    good = F.col("f_id").isNotNull() & validators_agree(F.col("f_headers"), F.col("v_headers"))
    return both.select(
        "record_id", "canonical_url", "captured_at", "ref_id", F.when(F.col("f_id").isNull(), "no_response").when(good, "resolved").otherwise("validator_mismatch").alias("outcome"),
        F.when(good, F.col("f_digest")).alias("digest"), F.when(good, merged).alias("headers"))


def page_captures(pages: DataFrame) -> DataFrame:
    """The pages as a crawl's full responses, and a second crawl that found each of them not modified.

    Fixed rules by page_id: revisits come 60 days later (before the first crawl for every 11th), under https
    with a visit parameter; every 5th has a changed entity tag and every 7th only a modification date.
    """
    p = F.col("page_id")
    digest = F.md5(F.coalesce(F.col("html"), F.lit("")))
    start = F.timestamp_micros(F.lit(1_704_067_200_000_000) + p * 60_000_000)
    modified = F.concat(F.lit("day "), (p % 28).cast("string"))
    headers = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), F.concat(F.lit('"'), digest, F.lit('"')), F.lit("Last-Modified"), modified, F.lit("Date"), F.lit("first"))
    full = pages.select((2 * p).alias("record_id"), "url", start.alias("captured_at"), F.lit(200).alias("status"), headers.alias("headers"), digest.alias("digest"))
    tag = F.when(p % 5 == 4, F.lit('W/"changed"')).otherwise(F.concat(F.lit('W/"'), digest, F.lit('"')))
    renewed = F.create_map(F.lit("content-type"), F.lit("none"), F.lit("date"), F.lit("second"), F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("last-modified"), modified)
    again = F.when(p % 7 == 3, renewed).otherwise(F.map_concat(renewed, F.create_map(F.lit("etag"), tag)))
    url = F.concat(F.regexp_replace(F.regexp_replace("url", "^http:", "https:"), "#.*$", ""), F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("utm_medium=crawl"))
    later = F.timestamp_micros(F.unix_micros(start) + F.when(p % 11 == 0, -86_400_000_000 * 700).otherwise(86_400_000_000 * 60))
    return full.unionByName(pages.select((2 * p + 1).alias("record_id"), url.alias("url"), later.alias("captured_at"), F.lit(304).alias("status"), again.alias("headers"), F.lit(None).cast("string").alias("digest")))


def op10_warc_revisits(spark, sf_dir: str) -> DataFrame:
    got = resolve_revisits(page_captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return got.select("record_id", "canonical_url", F.unix_micros("captured_at").alias("captured_us"), "ref_id", "outcome", "digest", lines.alias("headers"))


_CANONICAL_SQL = rf"""
  regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^www[.]', ''), ':(80|443)$', '')
  || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '')
  || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END
"""

OP10_SQL = rf"""
WITH p AS (SELECT page_id AS p, url, md5(coalesce(html, '')) AS digest, 1704067200000000 + page_id * 60000000 AS t FROM pages),
c AS (SELECT 2 * p AS record_id, url, t, true AS is_full, digest, '"' || digest || '"' AS etag, 'day ' || (p % 28) AS modified FROM p
  UNION ALL
  SELECT 2 * p + 1, regexp_replace(regexp_replace(url, '^http:', 'https:'), '#.*$', '') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_medium=crawl',
         t + CASE WHEN p % 11 = 0 THEN -86400000000 * 700 ELSE 86400000000 * 60 END, false, NULL,
         CASE WHEN p % 7 = 3 THEN NULL WHEN p % 5 = 4 THEN 'W/"changed"' ELSE 'W/"' || digest || '"' END, 'day ' || (p % 28) FROM p),
r AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?', '') AS rest FROM c),
q AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(rest, '[?](.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^({VISIT_PARAMETERS})(=|$)'))) AS kept FROM r),
u AS (SELECT *, {_CANONICAL_SQL} AS canonical_url FROM q),
f AS (SELECT v.record_id, v.canonical_url, v.t, v.etag, v.modified, arg_max(s.record_id, (s.t, s.record_id)) AS ref_id
      FROM u v LEFT JOIN u s ON s.is_full AND s.canonical_url = v.canonical_url AND s.t < v.t WHERE NOT v.is_full GROUP BY ALL),
j AS (SELECT f.*, s.digest, s.etag AS s_etag, s.modified AS s_modified,
             s.record_id IS NOT NULL AND coalesce(CASE WHEN f.etag IS NOT NULL THEN regexp_replace(s.etag, '^W/', '') = regexp_replace(f.etag, '^W/', '') ELSE s.modified = f.modified END, false) AS good
      FROM f LEFT JOIN u s ON s.record_id = f.ref_id)
SELECT record_id, canonical_url, t AS captured_us, ref_id,
       CASE WHEN ref_id IS NULL THEN 'no_response' WHEN good THEN 'resolved' ELSE 'validator_mismatch' END AS outcome,
       CASE WHEN good THEN digest END AS digest,
       CASE WHEN good THEN 'cache-control=max-age=60;content-type=text/html;date=second;etag=' || coalesce(etag, s_etag) || ';last-modified=' || modified END AS headers
FROM j
"""

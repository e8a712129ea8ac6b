"""Resolution of not-modified WARC revisits by an as-of join on the canonical URL.

A capture is a full response (record_type 'response') or a revisit ('revisit', status 304) that refers to an earlier one.
A revisit resolves to the latest response of the same canonical URL strictly before it in time (ties: the greater record_id), if the validators agree:
where both sides have an ETag they must be equal (weak comparison, 'W/' aside); else where both have Last-Modified it must not
have changed; without a common validator it doesn't resolve. The resolved record takes the response's payload and headers,
updated by those headers of the revisit that a 304 may carry; content headers always stay the response's.

The as-of join is a last-value scan by URL over time. A URL that holds a third of all rows is cut in blocks of time, each
scanned by itself; what comes before a block, its URL's latest response, is a scan over the blocks.

A null URL or time never resolves nor serves; rows equal in URL and time are ordered by record_id; repeated rows resolve
alike, one row for each; a null payload is a payload; null headers are no headers. Header names are compared without regard to
case. Other columns are left out, and their names don't matter. Very long URLs and payloads are taken whole. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: The headers that a 304 response may update (RFC 9110, 15.4.5, and RFC 9111, 3.2).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary", "last-modified")
BLOCK_SECONDS = 1024


def canonical(url) -> F.Column:
    """Scheme, 'www.' and 'm.', default port, fragment, tracking parameter, index suffix and last slash aside; host lower-cased."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    u = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, r"^([^/?]*)", 1)), r":(80|443)$", ""), r"^(www|m)\.", "")
    rest = F.regexp_replace(F.regexp_extract(u, r"^[^/?]*(.*)$", 1), r"([?&])(ref|utm_[a-z]+)=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(rest, r"&&+", "&"), r"[?&]+$", "")
    return F.concat(host, F.regexp_replace(F.regexp_replace(rest, r"\.html?$", ""), r"/$", ""))


def resolve(captures: DataFrame, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """The revisits of captures (record_id, url, ts long, record_type, etag, last_modified, headers map, payload) with
    canonical_url, refers_to, outcome ('resolved', 'changed', 'no validator', 'no response'), merged_headers, and payload of the response.

    Payloads don't travel through the scan: only record ids do, and resolved ones fetch theirs by one join, whose both sides are
    exchanged and nothing else, so adaptive execution can split a response that very many revisits refer to. Only where a
    response's record id repeats are payloads brought to one row an id first (the least payload stays)."""
    slim = written(captures.withColumn("canonical_url", canonical(F.col("url"))).select("canonical_url", "record_id", "ts", "record_type", "etag", "last_modified", "headers").withColumn("block", F.floor(F.col("ts") / block_seconds)))
    full = F.when(F.col("record_type") == "response", F.struct("ts", "record_id", "etag", "last_modified", "headers"))
    # the latest response of each (URL, block), carried to later blocks
    order = F.when(F.col("record_type") == "response", F.struct("ts", "record_id"))
    known = slim.where("canonical_url IS NOT NULL AND ts IS NOT NULL")
    per_block = known.groupBy("canonical_url", "block").agg(F.max_by(full, order).alias("latest"))
    carried = per_block.select("canonical_url", "block", F.last("latest", ignorenulls=True).over(Window.partitionBy("canonical_url").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    within = Window.partitionBy("canonical_url", "block").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    inner = F.max_by(full, order).over(within)
    joined = known.withColumn("_inner", inner).where("record_type = 'revisit'").join(carried, ["canonical_url", "block"])
    found = joined.withColumn("f", F.coalesce("_inner", "earlier")).drop("_inner", "earlier")
    lost = slim.where("canonical_url IS NULL OR ts IS NULL").where("record_type = 'revisit'").withColumn("f", F.lit(None).cast(found.schema["f"].dataType))
    found = found.unionByName(lost)
    weak = lambda c: F.regexp_replace(c, "^W/", "")
    outcome = (
        F.when(F.col("f").isNull(), "no response")
        .when(F.col("etag").isNotNull() & F.col("f.etag").isNotNull(), F.when(weak(F.col("etag")) == weak(F.col("f.etag")), "resolved").otherwise("changed"))
        .when(F.col("last_modified").isNotNull() & F.col("f.last_modified").isNotNull(), F.when(F.col("last_modified") >= F.col("f.last_modified"), F.when(F.col("last_modified") == F.col("f.last_modified"), "resolved").otherwise("changed")).otherwise("changed"))
        .otherwise("no validator")
    )
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    own = F.map_filter(F.coalesce("headers", none), lambda k, v: F.lower(k).isin(*PERMITTED))
    named = F.transform(F.map_keys(own), F.lower)
    kept = F.map_filter(F.coalesce("f.headers", none), lambda k, v: ~F.array_contains(named, F.lower(k)))  # header names have no case
    out = found.withColumn("outcome", outcome).withColumn("refers_to", F.when(F.col("outcome") == "resolved", F.col("f.record_id")))
    out = written(out.withColumn("merged_headers", F.when(F.col("outcome") == "resolved", F.map_concat(kept, own))).drop("f", "block"))
    held = captures.where("record_type = 'response'").select(F.col("record_id").alias("_record"), "payload")
    ids = slim.where("record_type = 'response' AND record_id IS NOT NULL").groupBy("record_id").agg(F.count("*").alias("n"))
    if not ids.where("n > 1").isEmpty():
        held = written(held.groupBy("_record").agg(F.min("payload").alias("payload")))
    found = out.where("refers_to IS NOT NULL").join(held, F.col("refers_to") == F.col("_record"), "left").drop("_record")
    return found.unionByName(out.where("refers_to IS NULL").withColumn("payload", F.lit(None).cast(held.schema["payload"].dataType)))


def captures_of(pages: DataFrame) -> DataFrame:
    """The crawl that `pages` stands for: a full response of each page at its place in time, and a later not-modified answer for it.

    Page p is fetched at 10 p. It is asked for again at 10 p + 5 (even p) or 10 p + 50,005 (odd p); every seventh has changed
    meanwhile and answers with another ETag; every fifth has no ETag, but a Last-Modified."""
    p, even = F.col("page_id"), F.col("page_id") % 2 == 0
    tag = F.when(p % 5 != 0, F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16))
    modified = F.when(p % 3 != 0, p * 7)
    text = F.length(F.coalesce("html", F.lit(""))).cast("string")
    heads = lambda date: F.map_from_arrays(F.array(F.lit("content-length"), F.lit("date"), F.lit("server")), F.array(text, date.cast("string"), F.lit("a")))
    asked = p * 10 + F.when(even, F.lit(5)).otherwise(F.lit(50005))
    full = pages.select((p * 2).alias("record_id"), "url", (p * 10).alias("ts"), F.lit("response").alias("record_type"), tag.alias("etag"), modified.alias("last_modified"), heads(p * 10).alias("headers"), F.coalesce("html", F.lit("")).alias("payload"))
    again = pages.select((p * 2 + 1).alias("record_id"), "url", asked.alias("ts"), F.lit("revisit").alias("record_type"), F.when(p % 7 == 0, F.concat(F.lit("W/x"), tag)).otherwise(F.concat(F.lit("W/"), tag)).alias("etag"), modified.alias("last_modified"), heads(asked).alias("headers"), F.lit(None).cast("string").alias("payload"))
    return full.unionByName(again)


def op3_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, canonical_url, outcome, refers_to, n_bytes, date, server) of every revisit of the crawl; n_bytes is its payload's length."""
    out = resolve(captures_of(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    h = F.col("merged_headers")
    return out.select("record_id", "canonical_url", "outcome", "refers_to", F.length("payload").cast("long").alias("n_bytes"), F.element_at(h, F.lit("date")).alias("date"), F.element_at(h, F.lit("server")).alias("server"))


OP3_SQL = r"""
WITH p AS (SELECT page_id AS p, url, coalesce(html, '') AS html FROM pages),
u AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM p),
c AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), ':(80|443)$', ''), '^(www|m)\.', '') AS host,
  regexp_replace(regexp_replace(regexp_replace(regexp_extract(u, '^[^/?]*(.*)$', 1), '([?&])(ref|utm_[a-z]+)=[^&]*', '\1', 'g'), '&&+', '&', 'g'), '[?&]+$', '') AS rest FROM u),
k AS (SELECT p, html, host || regexp_replace(regexp_replace(rest, '\.html?$', ''), '/$', '') AS cu,
  CASE WHEN p % 5 <> 0 THEN substring(md5(html), 1, 16) END AS tag, CASE WHEN p % 3 <> 0 THEN p * 7 END AS lm,
  CASE WHEN p % 2 = 0 THEN p * 10 + 5 ELSE p * 10 + 50005 END AS asked FROM c),
f AS (SELECT cu, p * 10 AS ts, p * 2 AS rid, tag, lm, html FROM k),
j AS (SELECT k.*, f.rid, f.tag AS ftag, f.lm AS flm, f.html AS fhtml FROM k ASOF LEFT JOIN f ON k.cu = f.cu AND k.asked > f.ts),
o AS (SELECT *, CASE WHEN p % 7 = 0 THEN 'x' || tag ELSE tag END AS rtag FROM j),
r AS (SELECT *, CASE WHEN rid IS NULL THEN 'no response' WHEN rtag IS NOT NULL AND ftag IS NOT NULL THEN CASE WHEN rtag = ftag THEN 'resolved' ELSE 'changed' END
  WHEN lm IS NOT NULL AND flm IS NOT NULL THEN CASE WHEN lm = flm THEN 'resolved' ELSE 'changed' END ELSE 'no validator' END AS outcome FROM o)
SELECT p * 2 + 1 AS record_id, cu AS canonical_url, outcome, CASE WHEN outcome = 'resolved' THEN rid END AS refers_to,
  CASE WHEN outcome = 'resolved' THEN CAST(length(fhtml) AS BIGINT) END AS n_bytes, CASE WHEN outcome = 'resolved' THEN CAST(asked AS VARCHAR) END AS date,
  CASE WHEN outcome = 'resolved' THEN 'a' END AS server FROM r
"""

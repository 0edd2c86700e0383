"""Operator 7: resolves WARC revisit records to the latest earlier full response of the same canonical URL.

An as-of join without a range join: records of both kinds are dealt out by
ranges of (canonical URL, time, id), so that one URL with a third of all records
fills many parts, also where times are equal; how many parts there are follows
from the session's number of shuffle partitions, as for any exchange. A window
within (URL, part) finds responses of the same part; the last response of each
(URL, part), a row for each part of a URL, is carried forward to the parts after.

A revisit is `resolved` if its validators agree with the response: ETag by weak
comparison if both have one, else Last-Modified if both have one, else the
payload digest if both have one. Else it is `mismatch`, or `missing` without an
earlier response. A resolved record has the response's headers, with those that
a 304 may update taken from the revisit.

Defined results: records with a null URL or time are never matched; equal times
are ordered by record id, null ids first; a response is no candidate for itself;
repeated records give repeated rows; empty tables give no rows; extra columns
stay, whatever their names; those named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Headers that a 304 response may update, and query keys that name no resource.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"
RESPONSE = ("record_id", "etag", "last_modified", "digest", "headers")


def canonical(url: Column) -> Column:
    """host/path?query: scheme, www, port, fragment, trailing slashes and tracking keys go; query pairs are sorted."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, "^([^/?]*)", 1)), r"^www[.]|:[0-9]*$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, "[?](.*)$", 1)
    pairs = F.array_sort(F.filter(F.split(query, "&"), lambda p: (F.length(p) > 0) & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise(F.lit("")))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def _agree(row: str, found: str) -> Column:
    sides = ((_weak(F.col(f"{row}.etag")), _weak(F.col(f"{found}.etag"))), *((F.col(f"{row}.{c}"), F.col(f"{found}.{c}")) for c in ("last_modified", "digest")))
    out = F.lit(False)
    for a, b in reversed(sides):
        out = F.when(a.isNotNull() & b.isNotNull(), a == b).otherwise(out)
    return out


RESULTS = ("canonical_url", "response_id", "response_ts", "status", "merged_headers")


def resolve(records: DataFrame, parts: int | None = None) -> DataFrame:
    """records: record_id, url, ts (number), kind (response or revisit), etag, last_modified, digest, headers (map, lower-case keys).

    Returns the revisits with canonical_url, response_id, response_ts, status and merged_headers.
    """
    scratch = Scratch(records.sparkSession, "revisits")
    r = records.select(F.struct(*records.columns).alias("row"), canonical(F.col("url")).alias("u"))
    full, revisit = F.col("row.kind") == "response", F.col("row.kind") == "revisit"
    spots = [F.col("u"), F.col("row.ts"), F.col("row.record_id")]
    known = r.filter("u is not null and row.ts is not null")
    dealt = known.repartitionByRange(parts, *spots) if parts else known.repartitionByRange(*spots)
    dealt = scratch.write("dealt", dealt.withColumn("p", F.spark_partition_id()))  # written, so that parts are the same for both uses
    response = F.struct(F.col("row.ts").alias("ts"), *(F.col(f"row.{c}").alias(c) for c in RESPONSE))
    order = Window.partitionBy("u", "p").orderBy("row.ts", "row.record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = dealt.withColumn("near", F.last(F.when(full, response), ignorenulls=True).over(order)).filter(revisit)
    # the last response of each part, carried to those after it
    present = dealt.groupBy("u", "p").agg(F.max_by(F.when(full, response), F.when(full, F.struct("row.ts", "row.record_id"))).alias("last"))
    before = Window.partitionBy("u").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    carried = present.select("u", "p", F.last("last", ignorenulls=True).over(before).alias("before"))
    found = near.join(carried, ["u", "p"], "left").select("row", "u", F.coalesce("near", "before").alias("r"))
    never = r.filter(revisit & (F.col("u").isNull() | F.col("row.ts").isNull())).withColumn("r", F.lit(None).cast(found.schema["r"].dataType))
    out = found.unionByName(never)
    allowed = F.map_filter(F.coalesce("row.headers", F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*PERMITTED))
    base = F.map_filter(F.coalesce("r.headers", F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(F.map_keys(allowed), k))
    status = F.when(F.col("r").isNull(), "missing").when(_agree("row", "r"), "resolved").otherwise("mismatch")
    stay = [F.col(f"row.`{c}`") for c in records.columns if c.lower() not in RESULTS]
    return out.select(
        *stay, F.col("u").alias("canonical_url"), F.col("r.record_id").alias("response_id"), F.col("r.ts").alias("response_ts"), status.alias("status"),
        F.when(status == "resolved", F.map_concat(base, allowed)).alias("merged_headers"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """Records made of pages: a full response for each, and a revisit, whose validators are stale in some and absent in others.

    Revisits of every seventh page come before the page's own response, so that only an older capture can answer them.
    """
    page = F.col("page_id")
    html = F.coalesce("html", F.lit(""))
    tag = F.concat(F.lit('"'), F.left(F.md5(html), F.lit(12)), F.lit('"'))
    modified = F.concat(F.lit("day "), (page % 28).cast("string"))
    digest = F.concat(F.lit("sha256:"), F.sha2(html, 256))
    plain = pages.select(page, "url", tag.alias("tag"), modified.alias("modified"), digest.alias("sum"))
    headers = lambda *kv: F.create_map(*(x for k, v in kv for x in (F.lit(k), v)))
    text = lambda c: c.cast("string")
    full = plain.select(
        (2 * page).alias("record_id"), "page_id", "url", (page * 10).alias("ts"), F.lit("response").alias("kind"), F.col("tag").alias("etag"),
        F.col("modified").alias("last_modified"), F.col("sum").alias("digest"),
        headers(("content-type", F.lit("text/html")), ("date", text(page * 10)), ("etag", F.col("tag")), ("server", F.lit("a"))).alias("headers"),
    )
    stale = F.when(page % 5 == 0, F.lit('"old"')).when(page % 5 == 1, F.lit(None).cast("string")).otherwise(F.concat(F.lit("W/"), F.col("tag")))
    late = F.when(page % 7 == 0, page * 10 - 5).otherwise(page * 10 + 100_003)
    again = plain.select(
        (2 * page + 1).alias("record_id"), "page_id", "url", late.alias("ts"), F.lit("revisit").alias("kind"), stale.alias("etag"),
        F.when(page % 3 == 0, F.lit(None).cast("string")).otherwise(F.col("modified")).alias("last_modified"), F.col("sum").alias("digest"),
        headers(("date", text(late)), ("server", F.lit("b")), ("cache-control", F.lit("max-age=60"))).alias("headers"),
    )
    return full.unionByName(again)

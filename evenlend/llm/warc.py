"""Operator 7: not-modified revisits resolved by an as-of join on the canonical URL.

Records are captures: full responses (status 2xx) and revisits (status 304). A revisit refers to the latest full response
of the same canonical URL with an earlier capture time; of equal times the larger record id is later. Its validators are then
checked in this order: entity tag (weak comparison), last-modified date, payload digest; the first one that the revisit has
decides. If it agrees, the revisit's headers that a 304 may update replace those of the response.

The join is one sort: records are range-partitioned by (URL, time), written once, and each revisit takes the last response
before it within its partition. Where a URL goes on over several partitions, the last response of the earlier ones is
handed over by a table with at most two rows per partition, so a URL with a third of all records is spread like any other.
Payloads never move; ``payloads`` fetches them by record id where they are wanted.

Defined cases: a null or empty URL has no canonical form and its revisits stay unresolved; text that is no absolute URL is
its own canonical form; records without a time resolve nothing and are not resolved; a revisit without any validator, or
with null headers, does not match; repeated rows give one row each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut_lineage, small_side

# Parts of a URL, query arguments that do not name content, and headers that a 304 response may update.
URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?"
TRACKING = r"^(utm_[^=]*|gclid|fbclid)(=|$)"
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
# URLs and headers handed from one partition to the next are broadcast up to this count, and joined by a shuffle beyond it.
HANDED_ROWS = 10_000
FIELDS = ["record_id", "url", "captured_at", "status", "digest", "headers"]


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.``, port if not a default one, path without closing slashes, sorted query without tracking."""
    bare = F.trim(url)
    part = lambda i: F.regexp_extract(bare, URL, i)
    host = F.regexp_replace(F.lower(part(2)), r"^www\.", "")
    port = F.when(part(3).isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), part(3)))
    path = F.regexp_replace(part(4), r"/+$", "")
    named = F.filter(F.split(part(5), "&"), lambda a: (a != "") & ~a.rlike(TRACKING))
    query = F.array_join(F.array_sort(named), "&")
    full = F.concat(host, port, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(bare == "", None).when(part(2) != "", full).otherwise(bare)


def _opaque(tag: Column) -> Column:
    return F.regexp_replace(tag, r"^W/", "")


def latest_responses(records: DataFrame) -> DataFrame:
    """Every revisit with ``canonical_url`` and ``seen``, the latest earlier full response (record_id, digest, headers)."""
    full = F.col("status").between(200, 299) & F.col("captured_at").isNotNull() & F.col("canonical_url").isNotNull()
    rows = records.select(*FIELDS).withColumn("canonical_url", canonical_url(F.col("url")))
    rows = rows.filter(full | (F.col("status") == 304)).withColumn("full", F.coalesce(full, F.lit(False)))
    order = ["canonical_url", "captured_at", "full", "record_id"]  # at equal times a revisit precedes responses
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    rows = cut_lineage(rows).withColumn("pid", F.shiftright("place", 33))
    response = F.when(F.col("full"), F.struct("record_id", "digest", "headers"))

    spans = rows.groupBy("canonical_url").agg(F.min("pid").alias("lo"), F.max("pid").alias("hi")).filter("lo < hi")
    # At most one URL per boundary of partitions; counted before it is broadcast.
    spans = small_side(cut_lineage(spans.select("canonical_url")), HANDED_ROWS)
    parts = rows.join(spans, "canonical_url").groupBy("canonical_url", "pid")
    ends = parts.agg(F.max_by(response, F.when(F.col("full"), F.col("place"))).alias("end"))
    earlier = Window.partitionBy("canonical_url").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    handed = cut_lineage(ends.select("canonical_url", "pid", F.last("end", ignorenulls=True).over(earlier).alias("handed")))

    before = Window.partitionBy("pid", "canonical_url").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("local", F.last(response, ignorenulls=True).over(before)).filter(~F.col("full"))
    joined = local.join(small_side(handed, HANDED_ROWS), ["canonical_url", "pid"], "left")
    seen = F.when(F.col("canonical_url").isNotNull() & F.col("captured_at").isNotNull(), F.coalesce("local", "handed"))
    return joined.select(*FIELDS, "canonical_url", seen.alias("seen"))


def resolve(records: DataFrame, permitted: tuple[str, ...] = PERMITTED) -> DataFrame:
    """Per revisit: ``record_id, canonical_url, captured_at, response_id, outcome, matched_by, headers``.

    ``outcome`` is ``resolved``, ``mismatch`` or ``no_response``; ``headers`` is the merged map if resolved, else the revisit's own.
    """
    low = lambda m: F.map_from_entries(
        F.transform(F.map_entries(m), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    )
    found = latest_responses(records.withColumn("headers", low(F.coalesce("headers", F.create_map().cast("map<string,string>")))))
    own, old = F.col("headers"), F.col("seen.headers")
    tag, date, digest = F.try_element_at(own, F.lit("etag")), F.try_element_at(own, F.lit("last-modified")), F.col("digest")
    checks = [
        ("etag", tag, _opaque(tag) == _opaque(F.try_element_at(old, F.lit("etag")))),
        ("last-modified", date, date == F.try_element_at(old, F.lit("last-modified"))),
        ("digest", digest, digest == F.col("seen.digest")),
    ]
    by, agrees = F.lit(None).cast("string"), F.lit(False)
    for name, value, same in reversed(checks):
        by = F.when(value.isNotNull(), F.lit(name)).otherwise(by)
        agrees = F.when(value.isNotNull(), F.coalesce(same, F.lit(False))).otherwise(agrees)
    outcome = F.when(F.col("seen").isNull(), "no_response").when(agrees, "resolved").otherwise("mismatch")
    rows = found.select("record_id", "canonical_url", "captured_at", "seen", own.alias("own"), outcome.alias("outcome"), by.alias("by"))
    resolved = F.col("outcome") == "resolved"
    update = F.map_filter("own", lambda k, v: k.isin(*permitted))
    kept = F.map_filter("seen.headers", lambda k, v: ~F.map_contains_key(update, k))
    return rows.select(
        "record_id",
        "canonical_url",
        "captured_at",
        F.when(resolved, F.col("seen.record_id")).alias("response_id"),
        "outcome",
        F.when(resolved, F.col("by")).alias("matched_by"),
        F.when(resolved, F.map_concat(kept, update)).otherwise(F.col("own")).alias("headers"),
    )


def payloads(resolved: DataFrame, records: DataFrame, payload: str) -> DataFrame:
    """The resolved revisits with the payload of the response they stand for."""
    bodies = records.select(F.col("record_id").alias("response_id"), F.col(payload))
    return resolved.filter("outcome = 'resolved'").join(bodies, "response_id", "left")

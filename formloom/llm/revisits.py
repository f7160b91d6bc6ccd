"""Resolution of not-modified revisits in web archives.

A revisit record says that a page had not changed since it was fetched before. It is resolved by an as-of join on the
canonical URL to the latest earlier full response; where the validators agree, the result takes the body of that
response and its headers, with those headers of the revisit that a not-modified reply may change laid over them.

The join works on ranges of (url, time), so that a URL with a large share of all records spreads over many tasks: each
range finds the latest earlier response within itself, and one row per range and URL carries it on to later ranges.

Full responses have a status of FULL; revisits have 304; records of any other status take no part. Entity tags are
compared weakly, as for a request that asks whether a page has changed: W/"x" agrees with "x". Header names are compared
in lower case and come out so; where one record has a name in several spellings, the one that sorts last counts. Null
values of a revisit replace nothing.

"Earlier" is by (time, record id). Nulls: records with a null URL or time are never joined and come out as
unresolved. Repeated rows come out each. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formloom.llm.shared import written

#: Statuses of full responses, and headers that a not-modified reply may bring up to date (lower case).
FULL = (200, 203)
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """One form for addresses that serve the same page.

    Without scheme, fragment, default port, leading "www." or "m.", tracking parameters, and a last slash or ".html";
    the host in lower case, the other parameters in order.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"\.html$", ""), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[^=]*|ref|fbclid|gclid)(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def latest_before(records: DataFrame, payload: list[str]) -> DataFrame:
    """Adds `prior`, a struct of the payload columns of the latest earlier full response with the same url.

    records: record_id, url, ts, full boolean and the payload columns.
    """
    order = ["ts", "record_id"]
    known = records.where(F.col("url").isNotNull() & F.col("ts").isNotNull())
    dealt = written(known.repartitionByRange("url", *order).withColumn("part", F.spark_partition_id()), "captures")
    struct = F.when(F.col("full"), F.struct(*payload))
    inside = Window.partitionBy("part", "url").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = dealt.withColumn("own", F.last(struct, ignorenulls=True).over(inside))
    last = dealt.groupBy("part", "url").agg(F.max_by(struct, F.when(F.col("full"), F.struct(*order))).alias("last"))
    over = Window.partitionBy("url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.withColumn("carried", F.last("last", ignorenulls=True).over(over)).where("carried is not null").select("part", "url", "carried")
    joined = found.join(carried, ["part", "url"], "left")
    out = joined.select(*records.columns, F.coalesce("own", "carried").alias("prior"))
    rest = records.where(F.col("url").isNull() | F.col("ts").isNull())
    return out.unionByName(rest.withColumn("prior", F.lit(None).cast(out.schema["prior"].dataType)))


def merged(old: Column, new: Column) -> Column:
    """The headers of a full response with the permitted ones of a revisit laid over them."""
    low = lambda m: F.transform(F.coalesce(F.array_sort(F.map_entries(m)), F.array().cast("array<struct<key:string,value:string>>")), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    fresh = F.filter(low(new), lambda e: e["key"].isin(*PERMITTED) & e["value"].isNotNull())
    both = F.concat(low(old), fresh)
    later = lambda e, i: F.exists(F.slice(both, i + 2, F.size(both)), lambda o: o["key"] == e["key"])
    return F.map_from_entries(F.filter(both, lambda e, i: ~later(e, i)))


def resolve(captures: DataFrame) -> DataFrame:
    """Every revisit of `captures` with what it resolves to.

    captures: record_id, url (any form), ts, status int, etag, last_modified, headers map. Result: record_id, url, outcome (resolved, mismatch or unmatched), response_id and headers.
    """
    tag = F.regexp_replace("etag", "^[Ww]/", "").alias("etag")
    known = captures.where(F.col("status").isin(304, *FULL))
    records = known.select("record_id", canonical_url(F.col("url")).alias("url"), "ts", (F.col("status") != 304).alias("full"), tag, "last_modified", "headers")
    found = latest_before(records, ["record_id", "etag", "last_modified", "headers"]).where(~F.col("full"))
    prior = F.col("prior")
    # an entity tag decides alone; without one on both sides the dates decide
    same = F.when(F.col("etag").isNotNull() & prior["etag"].isNotNull(), F.col("etag") == prior["etag"]).otherwise(F.coalesce(F.col("last_modified") == prior["last_modified"], F.lit(False)))
    outcome = F.when(prior.isNull(), "unmatched").when(same, "resolved").otherwise("mismatch")
    out = found.withColumn("outcome", outcome)
    resolved = F.col("outcome") == "resolved"
    return out.select("record_id", "url", "outcome", F.when(resolved, prior["record_id"]).alias("response_id"), F.when(resolved, merged(prior["headers"], F.col("headers"))).alias("headers"))

"""Resolution of not-modified revisit records of web captures.

A revisit record holds no payload. It is joined, as of its time, to the latest earlier full response of the same
canonical URL; if the validators agree, its headers that may update a stored response are merged into the response's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardstat.frames import materialize

#: Headers of a 304 response that do not update the stored ones (RFC 9111, 3.2, and hop-by-hop fields).
NOT_MERGED = ("connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "etag",
              "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer",
              "transfer-encoding", "upgrade")
#: Query parameters that do not select another page.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid)="


def canonical_url(url: Column) -> Column:
    """Host in lower case without scheme, `www.`, `m.` or default port, path without a final slash or `.html`, query
    parameters sorted and without tracking ones, no fragment; null for null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    place = F.substring_index(bare, "?", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(F.substring_index(place, "/", 1)), "^(www|m)\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(place, "^[^/]*", ""), "/+$", ""), "\\.html?$", "")
    asked = F.when(F.instr(bare, "?") > 0, F.regexp_replace(bare, "^[^?]*\\?", "")).otherwise("")
    kept = F.array_sort(F.filter(F.split(asked, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.concat(host, path, query)


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def latest_before(rows: DataFrame, keys: list[str], order: list[str], given: Column, name: str) -> DataFrame:
    """`rows` with `name`: the last non-null `given` of strictly earlier rows of the same key in the total order `order`.

    Rows are sorted in ranges over (keys, order), so a hot key spans many tasks; each range looks back in itself, and
    beyond that at the last value of the key's earlier ranges.
    """
    ranged = (rows.withColumn("_given", given).repartitionByRange(*keys, *order)
              .withColumn("_range", F.spark_partition_id()))
    ranged = materialize(ranged, "ranges")
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*order)
    ends = (ranged.where("_given is not null").groupBy(*keys, "_range").agg(F.max_by("_given", place).alias("_end")))
    all_ranges = ranged.select(*keys, "_range").distinct()
    carried = (all_ranges.join(ends, [*keys, "_range"], "left")
               .select(*keys, "_range", F.last("_end", ignorenulls=True).over(earlier).alias("_carried")))
    return (ranged.join(carried, [*keys, "_range"])
            .withColumn(name, F.coalesce(F.last("_given", ignorenulls=True).over(inside), "_carried"))
            .drop("_given", "_carried", "_range"))


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit record: record_id, url_key, target_id, state, headers, digest.

    `records`: record_id, url, at (time), kind (`response` with status 200 or `revisit`), digest of the payload, and
    headers (map of lower-case names). The target is the response with the greatest (at, record_id) before the
    revisit's. States: `resolved`; `changed` if digests, entity tags (compared weakly) or, without tags on both sides,
    modification dates differ; `unproven` if no validator is on both sides; `missing` without an earlier response; only
    the first has merged headers, the others keep the revisit's own. A null url, time or record_id cannot be ordered
    and gives `missing`; repeated rows are resolved each.
    """
    rows = records.select("record_id", "at", "kind", "digest", "headers", canonical_url(F.col("url")).alias("url_key"))
    ordered = F.col("url_key").isNotNull() & F.col("at").isNotNull() & F.col("record_id").isNotNull()
    full = F.when(F.col("kind") == "response", F.struct(
        F.col("record_id").alias("id"), F.col("digest").alias("digest"), F.col("headers").alias("headers")))
    found = latest_before(rows.where(ordered), ["url_key"], ["at", "record_id"], full, "target").where("kind = 'revisit'")
    lost = rows.where(~ordered & (F.col("kind") == "revisit"))
    mine, theirs = F.coalesce("headers", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), \
        F.coalesce("target.headers", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))

    def both(a: Column, b: Column) -> Column:
        return F.when(a.isNotNull() & b.isNotNull(), a == b)

    tags = both(_weak(F.element_at(mine, "etag")), _weak(F.element_at(theirs, "etag")))
    dates = both(F.element_at(mine, "last-modified"), F.element_at(theirs, "last-modified"))
    digests = both(F.col("digest"), F.col("target.digest"))
    agrees = F.coalesce(tags, dates)
    state = (F.when(F.col("target").isNull(), "missing")
             .when(~F.coalesce(digests, F.lit(True)) | ~F.coalesce(agrees, F.lit(True)), "changed")
             .when(F.coalesce(agrees, digests).isNull(), "unproven").otherwise("resolved"))
    update = F.map_filter(mine, lambda name, _: ~name.isin(list(NOT_MERGED)))
    merged = F.map_concat(F.map_filter(theirs, lambda name, _: ~F.array_contains(F.map_keys(update), name)), update)
    found = found.withColumn("state", state)
    found = found.select(
        "record_id", "url_key", F.col("target.id").alias("target_id"), "state",
        F.when(F.col("state") == "resolved", merged).otherwise(mine).alias("headers"),
        F.when(F.col("state") == "resolved", F.col("target.digest")).alias("digest"))
    return found.unionByName(lost.select("record_id", "url_key", F.lit(None).alias("target_id"),
                                         F.lit("missing").alias("state"), mine.alias("headers"),
                                         F.lit(None).cast("string").alias("digest")))


def captures(pages: DataFrame) -> DataFrame:
    """Capture records of a table of pages: each page is a full response an hour after the one before it, by page_id,
    and is asked for again at two later times, with validators that sometimes are an older or a weak one or missing."""
    page = pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"))
    hour = F.col("page_id") * 3600

    def headers(*pairs: tuple[str, Column]) -> Column:
        return F.map_filter(F.create_map(*[c for name, value in pairs for c in (F.lit(name), value)]), lambda _, v: v.isNotNull())

    tag = F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"'))
    date = F.concat(F.lit("day "), (F.col("page_id") % 28).cast("string"))
    first = page.select(
        (F.col("page_id") * 3).alias("record_id"), "url", hour.alias("at"), F.lit("response").alias("kind"), "digest",
        headers(("content-type", F.lit("text/html")), ("etag", F.when(F.col("page_id") % 7 != 3, tag)),
                ("last-modified", date), ("cache-control", F.lit("max-age=60")),
                ("date", F.concat(F.lit("at "), hour.cast("string")))).alias("headers"))
    again = page.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
    later = hour + F.col("k") * 1800 + F.when(F.col("k") == 2, F.col("page_id") % 5 * 3600).otherwise(0)
    weak = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("W/"), tag)).otherwise(tag)
    revisit = again.select(
        (F.col("page_id") * 3 + F.col("k")).alias("record_id"), "url", later.alias("at"), F.lit("revisit").alias("kind"),
        F.when(F.col("page_id") % 2 == 0, F.col("digest")).alias("digest"),
        headers(("content-type", F.lit("text/plain")), ("etag", F.when(F.col("page_id") % 11 != 5, weak)),
                ("last-modified", F.when(F.col("page_id") % 13 != 4, date)),
                ("cache-control", F.concat(F.lit("max-age="), F.col("k").cast("string"))), ("content-length", F.lit("0")),
                ("date", F.concat(F.lit("at "), later.cast("string")))).alias("headers"))
    return first.union(revisit)

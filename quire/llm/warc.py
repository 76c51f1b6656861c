"""Resolving not-modified revisits in a capture table.

A revisit says that a URL's content had not changed; its content is that of the
latest earlier full response for the same canonical URL.  The as-of join is
spread so that one URL with a third of all captures is no task of its own:

1. captures are cut into ``slices`` of time at quantiles of all capture times;
2. inside (URL, slice) a window carries the latest full response forward;
3. each (URL, slice) sends its last response to a second window over the
   slices of a URL (at most ``slices`` rows), which gives later slices their
   starting response.

Only ids, times and validators are shuffled; headers and payload join by the
response's id at the end.  Validators are then checked: an entity tag the
revisit names must equal the response's (weak comparison); without one, a
last-modified date must; without either, a payload digest must.  Headers merge
as a cache does on 304: the revisit's permitted headers replace the stored
ones, the rest of the response stays.

Edge cases: null URLs resolve to nothing; of captures at the same time, the
smaller id is earlier, and a response at the revisit's own time counts as
earlier only by that rule; null times come first; a status that is neither
``response`` nor ``revisit`` is ignored; repeated rows of one id count once; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.session import materialize

# Headers a 304 response may update, and URL parameters that
# only track visits.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid)"


def canonical_url(url: Column) -> Column:
    """Scheme and ``www.`` dropped, host in lower case, no fragment, default
    port, tracking parameters, index page or trailing slash; parameters sorted."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    u = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, r"^[^/?]*", 0)), r"^www\.", ""), r":(?:80|443)$", "")
    path = F.regexp_extract(u, r"^[^/?]*([^?]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, r"/index\.html?$", "/"), r"/+$", "")
    query = F.split(F.regexp_extract(u, r"\?(.*)$", 1), "&")
    kept = F.array_sort(F.filter(query, lambda p: (p != "") & ~p.rlike(f"^{TRACKING}(?:=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _tag(etag: Column) -> Column:
    return F.regexp_replace(etag, r"^W/", "")


def merge_headers(stored: Column, sent: Column) -> Column:
    """The stored headers with the permitted ones of a 304 put over them."""
    allowed = F.map_filter(F.coalesce(sent, F.create_map().cast("map<string,string>")),
                           lambda k, v: k.isin(PERMITTED) & v.isNotNull())
    rest = F.map_filter(F.coalesce(stored, F.create_map().cast("map<string,string>")),
                        lambda k, v: ~F.map_contains_key(allowed, k))
    return F.map_concat(rest, allowed)


def _latest(captures: DataFrame, slices: int) -> DataFrame:
    """(id, response id) of every revisit with an earlier full response."""
    edges = captures.agg(F.percentile_approx("time", [i / slices for i in range(1, slices)], 1000)).first()[0] or []
    at = F.aggregate(F.array(*[F.lit(e) for e in sorted(set(edges))]).cast("array<bigint>"), F.lit(0),
                     lambda n, e: n + (F.coalesce(F.col("time"), F.lit(-2**63)) >= e).cast("int"))
    moved = captures.withColumn("slice", at)
    own = F.when(F.col("kind") == "response", F.col("id"))
    inside = W.partitionBy("url", "slice").orderBy(F.asc_nulls_first("time"), "id")
    moved = moved.withColumn("before", F.last(own, True).over(inside.rowsBetween(W.unboundedPreceding, -1)))
    # the last response of each slice, carried to the URL's later slices
    ends = (moved.where("kind = 'response'").groupBy("url", "slice")
            .agg(F.max(F.struct(F.col("time").isNotNull(), "time", "id")).alias("m"))
            .select("url", "slice", F.col("m.id").alias("last")))
    carried = (moved.select("url", "slice").distinct().join(ends, ["url", "slice"], "left")
               .select("url", "slice", F.last("last", True).over(
                   W.partitionBy("url").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)).alias("carried")))
    return (moved.where("kind = 'revisit'").join(carried, ["url", "slice"])
            .select("id", F.coalesce("before", "carried").alias("response_id")).where("response_id is not null"))


def resolve_revisits(captures: DataFrame, slices: int = 64) -> DataFrame:
    """``captures``: id, url, time (long), kind, etag, last_modified, digest,
    headers (map), payload.  One row per revisit: id, canonical_url,
    response_id (null if none precedes), verdict (``resolved``,
    ``changed`` -- a validator differs -- or ``unresolved``), headers, payload."""
    c = captures.select("id", canonical_url(F.col("url")).alias("url"), "time", "kind", "etag", "last_modified",
                        "digest", "headers", "payload")
    slim = (c.where(F.col("url").isNotNull() & F.col("kind").isin("response", "revisit"))
            .select("id", "url", "time", "kind").dropDuplicates(["id"]))
    found = _latest(materialize(slim, "captures"), slices)
    # payloads move once: one copy per response id is kept before the shuffle
    full = (c.where("kind = 'response'").groupBy(F.col("id").alias("response_id"))
            .agg(F.first(F.struct("etag", "last_modified", "digest", "headers", "payload")).alias("full")))
    r = (c.where("kind = 'revisit'").drop("payload", "kind").dropDuplicates(["id"])
         .join(found, "id", "left").join(full, "response_id", "left"))
    same = (F.when(F.col("etag").isNotNull(), _tag(F.col("etag")) == _tag(F.col("full.etag")))
            .when(F.col("last_modified").isNotNull(), F.col("last_modified") == F.col("full.last_modified"))
            .otherwise(F.col("digest") == F.col("full.digest")))
    verdict = (F.when(F.col("response_id").isNull(), "unresolved")
               .when(F.coalesce(same, F.lit(False)), "resolved").otherwise("changed"))
    done = F.col("verdict") == "resolved"
    return (r.withColumn("verdict", verdict)
            .select("id", F.col("url").alias("canonical_url"), "response_id", "verdict",
                    F.when(done, merge_headers(F.col("full.headers"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
                    F.when(done, F.col("full.payload")).alias("payload")))

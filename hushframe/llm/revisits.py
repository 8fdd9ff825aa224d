"""Not-modified revisits resolved to the response they stand for.

A revisit record says that a server answered "not modified". It is joined, by canonical URL and
time, with the latest earlier full response; validators must agree; and headers of the revisit that
a 304 answer may update replace those of the response.

The as-of join runs in two steps: the distinct times of all URLs, in order, are cut into buckets of
about equal size, the latest response before a bucket comes from one row per URL and bucket, the latest
inside it from a window per URL and bucket. So a URL with a third of all records is spread over many
buckets, however its captures crowd in time. Only ids, times and URLs are shuffled for it; bodies are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.plans.materialise import materialise

#: About how many distinct times a bucket holds.
BUCKET = 1 << 18
#: Headers that say how a body is laid out or belong to one connection; a 304 answer doesn't update them.
FIXED_HEADERS = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer",
    "transfer-encoding", "upgrade",
)
#: Query parameters that say where a visitor came from.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host, path and query by which captures of the same page are found.

    Scheme, user, default port, a leading www., fragment, trailing slashes and tracking parameters go,
    the host is lower-cased, the other parameters are sorted. Null stays null.
    """
    rest = F.regexp_replace(F.trim(url), r"#.*$", "")
    rest = F.regexp_replace(rest, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":(80|443)?$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1)
    kept = F.sort_array(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def lower_names(headers: Column) -> Column:
    """Headers with lower-case names; of names that differ in case only, the last by original name counts. Null: none."""
    entries = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    named = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(named, lambda e, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def merged_headers(stored: Column, update: Column) -> Column:
    """The response's headers, updated by those of the revisit that may be. Both have lower-case names."""
    allowed = F.map_filter(update, lambda k, v: ~k.isin(*FIXED_HEADERS) & v.isNotNull())
    kept = F.map_filter(stored, lambda k, v: ~F.map_contains_key(allowed, k))
    return F.map_concat(kept, allowed)


def _weak(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), r"^W/", "")


def validators_agree(stored: Column, update: Column) -> Column:
    """Whether the revisit names the stored body: by entity tag if both have one, else by date; null if neither can tell."""
    tags = F.when(
        stored["etag"].isNotNull() & update["etag"].isNotNull(), _weak(stored["etag"]) == _weak(update["etag"])
    )
    dates = F.when(
        stored["last-modified"].isNotNull() & update["last-modified"].isNotNull(),
        F.trim(stored["last-modified"]) == F.trim(update["last-modified"]),
    )
    return F.coalesce(tags, dates)


def latest_responses(records: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(revisit_id, response_id): the latest full response strictly before each revisit of the same URL.

    `records` has record_id, key (canonical URL), at (microseconds) and full. Of responses at the same
    time the larger id counts. Revisits without an earlier response, URL or time have no row.
    """
    return _answers(records, bucket).select("revisit_id", "response_id")


def _answers(records: DataFrame, bucket: int) -> DataFrame:
    """revisit_id, key and at of each revisit that has a response, and response_id and response_at."""
    events = materialise(records.select("record_id", "key", "at", "full").filter("key is not null and at is not null"), "captures")
    buckets = max(1, -(-events.count() // bucket))
    times = events.groupBy("key", "at").agg(
        F.max(F.when(F.col("full"), F.col("record_id"))).alias("response"), F.max(~F.col("full")).alias("visited")
    )
    times = times.repartitionByRange(buckets, "key", "at").withColumn("bucket", F.spark_partition_id())
    times = materialise(times, "capture-times")
    point = F.when(F.col("response").isNotNull(), F.struct("at", "response"))
    inside = Window.partitionBy("key", "bucket").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = times.groupBy("key", "bucket").agg(F.max(point).alias("top"))
    carried = carried.select("key", "bucket", F.max("top").over(before).alias("carried"))
    asked = times.withColumn("own", F.max(point).over(inside)).filter("visited")
    answers = (
        asked.join(carried, ["key", "bucket"])
        .select("key", "at", F.coalesce("own", "carried").alias("top"))
        .select("key", "at", F.col("top.response").alias("response_id"), F.col("top.at").alias("response_at"))
        .filter("response_id is not null")
    )
    visits = events.filter(~F.col("full")).select(F.col("record_id").alias("revisit_id"), "key", "at")
    return visits.join(answers, ["key", "at"])


def resolve_revisits(records: DataFrame, carry: tuple[str, ...] = (), bucket: int = BUCKET) -> DataFrame:
    """One row per revisit: record_id, url_key, state, response_id, headers, and `carry` of the response.

    `records`: record_id, record_type (response or revisit), url, captured (timestamp), status, headers
    (a map) and the columns of `carry`. Full responses are those of status 200; other records of
    type response stand for nothing. state is resolved, unvalidated (neither side has a validator that
    the other has, too), mismatch or missing (no earlier response, no URL or no time). Headers are merged
    for resolved and unvalidated revisits, and are the revisit's own otherwise; their names are in lower
    case. Of rows that are equal in all columns named here one counts; rows that share a record_id only are
    records each. Of full responses with one id, URL and time the last by headers, then by `carry`, is the
    one that revisits stand for. Rows without an id or type count nowhere.
    """
    entries = F.array_sort(F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>"))))
    known = records.filter("record_id is not null").select(
        "record_id",
        "record_type",
        F.col("url").alias("spelt"),
        canonical_url(F.col("url")).alias("key"),
        F.unix_micros(F.col("captured").cast("timestamp")).alias("at"),
        F.col("status").cast("int").alias("status"),
        lower_names(F.col("headers")).alias("headers"),
        entries.alias("entries"),
        *carry,
    )
    full = (F.col("record_type") == "response") & (F.col("status") == 200)
    revisit = F.col("record_type") == "revisit"
    events = known.filter(full | revisit).select("record_id", "key", "at", F.coalesce(full, F.lit(False)).alias("full"))
    found = _answers(events.distinct(), bucket)
    visits = known.filter(revisit).dropDuplicates(["record_id", "spelt", "at", "status", "entries", *carry])
    visits = visits.select("record_id", "key", "at", F.col("headers").alias("update"))
    last = Window.partitionBy("record_id", "key", "at").orderBy(F.desc("lowered"), *map(F.desc, carry))
    stored = (
        known.filter(full)
        .withColumn("lowered", F.array_sort(F.map_entries("headers")))
        .withColumn("turn", F.row_number().over(last))
        .filter("turn = 1")
        .select(F.col("record_id").alias("response_id"), "key", F.col("at").alias("response_at"), F.col("headers").alias("stored"), *carry)
    )
    answers = found.join(stored, ["response_id", "key", "response_at"])  # inner: revisits without a response would all meet as one null key
    answers = answers.select(F.col("revisit_id").alias("record_id"), "key", "at", "response_id", "stored", *carry)
    joined = visits.join(answers, ["record_id", "key", "at"], "left")
    agree = validators_agree(F.col("stored"), F.col("update"))
    state = (
        F.when(F.col("response_id").isNull(), "missing")
        .when(agree, "resolved")
        .when(agree.isNull(), "unvalidated")
        .otherwise("mismatch")
    )
    use = F.col("state").isin("resolved", "unvalidated")
    return joined.withColumn("state", state).select(
        "record_id",
        F.col("key").alias("url_key"),
        "state",
        F.when(use, F.col("response_id")).alias("response_id"),
        F.when(use, merged_headers(F.col("stored"), F.col("update"))).otherwise(F.col("update")).alias("headers"),
        *[F.when(use, F.col(c)).alias(c) for c in carry],
    )


def captures_of(pages: DataFrame) -> DataFrame:
    """Capture records of a table of pages: each page's full response and a later revisit of its URL.

    Times, tags and headers follow from the page's id and content. Some revisits have a weak tag, a date
    only, no validator at all, or the tag of other content; some come before the response.
    """
    turn = F.pmod(F.crc32(F.coalesce("html", F.lit("")).cast("binary")) + F.col("page_id"), F.lit(12))
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit("")).cast("binary")), F.lit('"'))
    date = F.concat(F.lit("day "), F.col("page_id").cast("string"))
    body = F.coalesce("html", F.lit("")).cast("binary")
    base = pages.filter("page_id is not null").select("page_id", "url", turn.alias("turn"), tag.alias("tag"), date.alias("date"), body.alias("body"))
    response = F.map_from_arrays(
        F.array(*map(F.lit, ("Content-Type", "Content-Length", "Cache-Control", "Last-Modified", "ETag"))),
        F.array(F.lit("text/html"), F.octet_length("body").cast("string"), F.lit("max-age=60"), F.col("date"), F.col("tag")),
    )
    plain = F.create_map(F.lit("Cache-Control"), F.lit("max-age=900"), F.lit("Connection"), F.lit("close"), F.lit("Content-Length"), F.lit("0"))
    validator = (
        F.when(F.col("turn") == 0, F.create_map().cast("map<string,string>"))
        .when(F.col("turn") == 1, F.create_map(F.lit("last-modified"), F.col("date")))
        .when(F.col("turn") == 2, F.create_map(F.lit("ETag"), F.concat(F.lit("W/"), F.col("tag"))))
        .when(F.col("turn") == 3, F.create_map(F.lit("ETag"), F.lit('"other"')))
        .otherwise(F.create_map(F.lit("ETag"), F.col("tag")))
    )
    later = F.when(F.col("turn") == 4, -1).otherwise(F.lit(1) + 500 * F.col("turn"))

    def record(kind: str, number: Column, second: Column, status: int, headers: Column) -> DataFrame:
        return base.select(
            number.alias("record_id"), F.lit(kind).alias("record_type"), "url",
            F.timestamp_seconds(second).alias("captured"), F.lit(status).alias("status"), headers.alias("headers"),
            F.when(F.lit(status == 200), F.sha2("body", 256)).alias("body_sha256"),
            F.when(F.lit(status == 200), F.octet_length("body").cast("long")).alias("body_bytes"),
        )

    at = F.lit(1_600_000_000) + 10 * F.col("page_id")
    return record("response", 2 * F.col("page_id"), at, 200, response).unionByName(
        record("revisit", 2 * F.col("page_id") + 1, at + later, 304, F.map_concat(plain, validator))
    )

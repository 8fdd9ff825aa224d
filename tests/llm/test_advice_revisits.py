"""Records that share an id only are records each."""

from __future__ import annotations

from hushframe.llm import revisits


def test_pages_that_share_an_id(spark):
    rows = [(7, "http://a.com/x", "one"), (7, "http://b.com/y", "two"), (7, "http://b.com/y", "two"), (8, "http://c.com", "three"),
            (9, "http://d.com", "four"), (9, "http://d.com", "five"), (9, "http://d.com", "six")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    records = revisits.captures_of(pages)
    got = revisits.resolve_revisits(records, ("body_sha256", "body_bytes")).collect()
    assert sorted((r.record_id, r.url_key) for r in got) == [
        (15, "a.com/x"), (15, "b.com/y"), (17, "c.com"), (19, "d.com"), (19, "d.com"), (19, "d.com")
    ]
    bodies = {r.url.removeprefix("http://"): r.body_sha256 for r in records.filter("status = 200").collect()}
    for r in got:
        if r.response_id is not None and r.record_id != 19:
            assert r.response_id == r.record_id - 1 and r.body_sha256 == bodies[r.url_key]


def test_last_of_equal_responses_and_all_revisits_count(spark):
    at = "2024-01-01 00:00:0"
    rows = [(1, "response", "a.com", at + "1", 200, {"etag": t}, t) for t in ("p", "q", "o", "q")]
    rows += [(2, "revisit", "a.com", at + s, 304, {"etag": t}, None) for s, t in (("2", "q"), ("2", "q"), ("2", "p"), ("3", "q"), ("0", "q"))]
    rows += [(2, "revisit", "b.com", at + "2", 304, {"etag": "q"}, None), (2, "revisit", None, at + "2", 304, {}, None)]
    rows += [(2, "response", "b.com", at + "1", 200, {"ETag": "q"}, "b"), (1, "response", "b.com", at + "0", 200, {"ETag": "q"}, "z")]
    schema = "record_id long, record_type string, url string, captured string, status int, headers map<string,string>, body string"
    got = revisits.resolve_revisits(spark.createDataFrame(rows, schema).repartition(4), ("body",)).collect()
    assert sorted(((r.record_id, r.url_key, r.state, r.response_id, r.body) for r in got), key=repr) == sorted([
        (2, "a.com", "resolved", 1, "q"), (2, "a.com", "mismatch", None, None), (2, "a.com", "resolved", 1, "q"),
        (2, "a.com", "missing", None, None), (2, "b.com", "resolved", 2, "b"), (2, None, "missing", None, None),
    ], key=repr)

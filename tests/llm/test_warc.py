import random

import pytest

from quillmat.llm import warc

SCHEMA = "record_id long, url string, ts long, status int, headers map<string,string>, found string, _short long"


def captures(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


@pytest.mark.parametrize(
    "url,key",
    [
        ("HTTP://www.Example.com:80/a/index.html?b=2&a=1&utm_source=x#top", "example.com/a?a=1&b=2"),
        ("https://example.com/a/", "example.com/a"), ("example.com", "example.com"), ("https://user@h.org:443/p?ref=1", "h.org/p"), (None, None), ("", ""),
    ],
)
def test_canonical_url(spark, url, key):
    assert spark.createDataFrame([(url,)], "u string").select(warc.canonical_url(warc.F.col("u"))).first()[0] == key


def test_resolution(spark):
    rows = [
        (1, "http://a/x", 100, 200, {"etag": '"1"', "content-type": "text/html", "cache-control": "old"}),
        (2, "https://a/x/", 200, 200, {"etag": '"2"', "last-modified": "then", "content-length": "9"}),
        (3, "http://a/x#f", 150, 304, {"etag": 'W/"1"', "cache-control": "new", "content-length": "0", "x": None}),
        (4, "http://a/x", 300, 304, {"etag": '"1"'}), (5, "http://a/x", 300, 304, {"last-modified": "then"}),
        (6, "http://a/x", 100, 304, {"etag": '"1"'}), (7, None, 400, 304, {"etag": '"1"'}), (8, "http://a/x", None, 304, None),
        (9, "http://a/x", 300, 304, None), (10, "http://a/x", 250, 500, {}), (4, "http://a/x", 300, 304, {"etag": '"1"'}),
    ]
    out = warc.resolve_revisits(captures(spark, rows), buckets=(3600, 60)).collect()
    got = {r.record_id: r for r in out}
    assert len(out) == 8
    assert (got[3].outcome, got[3].source_id) == ("resolved", 1)
    assert got[3].headers == {"etag": 'W/"1"', "content-type": "text/html", "cache-control": "new"}
    assert (got[4].outcome, got[4].source_id) == ("changed", 2)
    assert (got[5].outcome, got[5].source_id, got[5].headers["content-length"]) == ("resolved", 2, "9")
    assert [got[k].outcome for k in (6, 7, 8)] == ["orphan"] * 3
    assert got[9].outcome == "changed"
    assert warc.resolve_revisits(captures(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("buckets", [(7, 7), (100, 7), (10_000, 100)])
def test_as_of_against_brute_force(spark, buckets):
    rng = random.Random(sum(buckets))
    rows = [(i, f"http://h/{rng.choice('aaaab')}", rng.randrange(300), rng.choice([200, 304]), {"etag": '"e"'}) for i in range(300)]
    got = {r.record_id: r.source_id for r in warc.resolve_revisits(captures(spark, rows), buckets=buckets).collect()}
    for i, u, t, status, _ in rows:
        if status == 304:
            earlier = [(ts, k) for k, v, ts, s, _ in rows if s == 200 and v == u and ts < t]
            assert got[i] == (max(earlier)[1] if earlier else None)

"""URL rules and the Bloom filter with its exact join."""

import re

import pytest

from evidloom.llm import urlfilter
from evidloom.llm.urlfilter import Rule, judge_urls

RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]
URLS = [None, "", "no scheme", "http://", "http://NET/", "https://a.example.net/en/x?y#z", "https://example.net/EN/", "http://myexample.com/de/1", "http://www.example.com/de/1.html", "x://a.org#f", "x://b.org/fr/", "http://bad.io/page.html?q=1", "http://m.bad.io/page/", "http://good.io", "a\nb://H.net/\n", "http://a://b.net/"]


def expected(url, listed):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    rule = max(fits, key=lambda r: len(r.text), default=None)
    plain = re.sub(r"^(www|m)\.", "", host) + re.sub(r"/+$", "", re.sub(r"\.html$", "", path))
    return host, path, rule.text if rule else None, rule.verdict if rule else "block" if plain in listed else "allow"


@pytest.mark.parametrize("small", [True, False])
def test_verdicts(spark, monkeypatch, small):
    monkeypatch.setattr(urlfilter, "fits", lambda df: small)
    listed = ["bad.io/page", "other.io/x", None, "", "bad.io/page"] + [f"site{k}.io/p" for k in range(500)]
    pages = spark.createDataFrame([(i, u, "q") for i, u in enumerate(URLS)] + [(0, None, "r"), (None, "http://bad.io/page", None)], "page_id long, url string, u string")
    out = judge_urls(pages, spark.createDataFrame([(x,) for x in listed], "url string"), RULES).collect()
    assert len(out) == len(URLS) + 2
    for r in out:
        url = "http://bad.io/page" if r["page_id"] is None else URLS[r["page_id"]]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == expected(url, set(listed) - {None, ""}), url


def test_list_that_the_url_does_not_tell(spark):
    """The registered query lists pages by id: equal URLs of others are listed, and no word of a URL tells it."""
    from evidloom.llm import queries

    out = queries.QUERIES["op3_url_filters"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url"), "page_id").collect()
    plain = lambda r: re.sub(r"^(www|m)\.", "", r["host"]) + re.sub(r"/+$", "", re.sub(r"\.html$", "", r["path"]))
    listed = {plain(r) for r in out if r["page_id"] % 37 == 5} - {""}
    assert all(r["listed"] == (plain(r) in listed) for r in out)
    assert {r["listed"] for r in out if re.search("casino-win|cheap-pills|free-bets", r["url"] or "")} <= {True, False}
    assert any(r["listed"] and not re.search("casino-win|cheap-pills|free-bets", r["url"] or "") for r in out)


@pytest.mark.parametrize("small", [True, False])
def test_hot_and_very_long_urls(spark, monkeypatch, small):
    monkeypatch.setattr(urlfilter, "fits", lambda df: small)
    long = "http://h.io/" + "p" * 100_000
    rows = [(i, "http://bad.io/x") for i in range(3000)] + [(5000 + i, None) for i in range(500)] + [(9000, long), (9001, long + "?q"), (9002, long + "p")]
    out = judge_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([("bad.io/x",), ("h.io/" + "p" * 100_000,)], "url string"), []).collect()
    assert len(out) == len(rows) and {r["page_id"] for r in out if r["listed"]} == {*range(3000), 9000, 9001}


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.io/b")], "page_id long, url string")
    none = spark.createDataFrame([], "url string")
    assert judge_urls(pages, none, RULES).first()["verdict"] == "allow"
    assert judge_urls(pages.limit(0), none, []).collect() == []


def test_bloom_filter_passes_all_members_and_few_others(spark):
    from pyspark.sql import functions as F

    urls = spark.range(20_000).select(F.concat(F.lit("u"), "id").alias("u"))
    blocks = 10_000 // urlfilter.KEYS_PER_BLOCK
    bloom = urlfilter.bloom_filter(urls.where("substr(u, 2) < '9' and cast(substr(u, 2) as int) < 10000"), "u", blocks)
    keyed = urls.select("u", urlfilter._block(F.xxhash64("u"), blocks), *[m.alias(f"m{i}") for i, m in enumerate(urlfilter._masks(F.col("u")))])
    hit = keyed.join(bloom, "block").where(" and ".join(f"w{i} & m{i} = m{i}" for i in range(urlfilter.WORDS)))
    n = hit.agg(F.count_if(F.expr("cast(substr(u, 2) as int) < 10000 and substr(u, 2) < '9'")).alias("members"), F.count_if(F.expr("cast(substr(u, 2) as int) >= 10000")).alias("others")).first()
    assert n["members"] == urls.where("substr(u, 2) < '9' and cast(substr(u, 2) as int) < 10000").count() and n["others"] < 500

"""Urls that hold a second ``://``."""

from kinweave.llm import url_filter

from .test_scans import listed_domains, plain_verdict


def test_second_scheme(spark):
    urls = ["http://a.com?u=http://b.com/de/x", "http://a.com#http://b.com/de/x", "http://a.com/fr/?u=http://b.com/de/x", "http://a.com/fr/http://b.com/de/x", "x\nhttp://a.com\n?u=a://b.org/", "http://?u=http://b.com/de/x", "http:///a://b.com/de/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r[0]: tuple(r)[1:5] for r in url_filter.filter_urls(pages, listed_domains(spark)).collect()}
    assert got == {i: plain_verdict(u) for i, u in enumerate(urls)}
    assert got[0] == ("a.com", "", None, "allow")

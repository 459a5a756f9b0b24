import re

import pytest

from tallyframe.llm import bloom
from tallyframe.llm.url_filter import filter_urls

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("org", "/fr/", "allow"), ("a.org", "", "block"), ("a.org", "", "allow"), (None, "/", "block")]
URLS = [
    "http://x.NET/", "https://m.example.net/en/5#t", "https://example.net/de/5", "http://example.net?x=/en/", "ftp://org/fr/é?q", "nourl",
    None, "", "http://", "http://a.org", "http://b.a.org/fr/x", "http://notnet/x", "http://listed.com/p/", "https://www.listed.com/p?z#y",
    "http://listed.com/q", "a://b://c/d", "http://net/" + "z" * 9000, "http://" + "s." * 40 + "net/x", "http://x.NET/", "http://..net/",
]
LISTED = ["https://listed.com/p", "http://listed.com/p/", None, "nourl", "http://é.com"]


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")


def canonical(host, path):
    return re.sub(r"^www\.", "", host) + path.rstrip("/")


def judged(url):
    host, path = parts(url)
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in RULES if h and host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[2], max(fits)[3]
    hit = host and canonical(host, path) in {canonical(*parts(u)) for u in LISTED if parts(u)[0]}
    return host, path, None, "block" if hit else "allow"


@pytest.fixture
def frames(table):
    return (
        table("page_id int, url string, host string, key string", *((i, u, "clash", "clash") for i, u in enumerate(URLS))),
        table("host string, path string, verdict string", *RULES),
        table("url string", *((u,) for u in LISTED)),
    )


def rows(frame):
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in frame.collect()}


def test_every_url_is_judged_by_the_definition(frames):
    assert rows(filter_urls(*frames)) == {i: judged(u) for i, u in enumerate(URLS)}


def test_a_full_filter_changes_nothing(frames, monkeypatch):
    monkeypatch.setattr(bloom, "blocks_for", lambda keys: 1)
    assert rows(filter_urls(*frames)) == {i: judged(u) for i, u in enumerate(URLS)}


def test_empty_tables(frames):
    pages, rules, listed = frames
    assert filter_urls(pages.where("false"), rules, listed).count() == 0
    none = rows(filter_urls(pages, rules.where("false"), listed.where("false")))
    assert {v[2:] for v in none.values()} == {(None, "allow")}


def test_no_python_in_the_plan(frames):
    plan = filter_urls(*frames)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

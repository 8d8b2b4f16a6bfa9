import numpy as np
import pytest

from tracewright.llm import url_filter as uf

URLS = [
    None, "", "no scheme", "http://", "http://COM", "http://com/", "https://Example.COM/en/1?q=/x#y", "https://www.example.com/en/1", "http://a.www.example.com/en/", "http://xexample.com/en/", "http://q.net/es/1",
    "http://q.net/ES/1", "http://q.net?u=/es/", "http://net/fr/#a", "http://m.spam-farm.example.org/x", "http://spam-farm.example.org", "http://x.org/a://b", "ftp://ünïcode.net/fr/é", "http://q.net/es/" + "y" * 20000,
]


LISTED = ["spam-farm.example.org", "Casino-Win.example.net", "b.org", None, "", "absent.example"]


def brute(url):
    host, path = uf.host_and_path(url)
    fit = [r for r in uf.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.host + r.path), default=None)
    blocked = any(host == h.lower() or host.endswith("." + h.lower()) for h in LISTED if h)
    return host, path, best and best.host + best.path, best.verdict if best else "block" if blocked else "allow", blocked


@pytest.mark.parametrize("most", [uf.MAX_FILTER_BITS, 0])  # by the cascade, and by the join that serves longer lists
def test_matches_the_rules(spark, monkeypatch, most):
    monkeypatch.setattr(uf, "MAX_FILTER_BITS", most)
    urls = [*URLS, "http://a.b.org/x", "http://xb.org", "http://casino-win.example.net?x"]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls + urls)], "page_id long, url string, host string")
    blocked = spark.createDataFrame([(h,) for h in LISTED], "host string")
    got = {r[0]: tuple(r[1:]) for r in uf.judge(pages, blocked=blocked).collect()}
    assert got == {i: brute(u) for i, u in enumerate(urls + urls)}
    assert uf.judge(pages.where("false"), blocked=blocked).count() == 0
    assert not any(r.listed for r in uf.judge(pages, blocked=blocked.where("false")).collect())
    assert uf.host_and_path("HTTP://Ab.C/x?y") == ("ab.c", "/x") and uf.host_and_path("a://b?c/d") == ("b", "")


def test_cascade_is_exact_on_its_universe(spark, monkeypatch):
    monkeypatch.setattr(uf, "BITS_PER_KEY", 2)  # many false positives, so many levels
    h, g = uf.hashed(str(i) for i in range(4000))
    rows = [(int(a), int(b)) for a, b in zip(h.view(np.int64), g.view(np.int64))]
    levels = uf.build_cascade(spark.createDataFrame(rows, "h long, g long"), spark.createDataFrame(rows[:300], "h long, g long"))
    assert len(levels) > 2
    assert (uf.listed(levels, h, g) == (np.arange(4000) < 300)).all()

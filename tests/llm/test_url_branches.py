"""Branches of a host's tree that differ in their labels are told apart, however rare or deep they are."""

from __future__ import annotations

from stationlens.llm import url_filter


def judged(spark, urls):
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "page_id long, url string")
    labels = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(urls) if b is not None], "page_id long, bad int")
    return {r.url: r for r in url_filter.judge_urls(pages, labels, []).join(pages, "page_id").collect()}


def test_rare_children_that_differ(spark):
    urls = [(f"http://hot.net/{s}/{i}.html", int(s == "spam")) for s in ["spam", *(f"part{c}" for c in "abcdefghijklmnopqrstuvwxyz")] for i in range(40)]
    urls += [(f"http://hot.net/lone{c}/x.html", None) for c in "abc"]
    got = judged(spark, urls)
    assert {r.verdict for u, r in got.items() if "/spam/" in u} == {"block"}
    assert {r.verdict for u, r in got.items() if "/spam/" not in u} == {"allow"}
    assert len({r.template for u, r in got.items() if "/part" in u}) == 1


def test_deep_branches_that_differ(spark):
    head = "http://deep.net/a/b/c/d/e/f/g"
    urls = [(f"{head}/{s}/{i}.html", int(s == "spam")) for s in ("spam", "good") for i in range(40)]
    urls += [("http://long.net/" + "/".join("abcdefghijklmnopqrstuvwxyz"), 0), ("http://long.net/" + "/".join("zyxwvutsrqponmlkjihgfedcba"), 0)]
    got = judged(spark, urls)
    assert {r.verdict for u, r in got.items() if "/spam/" in u} == {"block"}
    assert {r.verdict for u, r in got.items() if "/spam/" not in u} == {"allow"}
    assert all(r.template.endswith("{rest}") for u, r in got.items() if "long" in u)

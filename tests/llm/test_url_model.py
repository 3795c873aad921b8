"""The url models against plain counts, and both ways of scoring against each other."""

import math
import random
import zlib
from collections import Counter

import pytest

from weftmark.llm import url_filter


def plain_scores(urls, accepted):
    """Scores of urls; accepted gives for each url True, False, or None where it teaches nothing."""
    pad = bytes(url_filter.ORDER)
    hits, seen = {True: Counter(), False: Counter()}, {True: Counter(), False: Counter()}
    for url, said in zip(urls, accepted):
        data = pad + (url or "").encode()
        if said is None or zlib.crc32((url or "").encode()) % 5 == 0:
            continue
        for at in range(len(pad), len(data)):
            for order in range(url_filter.ORDER + 1):
                seen[said][data[at - order : at]] += 1
                hits[said][data[at - order : at + 1]] += 1

    def score(url):
        data, total = pad + (url or "").encode(), 0.0
        for at in range(len(pad), len(data)):
            p = {True: 1 / 256, False: 1 / 256}
            for order in range(url_filter.ORDER + 1):
                for said in p:
                    n = seen[said][data[at - order : at]]
                    p[said] = (hits[said][data[at - order : at + 1]] + url_filter.SHRINK * p[said]) / (n + url_filter.SHRINK)
            total += math.log(p[True]) - math.log(p[False])
        return total / max(len(data) - len(pad), 1)

    return [score(url) for url in urls]


@pytest.fixture(scope="module")
def urls():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé/-0") for _ in range(rng.randint(1, 9)))
    known = [f"https://{word()}.{rng.choice(['example.net/en', 'net', 'org/fr', 'com'])}/{word()}" for _ in range(150)]
    return known + known[:3] * 20 + ["", None, "no url", "http://a.org/fr/" + "long/" * 2000]


def test_scores_equal_plain_counts(spark, urls):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rule = {"block": False, "allow": True}
    said = {r.page_id: rule.get(r.verdict) for r in pages.select("page_id", url_filter.by_rule(*url_filter.parts(pages.url))[1].alias("verdict")).collect()}
    expected = plain_scores(urls, [said[i] for i in range(len(urls))])
    held = {r.page_id: r for r in url_filter.filter_urls(pages).collect()}
    joined = {r.page_id: r for r in url_filter.filter_urls(pages, most=10).collect()}
    assert len(held) == len(joined) == len(urls)
    for i, score in enumerate(expected):
        assert held[i].score == pytest.approx(score, abs=1e-9) and joined[i].score == pytest.approx(score, abs=1e-9)
        assert held[i].verdict == joined[i].verdict


def test_a_model_judges_other_urls(spark, urls):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    model = url_filter.train(pages)
    other = pages.where("page_id % 3 = 0")
    own = {r.page_id: r.score for r in url_filter.filter_urls(pages, model=model).collect()}
    for r in url_filter.filter_urls(other, model=model).collect():
        assert r.score == pytest.approx(own[r.page_id], abs=1e-9)
    unseen = spark.createDataFrame([(1, "ftp://§§§/~~~"), (2, None)], "page_id long, url string")
    assert [r.score is not None for r in url_filter.filter_urls(unseen, model=model).collect()] == [True, True]

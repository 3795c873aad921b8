import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftmark.llm import embeddings, html_text, pii, url_filter


def plain_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for said, name, start in url_filter.RULES:
        if (host == name or host.endswith(f".{name}")) and path.startswith(start) and (best is None or len(name + start) > len(best[1] + best[2])):
            best = (said, name, start)
    return host, path, best and best[1] + best[2], best and best[0]


URLS = [None, "", "example.net/en/", "http://", "https://A.Example.NET/en/x?y#z", "http://example.net", "http://example.net?/en/", "http://net/", "http://xnet/", "http://x.net/en/", "ftp://éx.example.com/de/a", "http://a.org/fr/", "http://a.org/FR/", "http://b.example.net/en", "x://y://z/", "http://a.com/\nb"]


def test_url_filter(spark):
    rng = random.Random(4)
    many = [f"http://{rng.choice(['good', 'fine', 'news'])}{i}.example.net/en/{i}" for i in range(200)] + [f"http://{rng.choice(['spam', 'pills', 'casino'])}{i}.net/{i}" for i in range(200)]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS + many + ["http://news77.example.com/en/5", "http://casino.pills.com/9"])], "page_id long, url string, score string")
    rows = {r.page_id: r for r in url_filter.filter_urls(pages).collect()}
    for r in pages.collect():
        host, path, rule, said = plain_rule(r.url)
        got = rows[r.page_id]
        assert (got.host, got.path, got.rule) == (host, path, rule) and got.verdict in ("allow", "block") and (said is None or got.verdict == said)
    assert rows[len(rows) - 2].score > rows[len(rows) - 1].score and rows[len(rows) - 1].verdict == "block"
    assert rows[0].score == 0 and url_filter.filter_urls(pages.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages.where("url LIKE '%news77%'")).collect()} == {"allow"}


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><p>Site header</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><div id="sidebar"><p>About us at some length, in words that go on and on.</p></div>
<article class="post comments-open"><header><h1>The &amp; title</h1></header><p>First   paragraph,<br>with <b>bold</b> &#233; text.<p>Second one<div class="ad">Buy now</div><form><p>Name</p></form>
<ul><li>An item</ul><aside>Aside</aside><script>var a = "<p>no</p>";</script><section class="comments"><p>A reader says</p></section></article><footer>&copy; Site</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "The & title\n\nFirst paragraph, with bold é text.\n\nSecond one\n\nAn item"
    assert [html_text.main_text(x) for x in (None, "", "<p>", "<script>x", "<nav><p>menu</p></nav>")] == ["", "", "", "", ""]


def test_main_text_without_an_article():
    body = "".join(f"<p>{'words of the text ' * 20}{i}</p>" for i in range(6))
    page = f"<body><div><a href=a>One</a><a href=b>Two</a></div><h2>Title</h2>{body}<div><a href=c>Next</a> <a href=d>More</a></div></body>"
    got = html_text.main_text(page)
    assert got.startswith("Title\n\nwords") and got.count("\n\n") == 6 and "Next" not in got


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class=ad>", "</div>", "<article>", "</article>", "text ", "&amp;", "<b", ">", "<!--", "-->", "<br>", "</a>", "<a href='x'>"]), max_size=30))
def test_extraction_never_fails(parts):
    assert isinstance(html_text.main_text("".join(parts)), str)


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "y"), (None, "v", "<article><p>" + "long " * 50_000 + "</p></article>", "z")], "page_id long, url string, html string, text string")
    rows = {r.page_id: r for r in html_text.extract(pages).collect()}
    assert rows[1].n_chars == len(rows[1].text) and rows[2].text == "" and rows[None].n_chars == 249_999
    assert html_text.extract(pages.limit(0)).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def fits(kind, s):
        digits = re.sub(r"[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            return 13 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    return {k: [m.span() for m in re.finditer(p, text) if fits(k, m[0])] for k, p in PATTERNS.items()}


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", "@", "@@", ".", "..", "x.y", " ", "-", "+", "+1", "555", "10.0.0.1", "256", "1.2.3", "4111 1111 1111 1111", "4111-1111", "(", ")", "0", "é", "1.2.3.4.5.6.7.8", "\n", "5"]), max_size=25).map("".join))
def test_rule_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_boosted_trees_learn_a_rule_of_two_features():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) & (x[:, 3] < 0.5)).astype(float)
    model = pii.BoostedTrees().fit(x[:2000], y[:2000])
    assert ((model.predict(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97


def test_pii(spark, documents):
    rng = random.Random(6)
    texts = [f"please call +1 555 {rng.randrange(1000, 9999)} {rng.randrange(100, 999)} or mail me{i}@mail{i}.org about {rng.randrange(10**12)} and 1.2.3.{rng.randrange(400)}" for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = pii.train(docs)
    assert set(model.thresholds) == set(pii.KINDS)
    for r, text in zip(sorted(pii.find(docs, model).collect(), key=lambda r: r.doc_id), texts):
        base = plain_spans(text)
        said = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in base[k])
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and set(said.split(",")) <= set(r.spans.split(","))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(base[k]) for k in pii.KINDS)
    odd = {r.doc_id: r for r in pii.find(documents, model).collect()}
    assert (odd[7].n_email, odd[7].n_ip, odd[7].n_card, odd[7].n_phone) == (1, 1, 1, 1) and odd[2].spans == "" and odd[5].spans == ""
    red = {r.doc_id: r.text for r in pii.redact(documents, model).collect()}
    assert red[7].startswith("write to [email] or [phone]") and red[2] is None
    assert pii.find(documents.limit(0), model).count() == 0 and pii.train(documents.limit(0)).trees is None


def test_spans_taken():
    taken = pii.Taken([(5, 9), (0, 2), (8, 12)])
    assert [taken.meets(*s) for s in ((2, 5), (1, 3), (11, 20), (12, 13))] == [False, True, True, False]
    taken.add(2, 5)
    assert taken.meets(4, 5) and not taken.meets(12, 14)


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(60, 16))
    rows = []
    for i in range(60):
        for k in range(rng.integers(1, 6)):
            rows.append((len(rows), (base[i] + rng.normal(size=16) * 0.12).astype(np.float32).tolist(), int(i % 3)))
    hot = rng.normal(size=16)
    rows += [(len(rows) + k, (hot + rng.normal(size=16) * 0.05).astype(np.float32).tolist(), 1) for k in range(150)]
    rows += [(len(rows) + k, [1.0] + [0.0] * 15, 2) for k in range(40)]  # equal vectors
    n = len(rows)
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [None] + [1.0] * 15]
    rows += [(n + k, v, 1) for k, v in enumerate(odd)] + [(n + 50, rows[0][1], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("x"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(df, block=32).collect()}
    x = np.array([r[1] for r in rows[:n]], dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    labels = np.array([r[2] for r in rows[:n]])
    link = (x @ x.T >= 0.93) & (labels[:, None] == labels)
    np.fill_diagonal(link, False)
    of = np.arange(n)
    while True:
        new = np.array([min(of[i], of[link[i]].min(initial=n)) for i in range(n)])
        if (new == of).all():
            break
        of = new
    found = sum(got[i][0] for i in range(n))
    assert 0.97 * link.sum() <= found <= link.sum()
    assert np.mean([got[i][1] == of[i] for i in range(n)]) > 0.98 and all(got[i][0] <= link[i].sum() for i in range(n))
    assert all(got[i] == (0, i, True) for i in [*range(n, n + len(odd)), n + 50])
    assert embeddings.near_vectors(df.limit(0)).count() == 0

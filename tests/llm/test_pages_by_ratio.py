import numpy as np
import pytest

from weftmark.llm import html_text, pii

STORY = "".join(f"<p>{'words of the story go on ' * 12}{i}</p>" for i in range(4))
ARTICLE = f"<article><h1>T</h1>{STORY}<p>Short.</p></article>"
TEXT = "T\n\n" + "\n\n".join("words of the story go on " * 12 + str(i) for i in range(4))
LISTS = "".join(f'<div><a href="/{i}">Item {i}</a></div>' for i in range(30))

PAGES = {
    "wrapped in a form": (f'<body><form id="aspnetForm"><div><a href=x>Menu</a></div>{ARTICLE}</form></body>', TEXT + "\n\nShort."),
    "a menu left open": (f"<body><nav><a href=a>Home</a>{ARTICLE}</body>", TEXT + "\n\nShort."),
    "a class that says what it has": (f'<body><div class="content has-sidebar">{ARTICLE}</div><div class=sidebar><p>{"long about us " * 30}</p></div></body>', TEXT + "\n\nShort."),
    "a story beside teasers": (f'<body><div class="post"><h1>T</h1>{STORY}</div><article class=card><h3>Tea</h3><p>ser text</p></article><article class=card><p>More</p></article></body>', TEXT),
    "a long block with a doubtful class": (f'<body><article><h1>T</h1><p>{"a b c " * 40}</p><div class="related-work"><p>{"prior work " * 40}</p></div></article></body>', "T\n\n" + ("a b c " * 40).strip() + "\n\n" + ("prior work " * 40).strip()),
    "a short block with a doubtful class": (f'<body><article><h1>T</h1>{STORY}<div class="box-related"><a href=x>Other</a></div></article></body>', TEXT),
    "lists of links": (f"<body><div>{LISTS}</div><div><h1>T</h1>{STORY}</div><div>{LISTS}</div></body>", TEXT),
    "long comments": (f'<body>{ARTICLE}<section class="comments">{"<p>" + "a reader says much " * 15 + "</p>"}</section></body>', TEXT + "\n\nShort."),
    "only a menu": ("<nav><p>menu</p></nav>", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    page, text = PAGES[name]
    assert html_text.main_text(page) == text


def test_without_ratios_the_story_is_not_found(monkeypatch):
    page, text = PAGES["a story beside teasers"]
    teasers = page.replace("More", "More of the same teaser text, on and on")
    assert html_text.main_text(teasers) == text
    monkeypatch.setattr(html_text, "ratios", lambda page: np.ones(len(page.lines)))
    assert html_text.main_text(teasers) != text


def test_ratios_smoothing_and_cut_against_brute_force():
    page = html_text.read(PAGES["lists of links"][0])
    got = html_text.ratios(page)
    plain = [max(0, len(x.text) - x.linked) / max(1, x.tags) for x in page.lines]
    assert np.allclose(got, plain)
    sigma, n = 1.0, len(plain)
    for i, value in enumerate(html_text.smoothed(got, sigma)):
        weights = [np.exp(-((j - i) ** 2) / (2 * sigma**2)) if abs(j - i) <= 3 else 0.0 for j in range(n)]
        assert np.isclose(value, np.dot(weights, plain) / sum(weights))
    rng = np.random.default_rng(2)
    for _ in range(50):
        values = np.concatenate([rng.normal(1, 0.3, rng.integers(2, 30)), rng.normal(9, 1, rng.integers(2, 30))])
        cut = html_text.threshold(values)
        ordered = np.sort(values)
        within = lambda k: ordered[:k].var() * k + ordered[k:].var() * (len(values) - k)
        best = min(range(1, len(values)), key=within)
        assert (values >= cut).sum() == len(values) - best


def test_trees_add_hidden_spans_and_leave_clean_text(spark):
    def valid(n):
        head = f"4{n:014d}"
        return next(head + str(c) for c in range(10) if pii.luhn(head + str(c)))

    texts = [f"the and of +1 ({100 + i}) 555-{1000 + i} to user.{i}@mail{i % 7}.example.com in {i % 250}.{i % 99}.7.{i % 200} or {valid(i * 7919)} no {10**15 + i * 31} end" for i in range(400)]
    model = pii.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert model.thresholds["email"] <= 1 and model.thresholds["ip"] <= 1
    hidden = {
        "the user.9 [at] mail2 [dot] example [dot] com of": [("email", "user.9 [at] mail2 [dot] example [dot] com")],
        "the and 10[.]0[.]0[.]7 of": [("ip", "10[.]0[.]0[.]7")],
    }
    for text, wanted in hidden.items():
        found = model.added(text, pii.base_spans(text))
        assert [(k, text[a:b]) for k, spans in found.items() for a, b in spans] == wanted
    clean = ["look at example.com for more", f"number {10**15 + 31} and 300.400.500.600", "in 2024-01-15 at 10:30 they met", "token = 9f86d081884c7d659a2feaa0c55ad015", "1,234,567.89 and 3.14159265358979", "hello at dawn dot"]
    assert not any(spans for text in clean for spans in model.added(text, pii.base_spans(text)).values())
    rows = spark.createDataFrame(list(enumerate([*hidden, *clean, texts[0]])), "doc_id long, text string")
    assert {r.doc_id: r.n_added for r in pii.find(rows, model).collect()} == {i: int(i < 2) for i in range(9)}

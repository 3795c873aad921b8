import random

import numpy as np
import pytest

from weftmark.llm import language_id, mixing

WORDS = {"en": "the of and to in that is for with was".split(), "de": "der die und das nicht ist von mit auf ein".split(), "fr": "le la les des que est dans pour une sur".split(), "es": "el los por con para una como más pero sus".split()}


def corpus(seed, count, tail=True):
    rng, out = random.Random(seed), []
    for i in range(count):
        lang = rng.choice(sorted(WORDS))
        out.append((i, " ".join(rng.choices(WORDS[lang], k=rng.randrange(3, 60))), lang if tail and i % 11 else None if tail else lang))
    return out


@pytest.fixture(scope="module")
def spoken(spark):
    return spark.createDataFrame(corpus(1, 600, tail=False), "doc_id long, text string, lang string")


def test_codewords_differ_in_many_bits():
    for n in (2, 3, 4, 5, 9, 20):
        codes = language_id.codewords(n)
        least = min((codes[i] != codes[j]).sum() for i in range(n) for j in range(i))
        assert least >= max(1, codes.shape[1] // 4) and len(codes) == n


def test_language_id_on_held_out_documents(spark, spoken, documents):
    model = language_id.train(spoken, per_language=60)
    found = language_id.predict(spoken, model).join(spoken.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 50 and np.mean([r.lang == r.lang_pred for r in found]) >= 0.97
    import zlib

    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in language_id.predict(spoken, model).collect())
    odd = {r.doc_id: r for r in language_id.predict(documents, model).collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 and odd[i].ambiguous for i in (2, 3, 4, 8))
    assert odd[5].lang_pred in WORDS and 0 <= odd[5].score <= 1 and not odd[None].held_out
    assert language_id.predict(documents.limit(0), model).count() == 0


def test_language_id_never_reads_other_columns(spark, spoken):
    model = language_id.train(spoken, per_language=60)
    moved = spoken.selectExpr("doc_id + 1000003 AS doc_id", "text", "'xx' AS lang", "'s' AS score")
    a = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(spoken, model).collect()}
    b = {r.doc_id - 1000003: (r.lang_pred, r.score) for r in language_id.predict(moved, model).collect()}
    assert a == b


def test_language_id_without_or_with_one_language(spark, spoken):
    none = language_id.train(spoken.withColumn("lang", spoken.lang.substr(9, 1)).where("lang <> ''"))
    assert none.languages == [] and {r.lang_pred for r in language_id.predict(spoken.limit(5), none).collect()} == {"und"}
    one = language_id.train(spoken.where("lang = 'de'"))
    assert {r.lang_pred for r in language_id.predict(spoken.limit(5), one).collect()} == {"de"}


def test_one_wrong_bit_does_not_change_the_language():
    codes = language_id.codewords(4)
    model = language_id.LanguageModel(list("abcd"), codes, np.zeros((1, 7)), np.zeros(7), np.ones(7) / 7)
    margins = codes * 5.0
    margins[:, 2] *= -1
    assert model.decode(margins)[0].tolist() == [0, 1, 2, 3]


@pytest.fixture(scope="module")
def labelled(spark):
    rng, docs, labels = random.Random(2), [], []
    for i in range(900):
        kind = rng.choice(["good", "good", "junk", "toxic"])
        words = rng.choices([f"w{k}" for k in range(50)], k=40)
        if kind == "junk":
            words = [w.upper() + "!!" for w in words]
        if kind == "toxic":
            words[rng.randrange(40)] = rng.choice(["vile", "awful"])
        docs.append((i, " ".join(words), 0.5))
        if i % 2:
            labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    labels += [(None, 1, 1), (1, None, 0), (5000, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, rate double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def totals(rows, value):
    p = np.array([r.posterior for r in rows])
    return (p * np.array([[r.tokens * getattr(r, value)] for r in rows], dtype=float)).sum(axis=0)


def test_mixing_meets_its_targets(spark, labelled):
    targets = {"quality1_toxic0": 0.6, "quality0_toxic0": 0.3, "quality1_toxic1": 0.1}
    rows = mixing.mix(*labelled, weights=targets).collect()
    every = sum(r.tokens for r in rows)
    assert every == 900 * 40 and min(r.rate for r in rows) >= 0
    want = np.array([targets[d] for d in sorted(targets)]) * every
    assert np.abs(totals(rows, "rate") - want).max() < 0.01 * every
    assert np.abs(totals(rows, "copies") - want).max() < 0.05 * every
    names = {r.doc_id: r.domain for r in rows}
    truth = {r.doc_id: f"quality{r.quality}_toxic{r.toxic}" for r in labelled[1].collect() if r.doc_id in names and r.quality is not None}
    assert np.mean([names[i] == d for i, d in truth.items()]) > 0.95
    assert all(abs(sum(r.posterior) - 1) < 1e-9 for r in rows)


def test_mixing_by_multiples_and_out_of_reach(spark, labelled):
    rows = mixing.mix(*labelled, multiples={"quality1_toxic1": 0.0}).collect()
    assert all(r.rate < 0.05 for r in rows if max(r.posterior) > 0.99 and r.domain == "quality1_toxic1")
    same = mixing.mix(*labelled, multiples={}).collect()
    assert all(abs(r.rate - 1) < 1e-6 and r.copies == 1 for r in same)


def test_mixing_plan_is_native(spark, labelled, capsys):
    mixing.mix(*labelled).explain("formatted")
    assert "Python" not in capsys.readouterr().out


def test_mixing_of_odd_tables(spark, documents, labelled):
    labels = labelled[1]
    rows = mixing.mix(documents, labels.limit(0)).collect()
    assert {r.domain for r in rows} == {"all"} and len(rows) == documents.count()
    assert mixing.mix(documents.limit(0), labels).count() == 0
    assert mixing.mix(documents, labels).count() == documents.count()

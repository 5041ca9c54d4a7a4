import math
import random

import numpy as np
import pytest

from presswork.llm import languages, queries

WORDS = {"en": "the and of with house garden night friend".split(),
         "de": "der und mit haus garten nacht freund straße".split(),
         "fr": "le et avec maison jardin nuit ami forêt".split()}


def text(rng, lang, count):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(count))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    rows = [(text(rng, lang, 40), lang, 1) for lang in WORDS for _ in range(30)]
    return spark.createDataFrame([*rows, (None, "en", 1), ("xx", None, 1), ("", "fr", 1)],
                                 "text string, lang string, n int")


@pytest.fixture(scope="module")
def model(labelled):
    return languages.train_text_model(labelled)


def plain_model(rows):
    langs = sorted({lang for _, lang in rows if lang is not None})
    counts = np.full((len(langs), languages.BUCKETS), 0.5)
    for t, lang in rows:
        if lang is not None:
            raw = bytearray(f" {(t or '').lower()} ".encode())
            raw = [b if b > 127 or 97 <= b <= 122 else 32 for b in raw]
            for a, b, c in zip(raw, raw[1:], raw[2:]):
                if (a, b) != (32, 32):
                    code = (a | b << 8 | c << 16) * 2654435761 % (1 << 32) >> 18
                    counts[langs.index(lang), code] += 1
    return tuple(langs), np.log(counts / counts.sum(axis=1, keepdims=True))


def plain_identify(records, langs, logs):
    """(text, declared, host, domain, suffix) -> (text_language, language, confidence)."""
    size = len(langs)

    def softmax(s):
        p = np.exp(np.array(s) - max(s))
        return p / p.sum()

    scores = []
    for r in records:
        counts = languages.trigrams(r[0] or "")
        scores.append(languages.TEXT_WEIGHT * (logs.astype(np.float32).astype(float) @ counts))
    own = [softmax(s) for s in scores]
    result = []
    for i, r in enumerate(records):
        def others(level):
            if level is None:
                return sum((own[j] for j in range(len(records)) if j != i), np.zeros(size))
            if r[level] is None:
                return np.zeros(size)
            return sum((own[j] for j in range(len(records)) if j != i and records[j][level] == r[level]),
                       np.zeros(size))

        def smooth(n, above):
            return (n + languages.STRENGTH * above) / (n.sum() + languages.STRENGTH)

        prior = smooth(others(None), np.full(size, 1 / size))
        for level in (3, 2):
            prior = smooth(others(level), prior)
        score = scores[i] + np.log(prior)
        for level in (1, 4):
            if r[level] is not None:
                score = score + np.log((others(level) + 0.1) / (others(None) + 1.0))
        post = softmax(score)
        result.append((langs[int(np.argmax(own[i]))], langs[int(np.argmax(post))], float(post.max())))
    return result


def test_text_model(labelled, model):
    langs, logs = plain_model([(r.text, r.lang) for r in labelled.collect()])
    assert model.languages == langs and np.allclose(model.logs, logs)


def test_trigrams_of_long_texts_come_in_slices(monkeypatch):
    long = "Ab, cd é  x1y " * 50
    whole = languages.trigrams(long)
    monkeypatch.setattr(languages, "_SLICE", 7)
    assert (languages.trigrams(long) == whole).all()


SPEC = "id int, text string, declared string, host string, domain string, suffix string, _x string"


def test_against_brute_force(spark, model):
    rng, records = random.Random(2), []
    for i in range(80):
        lang = rng.choice(list(WORDS))
        host = rng.choice([None, f"a.{lang}.org", f"{lang}.org", "big.com", "big.com"])
        records.append((
            rng.choice([None, "", text(rng, lang, 1), text(rng, lang, 30)]), rng.choice([None, lang, "xx"]),
            host, host and host.split(".", host.count(".") - 1)[-1], host and host.split(".")[-1]))
    df = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(records)], SPEC)
    got = languages.identify(df, model)
    assert got.columns == ["id", "declared", "host", "domain", "suffix", "_x", "text_language", "language", "confidence"]
    want = plain_identify(records, model.languages, model.logs)
    for r in got.collect():
        assert (r.text_language, r.language) == want[r.id][:2]
        assert math.isclose(r.confidence, want[r.id][2], rel_tol=1e-9)


def test_address_decides_where_the_text_does_not(spark, model):
    rng = random.Random(3)
    rows = [(i, text(rng, "de", 30), "de", "h.de", "h.de", "de", "") for i in range(20)]
    rows += [(100 + i, text(rng, "en", 30), "en", "e.com", "e.com", "com", "") for i in range(30)]
    rows += [(200, "", None, "h.de", "h.de", "de", ""), (201, None, "de", None, None, None, "")]
    got = {r.id: r.language for r in languages.identify(spark.createDataFrame(rows, SPEC), model).collect()}
    assert got[200] == got[201] == "de" and got[100] == "en"


def test_suffix_counts_once(spark, model):
    """Of two records without a text, one on an unseen host, the suffix is evidence but no prior."""
    rng = random.Random(4)
    rows = [(i, text(rng, "de", 30), None, f"h{i}.x", f"h{i}.x", "x", "") for i in range(12)]
    rows += [(100 + i, text(rng, "en", 30), None, f"e{i}.y", f"e{i}.y", "y", "") for i in range(60)]
    rows += [(200, "", None, "new.x", "new.x", "x", "")]
    got = {r.id: r for r in languages.identify(spark.createDataFrame(rows, SPEC), model).collect()}
    own = np.array([12 + 1 / 3, 60 + 1 / 3, 1 / 3])  # de, en, fr; about, as the texts are clear
    prior = (np.array([12.0, 60, 0]) + languages.STRENGTH / 3) / (72 + languages.STRENGTH)
    post = prior * (np.array([12.0, 0, 0]) + 0.1) / (np.array([12.0, 60, 0]) + 1)
    assert got[200].language == "de"
    assert got[200].confidence == pytest.approx(post[0] / post.sum(), abs=0.02) and len(own) == 3


def test_columns_of_any_name_stay(spark, model):
    names = ("scores", "own", "prior", "post", "of_all", "of_host", "key", "row", "_text", "_key", "language")
    spec = ", ".join(["text string", "declared string", "host string", "domain string", "suffix string",
                      *(f"{n} string" for n in names)])
    df = spark.createDataFrame([("der garten und haus", None, "h.de", "h.de", "de", *names)], spec)
    for found in (model, languages.TextModel((), np.zeros((0, languages.BUCKETS)))):
        row, = languages.identify(df, found).collect()
        assert all(row[n] == n for n in names if n != "language")
        assert row.__fields__[-3:] == ["text_language", "language", "confidence"]
        assert row.language == ("de" if found is model else None)


def test_too_many_languages_are_an_error(spark):
    df = spark.createDataFrame([("a", f"l{i}") for i in range(6)], "text string, lang string")
    with pytest.raises(ValueError, match="more than 5 languages"):
        languages.train_text_model(df, most=5)
    assert len(languages.train_text_model(df, most=6).languages) == 6


def test_empty_tables_and_no_model(spark, labelled):
    nothing = languages.train_text_model(labelled.limit(0))
    rows = spark.createDataFrame([(1, "a", None, None, None, None, "")], SPEC)
    assert [tuple(r)[-3:] for r in languages.identify(rows, nothing).collect()] == [(None, None, None)]
    assert languages.identify(rows.limit(0), languages.train_text_model(labelled)).collect() == []


def test_page_records(spark):
    rows = [(1, "https://u@M.Big.example.org:80/x?y", '<!DOCTYPE html>\n<HTML dir="ltr" LANG = "De-AT"><style>no</style>'
             "<p class=x>Ja&nbsp;gut<script>var</script></p><!-- <b> --></html>"),
            (2, None, None), (3, "nonsense", "lang=fr plain"), (4, "http://host/", "<html lang=>x")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id int, url string, html string, text string")
    got = {r.page_id: r for r in languages.page_records(df).collect()}
    assert (got[1].declared, got[1].host, got[1].domain, got[1].suffix) == (
        "de", "m.big.example.org", "example.org", "org")
    assert got[1].text.split() == ["Ja", "gut"]
    assert got[2][1:] == (None,) * 5
    assert got[3].host is None and got[3].declared is None and got[3].text == "lang=fr plain"
    assert (got[4].host, got[4].domain, got[4].suffix, got[4].declared) == ("host",) * 3 + (None,)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = queries.QUERIES["op1_language_id"](spark, folder).collect()
    known = [r.language == truth[r.doc_id] for r in got if r.held_out]
    assert len(known) > 200 and sum(known) / len(known) > 0.97
    pages = [r for r in got if r.page_id is not None]
    assert len(pages) == 250 and len(got) == 1250
    agree = [r.language == r.declared for r in pages if r.declared]
    assert sum(agree) / len(agree) > 0.8

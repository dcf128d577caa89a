"""Byte-pair coding, URLs and languages."""

import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import corpus, documents, odd_texts
from trackforge.llm import bpe, langid, url_filter
from trackforge.llm.queries import URL_POLICY

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_are_those_of_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    library.no_padding()
    library.no_truncation()
    rng = random.Random(1)
    letters = "ab cdE'éß漢字 \n\t  123,.<|endoftext|>'s 'll🙂\x1c\r\n"
    texts = odd_texts() + corpus(3, 5) + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["x<|endoftext|><|endoftext|> y", "  two  spaces \n\n"]
    found = {r.doc_id: r for r in bpe.encode_documents(documents(spark, list(enumerate(texts))), PATH, public_tokenizers.PATTERN, keep_ids=True).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(found[i].ids, "<u4").tolist() == ids, text
        assert found[i].n_tokens == len(ids)
        assert found[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_memory_of_pieces_is_bounded(monkeypatch):
    coder = bpe.BytePairCodec(PATH, public_tokenizers.PATTERN)
    wanted = coder.encode("one two three four five six one two")
    monkeypatch.setattr(bpe, "REMEMBERED", 2)
    coder.known.clear()
    assert coder.encode("one two three four five six one two") == wanted and len(coder.known) <= 2


def test_rules_and_parts_of_urls(spark):
    cases = {
        "http://WWW.Example.ORG/es/1?x": ("www.example.org", "/es/1", "example.org/es/", "block"),
        "https://example.org/en/123#a": ("example.org", "/en/123", "example.org/en/1", "block"),
        "https://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "http://a.com/de/x": ("a.com", "/de/x", "com/de/", "block"),
        "http://a.com/fr/x": ("a.com", "/fr/x", "com/fr/", "allow"),
        "http://notexample.org": ("notexample.org", "", None, "allow"),
        "http://a.net/adult-casino/": ("a.net", "/adult-casino/", None, "block"),
        "http://a.net/adult/adult": ("a.net", "/adult/adult", None, "allow"),
        "http://a.net/xxx": ("a.net", "/xxx", None, "block"),
        "http://a.net/xxxl-sussex": ("a.net", "/xxxl-sussex", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "ftp://h?q/p": ("h", "", None, "allow"),
    }
    rows = list(enumerate(cases))
    pages = spark.createDataFrame([(i, u, None, "clash") for i, u in rows], "page_id long, url string, html string, rule string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, URL_POLICY).collect()}
    assert [found[i] for i, _ in rows] == list(cases.values())
    assert url_filter.judge_urls(pages.limit(0), URL_POLICY).count() == 0


LANGUAGES = {"xa": "tha eron ingen tion wher", "xb": "leau oière çette ouaux", "xc": "schung über keit"}


def labelled(spark, n=60):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(LANGUAGES[k].split()) for _ in range(20)), k) for i, k in enumerate(list(LANGUAGES) * n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_languages_of_unseen_texts(spark):
    docs = labelled(spark)
    model = langid.train(docs.where("doc_id % 2 = 0"), public_tokenizers.path("piece_bpe_32k.model"))
    found = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("doc_id % 2 = 1")
    assert found.where("lang_pred = lang").count() == found.count() > 0
    odd = {r.doc_id: r for r in langid.predict(documents(spark, list(enumerate(odd_texts()))), model).collect()}
    assert [odd[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in odd.values())
    assert langid.predict(docs, None).where("lang_pred <> 'und' or score <> 0").count() == 0
    kept = langid.keep_identified(documents(spark, [(1, "12 34"), (2, "tha eron"), (3, None)]), model)
    assert [r.doc_id for r in kept.collect()] == [2] and kept.columns == documents(spark, []).columns


def test_words_sum_over_all_segmentations():
    pieces = [bytes([b]) for b in range(256)] + [b"ab", b"abc", b"bc"]
    index = langid.PieceIndex(pieces)
    p = np.random.default_rng(0).random((len(pieces) + 1, 2))
    p[-1] = 0
    model = langid.LanguageModel(["a", "b"], np.zeros(2), p, index)
    of = {x: i for i, x in enumerate(pieces)}

    def total(word, k):
        return 1.0 if not word else sum(p[of[word[:n]], k] * total(word[n:], k) for n in range(1, min(3, len(word)) + 1) if word[:n] in of)

    for word in (b"abcab", b"zzz", b"a", b"abcabcabcabc"):
        found = model.log_likelihood(np.frombuffer(word, np.uint8)[None])
        assert np.allclose(found[0], [np.log(total(word, k)) for k in (0, 1)])


def test_long_words_as_short_ones(monkeypatch):
    rng = np.random.default_rng(5)
    pieces = langid.piece_list(public_tokenizers.path("piece_bpe_32k.model"))
    chances = np.append(rng.random((len(pieces), 3)) / len(pieces), np.zeros((1, 3)), axis=0)
    model = langid.LanguageModel(["a", "b", "c"], np.zeros(3), chances, langid.PieceIndex(pieces))
    monkeypatch.setattr(langid, "SEGMENT", 100)
    for n in (1, 7, 16, 17, 257, 700):
        word = rng.choice(np.frombuffer(b" thanderingonionest\xc3\xa9", np.uint8), n)
        assert np.allclose(model.long_log_likelihood(word), model.log_likelihood(word[None])[0], atol=1e-9)
    monkeypatch.undo()
    began = time.time()
    assert np.isfinite(model.long_log_likelihood(rng.choice(np.frombuffer(b"ethanol", np.uint8), 1 << 20))).all()
    assert time.time() - began < 60  # a few seconds on a free machine


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 2)
    docs = spark.createDataFrame([(i, "a text", f"l{i}") for i in range(3)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        langid.train(docs, public_tokenizers.path("piece_bpe_32k.model"))


def test_long_words_and_rare_languages_are_learned(spark):
    rng = random.Random(9)
    one_word = lambda letters, n=40: "".join(rng.choice(letters) for _ in range(n))
    letters = {"c1": "的一是不了人我在有他", "c2": "のにはをたがでてとし", "c3": "가나다라마바사아자차"}
    rows = [(i, one_word(letters[k]), k) for i, k in enumerate(["c1"] * 200 + ["c2"] * 100 + ["c3"] * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.train(docs, public_tokenizers.path("piece_bpe_32k.model"), sample_rows=10)
    assert model.languages == ["c1", "c2", "c3"]
    assert np.allclose(np.exp(model.log_prior), np.array([200, 100, 2]) / 302)
    new = spark.createDataFrame([(i, one_word(letters[f"c{i % 3 + 1}"])) for i in range(30)], "doc_id long, text string")
    assert all(r.lang_pred == f"c{r.doc_id % 3 + 1}" for r in langid.predict(new, model).collect())
    assert [b"".join(langid.parts(w)) for w in (b"", b"a" * 99, "é漢".encode() * 30)] == [b"", b"a" * 99, "é漢".encode() * 30]
    assert all(len(p) <= langid.PART and p.decode() for p in langid.parts("é漢".encode() * 30))


def plain_counts(model, words, weights):
    """Expected uses of each piece over all segmentations of all words."""
    of = {x: i for i, x in enumerate(model.index.pieces)}
    out = np.zeros((len(of) + 1, len(model.languages)))

    def ways(word):
        return [[]] if not word else [[of[word[:n]], *rest] for n in range(1, len(word) + 1) if word[:n] in of for rest in ways(word[n:])]

    for word, w in zip(words, weights, strict=True):
        all_ways = ways(word)
        chances = np.array([model.probabilities[way].prod(0) for way in all_ways])
        for way, share in zip(all_ways, chances / chances.sum(0), strict=True):
            for piece in way:
                out[piece] += share * w
    return out


def test_expected_counts_against_all_segmentations(spark):
    pieces = [bytes([b]) for b in range(256)] + sorted([b" a", b"ab", b"abc", b"bc", b" ab", b"cab"])
    counts = {"abcab": (3, 1), "a": (2, 0), "bcb": (0, 5), "cabab": (1, 1)}
    rows = [(lang, word, n) for word, ns in counts.items() for lang, n in zip("xy", ns, strict=True) if n]
    found = langid.fit(spark.createDataFrame(rows, "lang string, word string, n long").repartition(3), {"x": 4, "y": 2}, pieces)
    plain = langid.first_model({"x": 4, "y": 2}, pieces)
    for _ in range(langid.ROUNDS):
        plain = langid.refitted(plain, plain_counts(plain, [b" " + w.encode() for w in counts], np.array(list(counts.values()), float)))
    assert np.allclose(found.probabilities, plain.probabilities) and np.allclose(np.exp(found.log_prior), [4 / 6, 2 / 6])


def test_training_rows_with_odd_columns(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = [(1, "THA eron", "a"), (1, "THA eron", "a"), (2, "leau", "b"), (None, "x", "c"), (4, None, "c"), (5, "", "d"), (6, "no label", None)]
    docs = spark.createDataFrame([(*r, 1, "w", 2) for r in rows], "doc_id long, text string, lang string, i int, word string, n int")
    model = langid.train(docs, path)
    assert model.languages == ["a", "b", "d"] and np.allclose(np.exp(model.log_prior), [0.5, 0.25, 0.25])
    assert langid.train(docs.limit(0), path) is None and langid.train(docs.where("lang is null"), path) is None
    kept = langid.keep_identified(docs, None)
    assert sorted(r.text for r in kept.collect()) == ["THA eron", "THA eron", "leau", "no label", "x"] and kept.columns == docs.columns


def test_capitals_of_any_alphabet_count_alike_in_training_and_scoring(spark):
    docs = spark.createDataFrame([(i, "ÉÀÇ ÔÎ" if i % 2 else "éàç ôî", "up" if i % 2 else "low") for i in range(40)], "doc_id long, text string, lang string")
    model = langid.train(docs, public_tokenizers.path("piece_bpe_32k.model"))
    assert langid.predict(docs, model).join(docs, "doc_id").where("lang_pred <> lang").count() == 0


@pytest.mark.parametrize(
    "url, verdict, strict, soft, weight",
    [
        ("http://casino-win.net/a", "block", 0, 2, 3),
        ("http://free-bets.biz/x", "block", 0, 2, 3),
        ("http://ads-track.info/", "block", 0, 2, 3),
        ("http://spam-farm.xyz/1", "block", 0, 2, 3),
        ("http://cheap-pills.shop/", "block", 0, 2, 3),
        ("http://a.net/XXX/", "block", 1, 0, 3),
        ("http://a.net/sex-and-nude-sex", "block", 0, 2, 4),
        ("http://a.net/free/cheap", "allow", 0, 2, 2),
        ("http://essex.net/analysis/casinos1", "allow", 0, 0, 0),
        ("http://a.net/éporné", "block", 1, 0, 3),
        ("http://a.net/casino/" + "x" * 5000, "allow", 0, 1, 2),
        (None, "allow", 0, 0, 0),
    ],
)
def test_weights_of_url_terms(url, verdict, strict, soft, weight):
    policy = url_filter.UrlPolicy(())
    assert url_filter.vocabulary_verdict(url, url_filter.automaton(policy), policy.blocked_weight) == (verdict, strict, soft, weight)


def test_url_terms_in_code_and_sql(spark, tmp_path):
    import duckdb

    from trackforge.llm import oracles

    rng = random.Random(4)
    words = ["casino", "win", "PORN", "Sex", "free", "essex", "é", "a1", "bets", "x", "org", "plain"]
    urls = ["http://" + "".join(rng.choice(words) + rng.choice("-./_é9%") for _ in range(rng.randint(1, 6))) for _ in range(300)] + [None, "", "no scheme casino win"]
    rows = [(i % 250, u) for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    found = sorted((tuple(r) for r in url_filter.judge_urls(pages, URL_POLICY).collect()), key=repr)
    pages.toPandas().to_parquet(f"{tmp_path}/pages.parquet")
    base = duckdb.connect()
    base.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    columns = ", ".join(url_filter.judge_urls(pages, URL_POLICY).columns)
    assert found == sorted((tuple(r) for r in base.execute(f"SELECT {columns} FROM ({oracles.URL_FILTER})").fetchall()), key=repr)

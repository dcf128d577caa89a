"""Each stage of the pipeline on a small fixture, and the run as a whole against a plain version of it."""

from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.helpers import WORDS
from tests.llm.test_similarity import brute, linked
from tests.llm.test_substrings import words_left

DATA = Path("/root/testdata/sf0.001")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def fixture(tmp_path, spark):
    words = {"xa": "tha eron ingen tion wher and of", "xb": "leau oiere cette ouaux le la"}
    passage = " ".join(f"shared{i}" for i in range(50))
    item = " ".join(f"bench{i}" for i in range(20))
    rows = []
    for i in range(40):
        k = "xa" if i % 2 else "xb"
        body = " ".join(f"{w}{(i * 31 + j * 7) % 211}" for j, w in enumerate(words[k].split() * 12))
        rows.append((i, body, k, "s", len(body)))
    rows += [(50, rows[3][1], "xa", "s", 1), (51, rows[4][1] + " tail", "xb", "s", 1), (52, "1 2 3", "xa", "s", 5), (53, None, "xa", "s", 0)]
    rows += [(54, rows[5][1] + " " + passage, "xa", "s", 1), (55, rows[7][1][:200] + " " + passage + " x", "xa", "s", 1), (56, rows[9][1][:150] + " " + item, "xa", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows, [(1, item)]


def test_run_against_a_plain_version(spark, tmp_path):
    rows, items = fixture(tmp_path, spark)
    kept = [(r[0], r[1]) for r in rows if r[0] not in (52, 53)]
    first = {}
    for i, _, c in linked(kept, 5, 80):
        first[c] = min(i, first.get(c, i))
    kept = [(i, t) for i, t in kept if i in set(first.values())]
    gone = {i: n for i, _, n, _ in words_left(kept, 35)}
    texts = {}
    lists = {i: WORDS.findall(t) for i, t in kept}
    seen = {}
    for w in lists.values():
        for k in range(len(w) - 34):
            seen[tuple(w[k : k + 35])] = seen.get(tuple(w[k : k + 35]), 0) + 1
    for i, t in kept:
        w, mark = lists[i], [False] * len(lists[i])
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                mark[k : k + 35] = [True] * 35
        assert sum(mark) == gone[i]
        texts[i] = t if not gone[i] else " ".join(x for x, m in zip(w, mark, strict=True) if not m)
    bad = {i for i, _ in brute(list(texts.items()), items)}
    assert 56 in bad and gone[54] >= 50
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_padding()
    library.no_truncation()
    wanted = {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items() if i not in bad}
    found = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert found == wanted


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_stages_keep_the_columns(spark, tmp_path):
    docs, n = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(DATA)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        n.append(docs.count())
        assert docs.columns == COLUMNS or name == corpus_pipeline.STAGES[-1][0]
    assert n == sorted(n, reverse=True) and n[-1] > 0


def test_empty_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_rows_and_null_ids(spark, tmp_path):
    text = lambda k: " ".join(f"word{k}x{j}" for j in range(45))
    near = lambda k: text(k) + " tail"
    rows = [(1, text(1)), (1, text(1)), (2, text(2)), (2, near(1)), (3, text(3)), (None, text(4)), (None, text(4)), (None, near(4)), (None, text(5)), (4, near(3)), (6, ""), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", len(t)) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = [(r.doc_id, r.text, r.source) for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()]
    fourth = [t for i, t, _ in kept if i is None and t != text(5)]
    assert len(fourth) == 1 and fourth[0] in (text(4), near(4))
    wanted = [(1, text(1)), (2, text(2)), (3, text(3)), (None, fourth[0]), (None, text(5)), (6, ""), (6, "")]
    assert sorted((k[:2] for k in kept), key=repr) == sorted(wanted, key=repr)
    assert next(s for i, _, s in kept if i == 1) == "s0"
    left = corpus_pipeline.drop_repeated_passages(spark, spark.createDataFrame(kept, "doc_id long, text string, source string").selectExpr("doc_id", "text", "'en' lang", "source", "0L n_chars"), str(tmp_path))
    assert {(r.doc_id, r.text) for r in left.collect()} == set(wanted)


def test_clashing_names_and_no_labels(spark, tmp_path):
    names = ["doc_id", "text", "lang", "i", "kept", "n_words", "n_removed", "place", "total", "part", "row", "n", "component_id", "word", "blob", "bucket", "_id", "_copy", "first"]
    passage = " ".join(f"p{k}" for k in range(40))
    filler = lambda k: " ".join(f"{k}w{j}" for j in range(30))
    texts = [filler("a"), f"{filler('b')} {passage} three", f"four {passage} {filler('c')}", "12 34"]
    kinds = ", ".join(f"`{c}` {'long' if c == 'doc_id' else 'string'}" for c in names)
    docs = spark.createDataFrame([(k, t, None, *(f"{c}{k}" for c in names[3:])) for k, t in enumerate(texts)], kinds)
    spark.createDataFrame([(1, "nothing of this is there at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == names
        left = spark.createDataFrame(left.toArrow(), left.schema)
    assert {r.doc_id: r.text for r in left.collect()} == {0: texts[0], 1: f"{filler('b')} three", 2: f"four {filler('c')}"}
    assert [(r.doc_id, c, r[c]) for r in left.collect() for c in names[3:] if r[c] != f"{c}{r.doc_id}"] == []
    assert corpus_pipeline.encode(spark, left, str(tmp_path)).count() == 3

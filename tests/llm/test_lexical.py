"""Ranked lexical search against a plain version, and the arithmetic on bitmaps."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import corpus, documents, lower, odd_texts
from trackforge.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, items, k=20):
    docs = [(i, Counter(TERM.findall(lower(t or "")))) for i, t in rows]
    total, length = sum(1 for _, c in docs if c), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in docs:
            m = 100 - 25 + 25 * sum(c.values()) * total // length if c else 0
            score = 0
            for t in TERM.findall(lower(text or "")):
                if t in c:
                    w = math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                found.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1] is None, x[1] or 0))[:k], 1)]
    return sorted(out, key=repr)


def tables(spark, rows, items):
    return documents(spark, rows).repartition(3), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block", [5, 64, 4096])
def test_against_a_plain_version(spark, monkeypatch, block):
    monkeypatch.setattr(lexical, "BLOCK", block)
    rng = random.Random(block)
    texts = corpus(6, 90) + odd_texts() + ["É é a-b_c 1 1 1", "a\x00b\x7fc `d` [e] {f}"]
    rows = list(enumerate(texts + texts[:25]))
    rng.shuffle(rows)
    items = [(k, " ".join(rng.choices([w for t in texts if t for w in t.split()], k=rng.randint(1, 40)))) for k in range(12)]
    items += [(90, None), (91, "nothing-of-it"), (92, "the A-b 1 1 1 é É"), (93, ""), (94, "tie"), (95, "tie tie tie " * 40)]
    docs, queries = tables(spark, rows, items)
    found = lexical.rank(docs, queries)
    assert sorted(map(tuple, found.collect()), key=repr) == plain(rows, items)


def test_ties_repeats_and_null_ids(spark):
    rows = [(None, "x y"), *((i % 31, "x y") for i in range(62)), (None, "x y x"), (5, None)]
    docs, queries = tables(spark, rows, [(1, "X"), (1, "X"), (None, "y")])
    for k in (1, 3, 20, 100):
        assert sorted(map(tuple, lexical.rank(docs, queries, k).collect()), key=repr) == plain(rows, [(1, "X"), (None, "y")], k)


def test_nothing(spark):
    some, none = [(1, "a b")], []
    for rows, items in ((some, none), (none, some), (none, none), ([(1, None)], some)):
        assert lexical.rank(*tables(spark, rows, items)).count() == 0


def test_sums_and_tops_of_bitmaps():
    rng = np.random.default_rng(1)
    for _ in range(60):
        docs = int(rng.integers(1, 300))
        wanted = np.zeros(docs, np.int64)
        total = lexical.Sum(50, -(-docs // 64))
        for _ in range(int(rng.integers(1, 9))):
            at = np.sort(rng.choice(docs, rng.integers(1, docs + 1), replace=False))
            values = rng.integers(1, 1 << int(rng.integers(2, 40)), len(at))
            shift = int(rng.integers(0, 3))
            total.add(lexical.impact_slices(values, at, docs), shift)
            wanted[at] += values << shift
        for k in (1, 5, 20, 400):
            at, values = lexical.top(total.slices(), k)
            order = np.lexsort((np.arange(docs), -wanted))[:k]
            order = order[wanted[order] > 0]
            assert sorted(at.tolist()) == sorted(order.tolist()) and (values == wanted[at]).all()


def test_few_bitmaps_at_once(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SLICE_BYTES", 1000)
    rows, items = list(enumerate(corpus(8, 50))), [(k, t) for k, t in enumerate(corpus(8, 6))]
    assert sorted(map(tuple, lexical.rank(*tables(spark, rows, items)).collect()), key=repr) == plain(rows, items)


def test_too_many_queries_are_refused(spark, monkeypatch):
    monkeypatch.setattr(lexical, "MOST_QUERY_BYTES", 10)
    with pytest.raises(ValueError):
        lexical.rank(*tables(spark, [(1, "a")], [(1, "a long query")]))

import itertools
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.helpers import WORDS, corpus, documents, lower, odd_texts
from trackforge.llm import hmm, packing, textops


def model(states, classes, seed=0):
    rng = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    return hmm.Markov(norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((classes, states)), 0))


def test_forward_sums_over_all_paths():
    m, s = model(3, 4), np.array([0, 3, 1, 2, 2, 0])
    total = 0.0
    for path in itertools.product(range(3), repeat=len(s)):
        p = m.start[path[0]] * m.emits[s[0], path[0]]
        for a, b, x in zip(path, path[1:], s[1:], strict=False):
            p *= m.moves[a, b] * m.emits[x, b]
        total += p
    (_, steps, at), = hmm.arranged(np.concatenate([s, s[:2]]), np.array([0, 6]), np.array([6, 2]))
    both = m.forward(at, steps)
    assert math.isclose(both[0], math.log10(total), rel_tol=1e-12)


def test_expected_counts_are_those_of_all_paths():
    m, s = model(2, 3), np.array([0, 2, 1])
    start, moves, emits = np.zeros(2), np.zeros((2, 2)), np.zeros((3, 2))
    weights = {}
    for path in itertools.product(range(2), repeat=3):
        p = m.start[path[0]] * m.emits[s[0], path[0]]
        for a, b, x in zip(path, path[1:], s[1:], strict=False):
            p *= m.moves[a, b] * m.emits[x, b]
        weights[path] = p
    total = sum(weights.values())
    for path, p in weights.items():
        start[path[0]] += p / total
        for a, b in zip(path, path[1:], strict=False):
            moves[a, b] += p / total
        for k, x in zip(path, s, strict=True):
            emits[x, k] += p / total
    (_, steps, at), = hmm.arranged(np.concatenate([s, s]), np.array([0, 3]), np.array([3, 3]))
    found = m.expected(at, steps, 3)
    for a, b in zip(found, (2 * start, 2 * moves, 2 * emits), strict=True):
        assert np.allclose(a, b)


def check(spark, rows, **options):
    docs = documents(spark, rows).repartition(3)
    found = hmm.score(docs, F.col("doc_id") % 3 == 2, buckets=5, **options).collect()
    tokens = [(i, [*WORDS.findall(lower(t or "")), "\0"]) for i, t in rows]
    counts = Counter(w for i, words in tokens if i % 3 != 2 for w in words)
    n, v = sum(counts.values()), len(counts)
    base = lambda words: sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
    wanted = sorted((i, i % 3 == 2, len(w), sum(counts[x] > 0 for x in w), n, round(base(w), 6)) for i, w in tokens)
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == wanted
    assert all(math.isfinite(r.score) and r.score <= 0 for r in found)
    return found


def test_counts_and_base(spark):
    check(spark, list(enumerate(corpus(7, 40))), frequent=50)
    rows = list(enumerate(odd_texts()))
    check(spark, rows + rows[-3:], frequent=20)


def test_states_help_on_held_out_texts(spark):
    rows = [(i, " ".join((["aa", "bb", "cc", "dd"] if i % 2 else ["ee", "ff", "gg", "hh"])[(i * k + k) % 4] for k in range(60))) for i in range(60)]
    found = [r for r in check(spark, rows) if r.held_out]
    assert sum(r.score for r in found) > 0.8 * sum(r.base_score for r in found)


def test_no_training_and_no_rows(spark):
    docs = documents(spark, [(2, "only held out")])
    r = hmm.score(docs, F.col("doc_id") % 3 == 2).first()
    assert (r.train_tokens, r.n_known, r.base_score) == (0, 0, 0.0) and math.isfinite(r.score)
    assert hmm.score(documents(spark, []), F.lit(False)).count() == 0


def learned(docs, states, frequent, rounds):
    """Classes and model from the texts of docs, as score() learns them."""
    import pyarrow as pa

    counts = docs.selectExpr("coalesce(text, '') text").mapInArrow(hmm._count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    classes, _, _ = hmm.learn_classes(counts, frequent)

    def numbered(batches):
        for batch in batches:
            for texts in textops.chunks(batch.column(0)):
                tokens, bounds = hmm.token_hashes(texts)
                for _, steps, at in hmm.arranged(classes.of(tokens).astype(np.int32), bounds[:-1], np.diff(bounds)):
                    yield pa.RecordBatch.from_arrays([pa.array([packing.pack(steps.sizes.astype(np.int32))], pa.binary()), pa.array([packing.compressed(at)], pa.binary())], names=["sizes", "symbols"])

    return classes, hmm.train_model(docs.select("text").mapInArrow(numbered, "sizes binary, symbols binary"), classes, states, rounds)


def test_every_round_sees_all_training_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{x}" for x in rng.integers(0, 12, rng.integers(1, 9)))) for i in range(1700)]
    train = documents(spark, rows).repartition(3)
    classes, start = learned(train, 3, 60, 0)
    _, found = learned(train, 3, 60, hmm.ROUNDS)
    tokens = pa.array([t for _, t in rows])
    plain = start
    for _ in range(14):
        sums = None
        for chunk in textops.chunks(tokens):
            hashes, bounds = hmm.token_hashes(chunk)
            for _, steps, at in hmm.arranged(classes.of(hashes), bounds[:-1], np.diff(bounds)):
                part = plain.expected(at, steps, classes.size)
                sums = part if sums is None else tuple(a + b for a, b in zip(sums, part, strict=True))
        plain = plain.smoothed(*sums, classes.shares())
    for a, b in ((found.start, plain.start), (found.moves, plain.moves), (found.emits, plain.emits)):
        assert np.allclose(a, b, rtol=1e-3, atol=1e-6)


def test_start_rests_on_counts_alone(spark):
    words = [f"w{i % 37}" for i in range(4000)]
    a = [(i, " ".join(words[4 * i : 4 * i + 4])) for i in range(1000)]
    b = [(i, " ".join(words[i::1000])) for i in range(1000)]
    starts = [learned(documents(spark, rows), 3, 60, 0)[1] for rows in (a, b)]
    assert np.array_equal(starts[0].emits, starts[1].emits)


def test_scores_against_plain_recursion(spark):
    rows = list(enumerate(corpus(11, 30) + odd_texts()))
    docs = documents(spark, rows).repartition(3)
    found = {r.doc_id: r.score for r in hmm.score(docs, F.col("doc_id") % 3 == 2, states=3, frequent=30, rounds=3, buckets=4).collect()}
    classes, m = learned(docs.where("doc_id % 3 <> 2"), 3, 30, 3)
    counts = Counter(w for i, t in rows if i % 3 != 2 for w in [*WORDS.findall(lower(t or "")), None])
    of = lambda w: int(classes.of(np.array([hmm.END]) if w is None else textops.Texts(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())])).word_hashes()[0])[0])
    for i, t in rows:
        state, total = m.start, 0.0
        for w in [*WORDS.findall(lower(t or "")), None]:
            c = of(w)
            rare = c - len(classes.frequent)
            share = 1.0 if rare < 0 else (counts[w] + 1) / (classes.rare_tokens[rare] + classes.rare_distinct[rare] + 1)
            state = state * m.emits[c] * share
            total += math.log10(state.sum())
            state = state / state.sum() @ m.moves
        assert math.isclose(total, found[i], rel_tol=1e-6), i  # training sums are of 32-bit numbers


def test_long_and_short_sequences_train_alike(monkeypatch):
    m, rng = model(4, 50), np.random.default_rng(1)
    sizes = np.array([1, 3000, 2, 40, 700, 1, 9000])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    symbols = rng.integers(0, 50, sizes.sum())
    one = lambda a, n: m.expected(symbols[a : a + n], hmm.Steps(np.array([n])), 50)
    wanted = [sum(x) for x in zip(*(one(a, n) for a, n in zip(starts, sizes, strict=True)), strict=True)]
    monkeypatch.setattr(hmm, "CHUNK_TOKENS", 5000)
    monkeypatch.setattr(hmm, "MOST_TOKENS", 6000)
    parts = list(hmm.arranged(symbols, starts, sizes))
    assert len(parts) > 1 and sorted(np.concatenate([p[0] for p in parts]).tolist()) == list(range(7))
    sums = [sum(x) for x in zip(*(m.expected(at, steps, 50) for _, steps, at in parts), strict=True)]
    for a, b in zip(sums, wanted, strict=True):
        assert np.allclose(a, b, rtol=1e-4)


def test_null_ids_and_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(hmm, "ADDED_AT_ONCE", 2)
    docs = documents(spark, [(None, "a b"), (None, "a c"), (None, "a b"), (4, None)]).repartition(4)
    found = hmm.score(docs, F.col("doc_id") % 7 == 2, rounds=2).collect()
    assert sorted(r.n_tokens for r in found) == [1, 3, 3, 3] and {r.train_tokens for r in found} == {10} and not any(r.held_out for r in found)


def test_the_most_frequent_are_among_often(spark):
    counts = spark.createDataFrame([(i, 1 + i * i % 1000) for i in range(500)], "token long, n long")
    for wanted in (1, 10, 499, 1000):
        chosen = {r.token for r in hmm.often(counts, wanted).collect()}
        assert {r.token for r in counts.orderBy(F.desc("n"), "token").limit(wanted).collect()} <= chosen
    assert hmm.often(counts.limit(0), 5).count() == 0

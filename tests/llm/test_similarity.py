"""Jaccard join, decontamination, neighbours."""

import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import WORDS, corpus, documents, lower, odd_texts
from trackforge.llm import decontaminate, jaccard_join, neighbours


def shingles(text, size):
    w = WORDS.findall(lower(text or ""))
    return [tuple(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [tuple(w)] if w else []


def linked(rows, size, percent):
    sets = [(i, frozenset(shingles(t, size))) for i, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a][1] & sets[b][1])
            if common and 100 * common >= percent * len(sets[a][1] | sets[b][1]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize("size, percent, seed", [(3, 90, 1), (5, 80, 2)])
def test_components_against_all_pairs(spark, size, percent, seed):
    base = corpus(seed, 20)
    rng = random.Random(seed)
    texts = list(base)
    for t in base[:8]:
        for edits in (1, 2, 3, 5, 8):
            w = t.split()
            for _ in range(edits):
                if w:
                    w[rng.randrange(len(w))] = f"e{rng.randint(0, 99)}"
            texts.append(" ".join(w))
    rows = list(enumerate(texts + odd_texts() + texts[:3]))
    found = jaccard_join.join_classes(documents(spark, rows).repartition(3), jaccard_join.Similarity(size, percent)).collect()
    wanted = linked(rows, size, percent)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == wanted
    assert Counter(r.component_id for r in found if r.representative and r.n_shingles) == Counter({c for _, n, c in wanted if n})


def test_a_large_group_of_near_copies(spark):
    base = [f"b{i}" for i in range(70)]
    rows = []
    for i in range(120):
        w = list(base)
        for k in range(i % 4):
            w[(i * 7 + k * 23) % 70] = f"n{i}"
        rows.append((i, " ".join(w)))
    found = jaccard_join.join_classes(documents(spark, rows), jaccard_join.Similarity(5, 80)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == linked(rows, 5, 80)


def test_join_of_nothing(spark):
    assert jaccard_join.join_classes(documents(spark, []), jaccard_join.Similarity(3, 90)).count() == 0
    found = jaccard_join.join_classes(documents(spark, [(1, None), (2, ""), (3, " ")]), jaccard_join.Similarity(3, 90)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.representative) for r in found) == [(i, 0, i, True) for i in (1, 2, 3)]


def test_walks_of_a_prefix_tree():
    rng = np.random.default_rng(4)
    for percent in (50, 80, 95):
        s = jaccard_join.Similarity(3, percent)
        base = np.arange(0, 400, 2)
        sets = {np.unique(np.concatenate([rng.choice(base, rng.integers(1, len(base)), replace=False), rng.integers(0, 400, 9)])).tobytes() for _ in range(40)}
        for _ in range(40):
            x = np.setdiff1d(base, rng.choice(base, rng.integers(0, 12)))
            sets |= {x.tobytes(), x[: rng.integers(1, len(x))].tobytes()}
        sets = [np.frombuffer(x, np.int64) for x in sorted(sets)]
        groups = rng.integers(0, 5, len(sets))
        tree = jaccard_join.PrefixTree(sets, groups, 400)
        for x in sets:
            common = [len(np.intersect1d(x, y)) for y in sets]
            wanted = [i for i, (y, c) in enumerate(zip(sets, common, strict=True)) if 100 * c >= percent * (len(x) + len(y) - c)]
            assert sorted(tree.similar(x, s).tolist()) == wanted
            assert sorted(tree.similar(x, s, 2, len(x)).tolist()) == [i for i in wanted if groups[i] != 2 and len(sets[i]) >= len(x)]


def test_families_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", 2_000)
    rng = random.Random(9)
    rows = []
    for i in range(90):
        w = [f"b{k}" for k in range(60)]
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(60)] = f"n{i % 30}"
        rows.append((i, " ".join(w)))
    found = jaccard_join.join_classes(documents(spark, rows), jaccard_join.Similarity(3, 90)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == linked(rows, 3, 90)


def brute(rows, items, threshold=0.8, size=5):
    out = {}
    for i, t in rows:
        w = WORDS.findall(lower(t or ""))
        for item, text in items:
            v = WORDS.findall(lower(text or ""))
            if not v or not w:
                continue
            own, best = Counter(shingles(text, size)), 0.0
            for s in range(max(1, len(w) - len(v) + 1)):
                got = Counter(shingles(" ".join(w[s : s + len(v)]), size))
                best = max(best, sum((own & got).values()) / sum((own | got).values()))
            if best >= threshold:
                out[i, item] = round(best, 9)
    return out


def test_leaks_against_all_windows(spark):
    rng = random.Random(8)
    items = [(k, " ".join(f"i{k}x{rng.randint(0, 30)}" for _ in range(rng.randint(8, 40)))) for k in range(6)] + [(50, "just three words"), (51, None), (52, "")]
    rows = []
    for i in range(40):
        filler = [f"f{rng.randint(0, 500)}" for _ in range(rng.randint(0, 80))]
        if i % 3 == 0:
            leak = rng.choice(items[:7])[1].upper().split()
            if i % 2:
                leak[0] = "edit"
            at = rng.randint(0, len(filler))
            filler[at:at] = leak
        rows.append((i, " ".join(filler)))
    rows += list(enumerate(odd_texts(), 100)) + rows[:1]
    table = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, rows)
    found = decontaminate.matches(docs, table).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in found} == brute(rows, items)
    bad = {r.doc_id for r in found}
    assert sorted(r.doc_id for r in decontaminate.keep_clean(docs, table).collect()) == sorted(i for i, _ in rows if i not in bad)
    assert decontaminate.matches(docs, table.limit(0)).count() == 0
    assert decontaminate.matches(documents(spark, []), table).count() == 0


def test_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    index = decontaminate.BlockIndex(prints, 21)
    for item in range(5):
        for _ in range(200):
            flips = rng.choice(64, 21, replace=False)
            value = prints[item] ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64))
            assert (0, item) in index.within(np.array([value], np.uint64))


def found_by(items, texts):
    import pyarrow as pa

    from trackforge.llm import textops

    finder = decontaminate.Finder(decontaminate.Benchmark.build(items, 5), 5, 0.8, 21)
    return [(texts[t.first + i][0], int(finder.b.item_ids[item]), score) for t in textops.chunks(pa.array([x for _, x in texts])) for i, item, score, _ in finder.find(t)]


def test_blocks_generate_the_candidates(monkeypatch):
    items = [(1, " ".join(f"w{i}" for i in range(20))), (2, " ".join(f"w{i}" for i in range(30)))]
    texts = [(7, "before " + items[0][1] + " after"), (8, items[1][1])]
    assert {f[:2] for f in found_by(items, texts)} == {(7, 1), (8, 1), (8, 2)}
    monkeypatch.setattr(decontaminate.BlockIndex, "agreeing", lambda self, values: iter(()))
    assert found_by(items, texts) == []


def test_few_pairs_reach_the_blocks_however_many_items_there_are(monkeypatch):
    """Items of other content cost no pair, and a third of the items may share most of their shingles."""
    rng = random.Random(4)
    own = [(k, " ".join(f"v{rng.randint(0, 4000)}" for _ in range(30))) for k in range(40)]
    words = [w for _, t in own for w in t.split()]
    texts = [(k, " ".join(rng.choices(words, k=200) + (own[k][1].split() if k % 3 else []) + rng.choices(words, k=200))) for k in range(30)]
    seen, all_pairs = [], [0]
    plain = decontaminate.BlockIndex.agreeing

    def counted(self, values):
        all_pairs[0] += len(values) * len(self.prints)
        for at, of in plain(self, values):
            seen[-1] += len(at)
            yield at, of

    monkeypatch.setattr(decontaminate.BlockIndex, "agreeing", counted)
    results = []
    for more in (0, 2000):
        seen.append(0)
        others = [(1000 + k, " ".join(f"u{rng.randint(0, 9000)}" for _ in range(30))) for k in range(more)]
        results.append(sorted(found_by(own + others, texts)))
    assert results[0] == results[1] and {f[:2] for f in results[0]} == {(k, k) for k in range(30) if k % 3}
    windows = sum(len(t.split()) - 29 for _, t in texts)
    assert seen[0] == seen[1] <= 0.01 * windows * len(own)


def test_shared_shingles_ties_and_long_documents(monkeypatch):
    common = " ".join(f"c{i}" for i in range(12))
    items = [(k, f"{common} a{k} b{k} c{k} d{k} e{k} f{k} g{k} h{k}") for k in range(40)] + [(40, items_text := common + " same"), (41, items_text)]
    texts = [(0, "x " * 300 + items[3][1] + " y" * 300), (1, (common + " z ") * 60), (2, items_text), (3, items[5][1] + " q " * 400 + items[6][1])]
    wanted = brute(texts, items)
    assert {f[:2]: round(f[2], 9) for f in found_by(items, texts)} == wanted and (2, 41) in wanted
    monkeypatch.setattr(decontaminate, "PIECE", 50)
    assert {f[:2]: round(f[2], 9) for f in found_by(items, texts)} == wanted


def test_null_item_ids_and_null_texts(spark):
    items = spark.createDataFrame([(None, "one two three four five six"), (3, None), (4, "one two three four five six")], "item_id long, text string")
    docs = documents(spark, [(None, "one two three four five six"), (2, None), (5, "one two three four five six"), (5, "one two three four five six")])
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.matches(docs, items).collect() if r.doc_id) == [(5, 4), (5, 4)]
    assert decontaminate.matches(docs, items).count() == 3 and [r.doc_id for r in decontaminate.keep_clean(docs, items).collect()] == [2]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_neighbours_recall_and_order(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    data = [(i, [float(v) for v in rng.normal(centres[i % 12], 0.4)], 0) for i in range(1500)]
    v = vectors(spark, data)
    found = neighbours.search(v, v.where("vec_id % 20 = 0"), sample=800).collect()
    matrix = np.array([d[1] for d in data], np.float32).astype(float)
    hit = 0
    for q in range(0, 1500, 20):
        got = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        assert [g[0] for g in got] == list(range(1, 21)) and [g[2] for g in got] == sorted((g[2] for g in got), reverse=True)
        scores = matrix @ matrix[q]
        scores[q] = -np.inf
        hit += len({g[1] for g in got} & set(np.argsort(-scores)[:20].tolist()))
        assert all(abs(s - matrix[q] @ matrix[i]) < 1e-9 for _, i, s in got)
    assert hit / (75 * 20) >= 0.9


def test_few_odd_and_equal_vectors(spark):
    rows = [(0, [1.0, 0.0], 1), (3, [0.5, 0.5], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (4, None, 1), (5, [0.0, 0.0], 1), (6, [float("nan"), 1.0], 1), (7, [1.0, None], 1), (8, [float("inf"), 0.0], 1), (20, [0.0, 1.0], 1)]
    v = vectors(spark, rows)
    found = neighbours.search(v, v.where("vec_id % 20 = 0")).collect()
    assert [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r.rank) if r.query_id == 0] == [(1, 1.0), (2, 1.0), (3, 0.5), (20, 0.0)]
    assert [r.vec_id for r in sorted(found, key=lambda r: r.rank) if r.query_id == 20] == [3, 0, 1, 2]
    assert neighbours.search(v.limit(0), v).count() == 0


def test_parts_are_balanced():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(203, 4))
    part = neighbours.balanced_parts(neighbours.exact_top(x, np.arange(203), 6), 4)
    assert sorted(np.bincount(part).tolist()) == [50, 51, 51, 51]


def test_recall_over_more_vectors_than_the_sample(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 12))
    data = [(i, [float(v) for v in rng.normal(centres[i % 40], 0.5)], 0) for i in range(7000)]
    v = vectors(spark, data)
    found = neighbours.search(v, v.where("vec_id % 20 = 0")).collect()
    matrix = np.array([d[1] for d in data], np.float32).astype(float)
    got = {}
    for r in found:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in range(0, 7000, 20):
        scores = matrix @ matrix[q]
        scores[q] = -np.inf
        hit += len(got[q] & set(np.argsort(-scores)[:20].tolist()))
    assert hit / (350 * 20) >= 0.9


def test_nearest_of_a_sample_leave_the_query_out():
    x = np.random.default_rng(2).normal(size=(300, 5))
    near = neighbours.exact_top(x, np.arange(300), 4)
    scores = x @ x.T
    np.fill_diagonal(scores, -np.inf)
    assert [set(n) for n in near.tolist()] == [set(n) for n in np.argsort(-scores, axis=1)[:, :4].tolist()]


def test_cells_lengths_repeated_ids_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 16)
    monkeypatch.setattr(neighbours, "QUERY_CELL", 2)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-5, 6, 3)]) for i in range(90)]
    rows += [(100 + i, [float(x) for x in rng.integers(-5, 6, 2)]) for i in range(30)] + [rows[7], (20, [1.0, 1.0, 1.0]), (20, [0.0, 1.0, 1.0])]
    rows = [(i, v) for i, v in rows if any(v)]
    v = spark.createDataFrame([(i, v, 1, 2, "c", 0.5) for i, v in rows], "vec_id long, embedding array<float>, part int, rank int, cell string, score double")
    found = neighbours.search(v, v.where("vec_id % 20 = 0"), k=5).collect()
    wanted = []
    asked = {}
    for i, x in rows:
        if i % 20 == 0:
            asked[i] = min(x, asked.get(i, x))
    for q, x in asked.items():
        near = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in rows if i != q and len(x) == len(y))[:5]
        wanted += [(q, k, i, -d) for k, (d, i) in enumerate(near, 1)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found) == sorted(wanted)


def test_labels_are_merged_and_not_broadcast(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a long, b long")
    joins, plain_join = [], type(links).join
    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(links), "join", lambda self, *a, **k: (joins.append(plain_join(self, *a, **k)), joins[-1])[1])
        found = sorted(map(tuple, jaccard_join.components(links).collect()))
    assert found == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)]
    assert joins and all("BroadcastHashJoin" not in j._jdf.queryExecution().executedPlan().toString() for j in joins)


def test_no_join_of_near_copies_is_broadcast(spark):
    """All joins of the whole job, its rounds and families included, whatever sizes Spark expects."""
    base = [f"b{i}" for i in range(70)]
    texts = [" ".join([*base[:k], f"e{k}", *base[k + 1 :]]) for k in range(0, 70, 2)] + corpus(5, 20)
    joins, plain_join = [], type(spark.range(1)).join
    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(spark.range(1)), "join", lambda self, *a, **k: (joins.append(plain_join(self, *a, **k)), joins[-1])[1])
        jaccard_join.drop_copies(documents(spark, list(enumerate(texts))), jaccard_join.Similarity(3, 90)).collect()
    assert len(joins) > 15 and all("Broadcast" not in j._jdf.queryExecution().executedPlan().toString() for j in joins)

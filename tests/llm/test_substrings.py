import hashlib
import random
import re
from collections import Counter

import numpy as np

from tests.llm.helpers import WORDS, corpus, documents, odd_texts
from trackforge.llm import packing, repeats, suffix_array, suffix_tree, textops


def words_left(rows, window):
    seen, out = Counter(), []
    lists = [WORDS.findall(t or "") for _, t in rows]
    for w in lists:
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    for (i, _), w in zip(rows, lists, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def bytes_left(rows, window):
    first, out = {}, []
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - window + 1):
            first[b[k : k + window]] = min(i, first.get(b[k : k + window], i))
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if first[b[k : k + window]] < i:
                gone[k : k + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def both(spark, rows, buckets=7):
    docs = documents(spark, rows).repartition(3)
    assert sorted(map(tuple, suffix_tree.dedup_digests(docs, buckets=buckets).collect()), key=repr) == words_left(rows, 35)
    assert sorted(map(tuple, suffix_array.dedup_bytes(docs, buckets=buckets).collect()), key=repr) == bytes_left(rows, 50)


def test_random_corpora(spark):
    for seed in (1, 2):
        both(spark, list(enumerate(corpus(seed))))


def test_odd_texts_and_repeated_rows(spark):
    rows = list(enumerate(odd_texts()))
    both(spark, rows + rows[-5:])


def test_one_id_for_different_texts(spark):
    a, b, c = (" ".join(f"{p}{i}" for i in range(80)) for p in "abc")
    both(spark, [(1, a), (1, b + " " + c), (2, c), (3, a + " z"), (3, "short")])


def test_hot_passage(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    both(spark, [(i, f"{i} begins {'x' * (i % 5)} {passage} ends {i}") for i in range(90)])


def test_null_id_and_empty_table(spark):
    text = " ".join(map(str, range(50)))
    found = {r.doc_id: r.n_removed for r in suffix_array.dedup_bytes(documents(spark, [(5, text), (None, text)])).collect()}
    assert found[5] == 0 and found[None] == len(text)
    assert suffix_tree.dedup_digests(documents(spark, [])).count() == 0


def test_small_groups_of_the_tree_give_the_same(spark):
    rng = np.random.default_rng(2)
    words = rng.integers(0, 3, 400).astype(np.uint64)
    suffixes = np.arange(len(words) - 10)
    expected = Counter(tuple(words[i : i + 10]) for i in suffixes)
    wanted = [expected[tuple(words[i : i + 10])] > 1 for i in suffixes]
    for limit in (1, 5, 1000):
        assert suffix_tree.repeated_windows(words, suffixes, 10, np.ones(len(suffixes)), limit).tolist() == wanted


def test_suffix_arrays_against_sorting():
    rng = random.Random(6)
    cases = [[rng.randint(1, symbols) for _ in range(n)] for symbols, n in ((2, 60), (3, 300), (26, 500), (2, 1), (1, 40), (5000, 900), (2, 2000))]
    for s in [*cases, [1, 2] * 70, [2, 1, 1] * 50, [*cases[1], *cases[1], *cases[1]], list(range(1, 90)), list(range(90, 0, -1)), [3] * 30 + [1] * 30 + [2] * 30]:
        n, s = len(s), [*s, 0]
        found = suffix_array.suffix_array(np.array(s)).tolist()
        assert found == sorted(range(n + 1), key=lambda i: s[i:])
        if max(s) < 256:
            common = suffix_array.permuted_common_prefixes(np.array(s, np.uint8), np.array(found), 50)
            for a, b in zip(found, found[1:], strict=False):
                real = next((k for k in range(50) if a + k > n or b + k > n or s[a + k] != s[b + k]), 50)
                assert common[b] == real


def test_names_of_real_text_are_sorted_by_recursion(monkeypatch):
    rng = random.Random(2)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9))) for _ in range(5000)]
    parts = [" ".join(rng.choices(words, k=400)) for _ in range(300)]
    text = " ".join(rng.choices(parts, k=450))[: 1 << 20].encode()
    levels, real = [], suffix_array.suffix_array

    def counted(s):
        levels.append((len(s), len(np.unique(s))))
        return real(s)

    monkeypatch.setattr(suffix_array, "suffix_array", counted)
    s = np.append(np.frombuffer(text, np.uint8), 0)
    found = counted(s)
    assert len(levels) >= 3 and levels[2][1] > 10_000
    at = rng.sample(range(1, len(s)), 2000)
    assert all(text[found[i - 1] :] < text[found[i] :] for i in at) and len(np.unique(found)) == len(s)


def test_large_shards_are_split_by_anchor(spark, monkeypatch):
    monkeypatch.setattr(suffix_array, "SORTED_BYTES", 300)
    rng = random.Random(9)
    rows = [(i, t) for i, t in enumerate(corpus(4, 30)) if rng.random() < 0.9]
    contents, ids, first, count = [], [], [], []
    windows = repeats.Windows("byte", 50, suffix_array.ANCHOR, True)
    from trackforge.llm import textops

    for i, t in rows:
        data = np.frombuffer(t.encode(), np.uint8)
        found = windows.neighbourhoods(textops.Texts(data, np.array([0, len(data)])))
        for a, b in zip(found.first.tolist(), found.last.tolist(), strict=True):
            contents.append(t.encode()[a : b + 50])
            ids.append(i)
            first.append(a)
            count.append(b - a + 1)
    blob = np.frombuffer(b"".join(contents), np.uint8)
    shard = repeats.Shard(textops.Texts(blob, np.concatenate([[0], np.cumsum([len(c) for c in contents])])), np.array(ids), np.zeros(len(ids), np.int64), np.array(first), np.array(count), np.ones(len(ids), np.uint8))
    least = {}
    for i, c in zip(ids, contents, strict=True):
        for k in range(len(c) - 49):
            least[c[k : k + 50]] = min(i, least.get(c[k : k + 50], i))
    wanted = [least[c[k : k + 50]] < i for i, c in zip(ids, contents, strict=True) for k in range(len(c) - 49)]
    assert suffix_array.judge(shard).tolist() == wanted and any(wanted)


def test_packed_arrays_come_back():
    arrays = [np.array([5, -3, 1 << 60], np.int64), np.zeros(0, np.int32), np.array([1 << 63], np.uint64), np.arange(300, dtype=np.uint8), np.array([0.5])]
    for a, b in zip(arrays, packing.unpack(packing.pack(*arrays)), strict=True):
        assert a.dtype == b.dtype and (a == b).all()


def test_words_of_a_bucket_are_hashed_in_pieces(monkeypatch):
    rows = [" ".join(f"w{i}x{k}" for k in range(3000)).encode() for i in range(60)] + [b"", b"a b"]
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    texts = textops.Texts(np.frombuffer(b"".join(rows), np.uint8), bounds)
    whole, _, _, firsts = texts.word_hashes()
    seen, plain = [], textops.Texts.word_hashes
    monkeypatch.setattr(textops.Texts, "word_hashes", lambda self, *a: (seen.append(len(self.data)), plain(self, *a))[1])
    none = np.zeros(len(rows), np.int64)
    windows = np.maximum(np.diff(firsts) - suffix_tree.WINDOW + 1, 0)
    suffix_tree.judge(repeats.Shard(texts, none, none, none, windows, none + 1))
    assert max(seen) <= textops.CHUNK_BYTES < len(texts.data)
    hashes, first = suffix_tree.hashed_words(texts)
    assert (hashes == whole).all() and (first == firsts[:-1]).all()


def test_large_texts_make_more_buckets_than_partitions(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 10)
    docs = spark.createDataFrame([(1, "x" * 95), (2, None)], "doc_id long, text string")
    assert (repeats.enough_buckets(docs, "text", 4), repeats.enough_buckets(docs, "text", 40)) == (11, 41)

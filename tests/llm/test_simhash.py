"""SimHash near-duplicates against all pairs, and the promises of the Golay keys."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.helpers import WORDS, corpus, documents, lower, odd_texts
from trackforge.llm import golay, simhash


def plain_print(text):
    w = WORDS.findall(lower(text or ""))
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """prints: (doc_id, fingerprint); all pairs."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(prints):
        least[find(k)] = min(i, least.get(find(k), i))
    return [least[find(k)] for k in range(len(prints))]


def test_every_word_is_near_one_codeword():
    words = np.random.default_rng(1).integers(0, 1 << 23, 5000).astype(np.uint32)
    errors = golay._tables()[2]
    assert len(np.unique(golay.nearest(np.arange(0, 1 << 23, 97, dtype=np.uint32)))) == 4096
    assert np.bitwise_count(errors).max() == 3 and len(np.unique(errors)) == 2048
    codewords = words ^ errors[golay.syndromes(words)]
    assert not golay.syndromes(codewords).any()
    near = golay.surrounding(words)
    assert (near[0] == golay.nearest(words)).all()
    assert {len(set(c)) for c in near.T.tolist()} == {1, 6}


def test_fingerprints_within_the_radius_share_a_key():
    rng = random.Random(2)
    for _ in range(400):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 4)):
            y ^= 1 << b
        keys, of = simhash.fuzzy_keys(np.array([x, y], np.uint64))
        assert set(keys[of == 0].tolist()) & set(keys[of == 1].tolist())
        assert len(set(zip(keys.tolist(), of.tolist(), strict=True))) == len(keys)


def test_against_all_pairs(spark):
    rng = random.Random(7)
    texts = []
    for text in corpus(3, 40):
        texts.append(text)
        for edits in (1, 1, 2, 4):
            w = text.split()
            for _ in range(edits):
                if w:
                    w[rng.randrange(len(w))] = f"e{rng.randint(0, 99)}"
            texts.append(" ".join(w))
    rows = list(enumerate(texts + odd_texts() + texts[:3] + ["Only Three Words", "only three words"]))
    found = simhash.near_classes(documents(spark, rows).repartition(3)).collect()
    prints = [(i, plain_print(t)) for i, t in rows]
    wanted = [(i, x, c) for (i, x), c in zip(prints, plain_components(prints), strict=True)]
    assert sorted((r.doc_id, r.fingerprint % (1 << 64), r.component_id) for r in found) == sorted(wanted)
    assert len({c for *_, c in wanted}) < len({x for _, x, _ in wanted})


def families(seed):
    """Fingerprints in chains, balls and at random, with pairs at just over the radius."""
    rng = random.Random(seed)
    out = {0}
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 10, 60])):
            y = x
            for b in rng.sample(range(64), rng.randint(1, 6)):
                y ^= 1 << b
            out.add(y)
            if rng.random() < 0.2:
                x = y
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_links_of_families(spark, seed):
    prints = list(enumerate(families(seed)))
    table = spark.createDataFrame([(i, x - (x >> 63 << 64)) for i, x in prints], "least long, print long")
    first = simhash.leader_links(table.withColumn("component", F.col("print")), 4)
    labels = simhash.components(first)
    placed = table.join(labels, F.col("print") == F.col("node"), "left").select("print", F.coalesce("component", "print").alias("component"))
    labels = simhash.components(first.union(simhash.stranger_links(placed, 4)))
    number = {r.print: r.least for r in table.collect()}
    least = {}
    found = {number[r.node]: r.component for r in labels.collect()}
    for i, _ in prints:
        least[found.get(i, i)] = min(i, least.get(found.get(i, i), i))
    assert [least[found.get(i, i)] for i, _ in prints] == plain_components(prints)


def test_nulls_and_nothing(spark):
    assert simhash.near_classes(documents(spark, [])).count() == 0
    rows = [(None, "a b c d e"), (None, "a b c d e"), (7, None), (3, " \n"), (7, None), (9, "a b c d e f g h i")]
    found = sorted(((r.doc_id, r.component_id) for r in simhash.near_classes(documents(spark, rows)).collect()), key=repr)
    assert found == sorted([(None, None), (None, None), (7, 3), (7, 3), (3, 3), (9, 9)], key=repr)
    with pytest.raises(ValueError):
        simhash.near_classes(documents(spark, []), radius=5)


def test_a_long_text_in_pieces(spark, monkeypatch):
    text = " ".join(f"w{i * i % 7919}" for i in range(5000))
    monkeypatch.setattr(simhash, "HELD", 701)
    texts = next(simhash.textops.chunks(simhash.pa.array([text, None, " x  y ", "A b\tC d\n\ne"])))
    assert simhash.fingerprints(texts, 4).tolist() == [plain_print(t) for t in (text, None, " x  y ", "A b\tC d\n\ne")]


def test_keys_are_made_by_all_tasks_and_led_without_a_join(spark):
    prints = spark.createDataFrame([(i * 7919,) for i in range(64)], "print long").coalesce(1).selectExpr("print", "print as component")
    assert simhash.keyed(prints).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert "Join" not in simhash.leader_links(prints, 4)._jdf.queryExecution().optimizedPlan().toString()

import hashlib
import random
import zlib
from collections import defaultdict

from tests.llm.helpers import documents, odd_texts
from trackforge.llm import sharding


def smallest_capacity(sizes, shards):
    low, high = max(sizes, default=0), sum(sizes)
    while low < high:
        middle, used, room = (low + high) // 2, 1, (low + high) // 2
        for s in sizes:
            if s > room:
                used, room = used + 1, middle
            room -= s
        low, high = (low, middle) if used <= shards else (middle + 1, high)
    return low


def check(spark, texts, shards):
    rows = list(enumerate(texts))
    found = sharding.shard(documents(spark, rows), shards).collect()
    assert sorted(r.doc_id for r in found) == sorted(i for i, _ in rows)
    groups, shard_of, totals, slots = defaultdict(int), defaultdict(set), defaultdict(int), defaultdict(list)
    for r in found:
        text = texts[r.doc_id]
        assert r.size == len((text or "").encode()) + 1
        assert r.text_crc32 == (None if text is None else zlib.crc32(text.encode()))
        key = "0" * 64 if text is None else hashlib.sha256(text.encode()).hexdigest()
        groups[key] += r.size
        shard_of[key].add(r.shard)
        totals[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in shard_of.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(totals.values(), default=0) == smallest_capacity([groups[k] for k in sorted(groups)], shards)
    assert all(0 <= s < shards for s in totals)


def test_capacity_is_the_smallest(spark):
    rng = random.Random(3)
    texts = ["t" * rng.randint(0, 400) + str(rng.randint(0, 300)) for _ in range(400)]
    check(spark, texts, 8)
    check(spark, texts[:9], 4)


def test_hot_group_and_odd_texts(spark):
    check(spark, ["same text"] * 40 + [f"other {i}" for i in range(60)], 3)
    check(spark, odd_texts(), 3)


def test_cuts_are_refined_down_to_single_groups(spark, monkeypatch):
    monkeypatch.setattr(sharding, "STEP", 1)
    rng = random.Random(4)
    check(spark, [str(i) + "x" * rng.randint(0, 50) for i in range(500)], 5)


def test_empty(spark):
    assert sharding.shard(documents(spark, []), 8).count() == 0

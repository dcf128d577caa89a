"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into segments of 23, 23 and 18 bits. If two fingerprints differ in four bits at most,
two of the three segments differ in two bits at most together, since otherwise the three sums of two segments would
exceed twice four. Of such two segments either one is equal and the other differs in two bits at most, or both differ
in one. In the latter case no segment is equal, or another two would do; so the third differs in one bit or in two. The
segments decode to the names of nearby Golay codewords, which makes the keys:

- one segment as it is, with each codeword around the other;
- the codeword of one segment, with each codeword around the other; where the other is the short segment, which has few
  codewords, with itself and with its bits flipped one by one instead. As both segments differ in one bit, their
  parities differ, and that of the third doesn't if it differs in two bits; so parities are part of the key. Three
  segments that differ in one bit each are left to the first two.

So all fingerprints that link share a key, and few others do. Copies are one fingerprint. The steps:

1. In each group of a key two members lead, and every other is compared with these two. Their links make components.
2. A group of one component is done. In the others, members that aren't of the group's largest component are compared
   with all members of other components. A large family of near copies is thus not compared within itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackforge.llm import golay, textops
from trackforge.llm.durable import materialise, release_shuffles, staged
from trackforge.llm.jaccard_join import NULL_ID, components
from trackforge.llm.workers import bound_batches, lean

SHINGLE = 4
RADIUS = 4  # the keys are complete up to this distance
SEED = 42
SEGMENTS = ((0, 23), (23, 23), (46, 18))  # first bit and width
HELD = 1 << 15  # shingles whose bits are held at once
ROWS = 1 << 13  # fingerprints whose keys are made at once


def shingle_spans(texts: textops.Texts, size: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Words joined by single spaces; start and end of each shingle in them; bounds of each text's shingles."""
    low = texts.lowered()
    starts, ends, firsts = low.words()
    kept = textops.solid(low.data)
    solid = kept.copy()
    kept[ends[ends < len(kept)]] = True  # the space behind a word
    line = np.where(solid, low.data, 0x20)[kept].astype(np.uint8)
    place = np.concatenate([[0], np.cumsum(kept)])
    n = np.diff(firsts)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    first = textops.expand(firsts[:-1], count)
    last = first + np.repeat(np.minimum(n, size), count) - 1
    return line.tobytes(), place[starts[first]], place[ends[last]], np.concatenate([[0], np.cumsum(count)])


def fingerprints(texts: textops.Texts, size: int) -> np.ndarray:
    """A bit is 1 if it is set in over half of a text's shingle hashes, repeats included; zero for a text without words."""
    line, starts, ends, bounds = shingle_spans(texts, size)
    digest, out = xxhash.xxh64_digest, np.zeros(len(texts), np.uint64)
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        total = np.zeros(64, np.int64)
        for low in range(a, b, HELD):
            high = min(b, low + HELD)
            hashes = b"".join([digest(line[x:y], SEED) for x, y in zip(starts[low:high].tolist(), ends[low:high].tolist(), strict=True)])
            total += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int32)
        out[i] = np.packbits(2 * total > b - a).view(">u8")[0]
    return out


def _printed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in textops.chunks(batch.column(1)):
                found = fingerprints(texts, size).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.first, len(texts)), pa.array(found)], names=["doc_id", "print"])

    return run


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys of each fingerprint, and the number of the fingerprint that each belongs to."""
    words = [((prints >> np.uint64(a)) & np.uint64((1 << w) - 1)).astype(np.uint32) for a, w in SEGMENTS]
    near = [np.sort(golay.surrounding(w, width), axis=0).astype(np.uint64) for w, (_, width) in zip(words, SEGMENTS, strict=True)]
    new = [np.concatenate([np.ones((1, len(prints)), bool), c[1:] != c[:-1]]) for c in near]
    own = [golay.nearest(w).astype(np.uint64) for w in words]
    odd = [(np.bitwise_count(w) & 1).astype(np.uint64) for w in words]
    keys, of = [], []

    def add(kind: int, values: np.ndarray, at: np.ndarray) -> None:
        keys.append(np.uint64(kind) << np.uint64(40) | values)
        of.append(at)

    for pair, (s, t, third) in enumerate(((0, 1, None), (0, 2, 1), (1, 2, 0))):
        around, at_t = near[t][new[t]], np.nonzero(new[t])[1]
        before, at_s = near[s][new[s]], np.nonzero(new[s])[1]
        add(3 * pair, words[s][at_t].astype(np.uint64) << np.uint64(12) | around, at_t)
        add(3 * pair + 1, words[t][at_s].astype(np.uint64) << np.uint64(12) | before, at_s)
        parity = odd[s] << np.uint64(1) | odd[t]
        other = parity ^ np.uint64(3)
        if third is None:
            add(3 * pair + 2, parity[at_t] << np.uint64(24) | own[s][at_t] << np.uint64(12) | around, at_t)
            add(3 * pair + 2, other[at_s] << np.uint64(24) | before << np.uint64(12) | own[t][at_s], at_s)
        else:
            parity, other = parity | odd[third] << np.uint64(2), other | odd[third] << np.uint64(2)
            word, width = words[t].astype(np.uint64), SEGMENTS[t][1]
            add(3 * pair + 2, parity[at_s] << np.uint64(30) | before << np.uint64(18) | word[at_s], at_s)
            flipped = word ^ (np.uint64(1) << np.arange(width, dtype=np.uint64))[:, None]
            add(3 * pair + 2, (other << np.uint64(30) | own[s] << np.uint64(18) | flipped).ravel(), np.tile(np.arange(len(prints)), width))
    return np.concatenate(keys), np.concatenate(of)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """print, component -> a row (key, tag, print, component) for each key; tag is a number of the fingerprint in no order."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            prints = batch.column(0).to_numpy().view(np.uint64)
            keys, of = fuzzy_keys(prints)
            tags = textops.mix(prints).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(tags[of]), batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of))], names=["key", "tag", "print", "component"])


def keyed(prints: DataFrame) -> DataFrame:
    """The keys of all fingerprints. A few bytes become 89 rows, so fingerprints are first dealt to all shuffle partitions."""
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return prints.select("print", "component").repartition(parts, "print").mapInArrow(lean(_keyed), "key long, tag long, print long, component long")


def leader_links(prints: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) of the two leaders of each key with its other fingerprints."""
    group = Window.partitionBy("key")
    led = keyed(prints).select("print", F.min_by("print", "tag").over(group).alias("first"), F.max_by("print", "tag").over(group).alias("second")).where("first <> second")
    met = led.select("print", F.explode(F.array("first", "second")).alias("leader"))
    return met.where((F.col("print") != F.col("leader")) & (F.bit_count(F.col("print").bitwiseXOR(F.col("leader"))) <= radius)).select(F.col("leader").alias("a"), F.col("print").alias("b")).distinct()


def stranger_links(prints: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between fingerprints of different components that share a key, at least one for each two that link."""
    group = Window.partitionBy("key")
    rows = keyed(prints).select("key", "print", "component", F.min("component").over(group).alias("c0"), F.max("component").over(group).alias("c1")).where("c0 <> c1")
    rows = rows.select("key", "print", "component", F.count("*").over(Window.partitionBy("key", "component")).alias("size"))
    rows = materialise(rows.select("key", "print", "component", F.max(F.struct("size", "component")).over(group)["component"].alias("largest")))
    strangers = rows.where("component <> largest").select("key", F.col("print").alias("a"), F.col("component").alias("of_a"))
    met = strangers.join(rows.select("key", "print", "component"), "key").where((F.col("component") != F.col("of_a")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("print"))) <= radius))
    return met.select("a", F.col("print").alias("b")).distinct()


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Each row of docs as doc_id, fingerprint (long) and component_id, the smallest doc_id that links reach.

    Fingerprints link at radius or fewer differing bits, radius being 4 at most. Words are compared with A-Z in lower
    case; a text of fewer words than a shingle is one shingle. Texts that are null, empty or without words have the
    fingerprint zero, which links like any other. Repeated rows stay. A null doc_id counts as larger than all others; a
    component of null ids only has a null id. Other columns aren't read. An empty table gives no rows.
    """
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"the keys find fingerprints within {RADIUS} bits, not {radius}")
    bound_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)).alias("doc_id"), docs[text_col].alias("text"))
    rows = staged(texts.mapInArrow(lean(_printed(size)), "doc_id long, print long"))
    prints = materialise(rows.groupBy("print").agg(F.min("doc_id").alias("least")))
    first = materialise(leader_links(prints.withColumn("component", F.col("print")), radius))
    labels = components(first)
    placed = materialise(prints.join(labels.hint("merge"), F.col("print") == F.col("node"), "left").select("print", "least", F.coalesce("component", "print").alias("component")))
    release_shuffles(docs.sparkSession)
    second = materialise(stranger_links(placed, radius))
    if second.limit(1).count():
        labels = components(first.union(second))
        placed = prints.join(labels.hint("merge"), F.col("print") == F.col("node"), "left").select("print", "least", F.coalesce("component", "print").alias("component"))
    named = placed.join(placed.groupBy("component").agg(F.min("least").alias("component_id")).hint("merge"), "component").select("print", "component_id")
    out = rows.join(named.hint("merge"), "print")
    own, component = (F.when(F.col(c) != NULL_ID, F.col(c)).alias(c) for c in ("doc_id", "component_id"))
    return out.select(own, F.col("print").alias("fingerprint"), component)


def hexadecimal(fingerprint: str) -> Column:
    """A fingerprint as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))

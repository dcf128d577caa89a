"""Benchmark decontamination by SimHash over item-sized windows.

Every benchmark item has the weighted set of its word shingles and their 64-bit SimHash. A document is read in windows
of as many words as an item has, and windows are fingerprinted by rolling sums. The fingerprints of items are cut into
one block more than the Hamming radius, so that any fingerprint within it agrees in at least one block with the item's;
tables of the blocks find all such items for a window. These candidates are verified: by their distance, and then by
the exact weighted Jaccard similarity of their shingles.

A window that reaches the threshold shares that part of its shingles with one item. So only items of which a document
has so many shingles are looked for in it, and only windows with so many shingles of these items are fingerprinted:
items of other content cost nothing but their place in the tables.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackforge.llm import textops
from trackforge.llm.workers import bound_batches, lean

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 21
BITS = 64
PIECE = 1 << 16  # words of a document whose sums are held at once
MOST_ITEM_BYTES = 64 << 20  # the items go to every executor; more are refused, not cut


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the shingles; a shorter text is one shingle, an empty one has none."""
    return textops.grams(words, min(size, len(words))) if len(words) else words


def signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each hash."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


def fingerprint(totals: np.ndarray) -> np.ndarray:
    """SimHash from the sums of signs, a row for each text."""
    return np.packbits(totals > 0, axis=-1).view("<u8").reshape(totals.shape[:-1])


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of smaller weights over sum of larger weights, a shingle's weight being how often it occurs."""
    x, m = np.unique(a, return_counts=True)
    y, n = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    common = int(np.minimum(m[i], n[j]).sum())
    return common / max(1, len(a) + len(b) - common)


@dataclass
class Benchmark:
    item_ids: np.ndarray
    words: np.ndarray  # of each item
    shingles: list[np.ndarray]
    fingerprints: np.ndarray
    known: np.ndarray  # sorted hashes of all shingles
    holders: np.ndarray  # items that hold the known shingles, one shingle after the other
    held: np.ndarray  # bounds of each known shingle's holders

    @classmethod
    def build(cls, rows: list[tuple[int, str]], size: int) -> "Benchmark":
        ids, counts, sets, prints = [], [], [], []
        for item, text in rows:
            column = pa.array([text or ""])
            words = next(textops.chunks(column)).lowered().word_hashes()[0]
            if len(words):
                ids.append(item)
                counts.append(len(words))
                sets.append(shingle_hashes(words, size))
                prints.append(fingerprint(signs(sets[-1]).sum(0)))
        pairs = [np.unique(s) for s in sets]
        known = np.unique(np.concatenate([*pairs, np.zeros(0, np.uint64)]))
        at = np.searchsorted(known, np.concatenate([*pairs, np.zeros(0, np.uint64)]))
        order = np.argsort(at, kind="stable")
        holders = np.repeat(np.arange(len(pairs)), [len(x) for x in pairs])[order]
        return cls(np.array(ids), np.array(counts, np.int64), sets, np.array(prints, np.uint64), known, holders, np.searchsorted(at[order], np.arange(len(known) + 1)))


class BlockIndex:
    """Fingerprints by the value of each of their blocks: radius + 1 blocks of nearly equal width."""

    CELLS = 1 << 22  # pairs of values and fingerprints that are looked up at once

    def __init__(self, prints: np.ndarray, radius: int) -> None:
        self.prints, self.radius = prints, radius
        edges = np.linspace(0, BITS, radius + 2).round().astype(int)
        self.blocks = [(np.uint64(a), np.uint64((1 << (b - a)) - 1)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        self.tables = [((prints >> shift) & mask)[None, :] == np.arange(int(mask) + 1, dtype=np.uint64)[:, None] for shift, mask in self.blocks]

    def narrowed(self, chosen: np.ndarray) -> "BlockIndex":
        """The index of some of the fingerprints."""
        if len(chosen) == len(self.prints):
            return self
        part = copy.copy(self)
        part.prints, part.tables = self.prints[chosen], [t[:, chosen] for t in self.tables]
        return part

    def agreeing(self, values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a value and a fingerprint, by their numbers, that agree in a block."""
        step = max(1, self.CELLS // max(1, len(self.prints)))
        for a in range(0, len(values), step):
            some = values[a : a + step]
            found = np.zeros((len(some), len(self.prints)), bool)
            for (shift, mask), table in zip(self.blocks, self.tables, strict=True):
                found |= table[((some >> shift) & mask).astype(np.int64)]
            at, of = np.nonzero(found)
            yield at + a, of

    def within(self, values: np.ndarray) -> Iterator[tuple[int, int]]:
        """Pairs of a value and a fingerprint, by their numbers, within the radius."""
        for at, of in self.agreeing(values):
            near = np.bitwise_count(values[at] ^ self.prints[of]) <= self.radius
            yield from zip(at[near].tolist(), of[near].tolist(), strict=True)


class Finder:
    def __init__(self, benchmark: Benchmark, size: int, threshold: float, radius: int) -> None:
        self.b, self.size, self.threshold = benchmark, size, threshold
        self.sized = [(int(n), np.flatnonzero(benchmark.words == n)) for n in np.unique(benchmark.words) if n >= size]
        self.indexes = {n: BlockIndex(benchmark.fingerprints[items], radius) for n, items in self.sized}
        self.short = bool((benchmark.words < size).any())
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(benchmark.known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def _known(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the shingles that stand in any item, and their numbers among the known ones."""
        at = np.flatnonzero(self.filter[(grams & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(at) or not len(self.b.known):
            return at[:0], at[:0]
        place = np.minimum(np.searchsorted(self.b.known, grams[at]), len(self.b.known) - 1)
        same = self.b.known[place] == grams[at]
        return at[same], place[same]

    def _wanted(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A flag for each item of which a document with these known shingles has enough for a copy, and one for each shingle of such an item."""
        sizes = self.b.held[which + 1] - self.b.held[which]
        of = self.b.holders[textops.expand(self.b.held[which], sizes)]
        wanted = np.bincount(of, minlength=len(self.b.words)) >= np.maximum(1, self.threshold * (self.b.words - self.size + 1))
        return wanted, np.logical_or.reduceat(wanted[of], np.concatenate([[0], np.cumsum(sizes)[:-1]]))

    def _copies(self, grams: np.ndarray, hits: np.ndarray, which: np.ndarray) -> dict[int, tuple[float, int]]:
        """For items that a document holds a copy of: best similarity and first word of the first window that has it.

        grams: the document's shingles; hits, which: places of those that stand in any item, and their numbers.
        """
        best: dict[int, tuple[float, int]] = {}
        wanted, of_wanted = self._wanted(which)
        hits = hits[of_wanted]
        sized = [(n, np.flatnonzero(wanted[items]), items) for n, items in self.sized if wanted[items].any()]
        if not sized or not len(hits):
            return best
        longest, whole = sized[-1][0], len(grams)
        for low in range(max(0, int(hits[0]) - longest), min(whole, int(hits[-1]) + 1), PIECE):
            part = grams[low : low + PIECE + longest]
            inside = hits[slice(*np.searchsorted(hits, [low, low + len(part)]))] - low
            before = np.zeros(len(part) + 1, np.int64)
            before[inside + 1] = 1
            before = np.cumsum(before)
            totals = None
            for n, chosen, items in sized:
                width = min(n - self.size + 1, whole)  # a document of fewer words is one window
                least = self.threshold * (n - self.size + 1)
                if width < least or len(inside) < least or width > len(part):
                    continue
                starts = np.flatnonzero(before[width:] - before[: len(before) - width] >= least)
                starts = starts[starts < PIECE]
                if not len(starts):
                    continue
                if totals is None:
                    totals = np.zeros((len(part) + 1, BITS), np.int32)
                    np.cumsum(signs(part), axis=0, dtype=np.int32, out=totals[1:])
                prints = fingerprint(totals[starts + width] - totals[starts])
                for w, i in self.indexes[n].narrowed(chosen).within(prints):
                    start, item = int(starts[w]), int(items[chosen[i]])
                    score = weighted_jaccard(part[start : start + width], self.b.shingles[item])
                    if score >= self.threshold and (item not in best or score > best[item][0]):
                        best[item] = score, start + low
        return best

    def find(self, texts: textops.Texts) -> list[tuple[int, int, float, int]]:
        """Text, item, best similarity, first word of the first window that has it."""
        words, _, _, firsts = texts.lowered().word_hashes()
        whole = textops.grams(words, self.size)
        out = []
        hits, which = self._known(whole)
        text = np.searchsorted(firsts, hits, side="right") - 1
        inside = hits + self.size <= firsts[text + 1]
        hits, which, text = hits[inside], which[inside], text[inside]
        times = np.bincount(text, minlength=len(texts))
        least = self.threshold * (self.sized[0][0] - self.size + 1) if self.sized else np.inf
        for i in np.flatnonzero((times > 0) & (times >= least)).tolist():
            a, b = int(firsts[i]), int(firsts[i + 1])
            mine = slice(*np.searchsorted(text, [i, i + 1]))
            out += [(i, item, *found) for item, found in self._copies(whole[a : b - self.size + 1], hits[mine] - a, which[mine]).items()]
        if self.short:
            out += self._short(words, firsts)
        return sorted(out)

    def _short(self, words: np.ndarray, firsts: np.ndarray) -> list[tuple[int, int, float, int]]:
        """Items, or documents, of fewer words than a shingle: they are one shingle as a whole."""
        out = []
        for item, n in enumerate(self.b.words.tolist()):
            if n < self.size:
                at = np.flatnonzero(textops.grams(words, n) == self.b.shingles[item][0])
                text = np.searchsorted(firsts, at, side="right") - 1
                ok = at + n <= firsts[text + 1]
                _, first = np.unique(text[ok], return_index=True)
                out += [(int(text[ok][k]), item, 1.0, int(at[ok][k] - firsts[text[ok][k]])) for k in first]
        return out


def shared_benchmark(items: DataFrame, item_col: str, text_col: str, size: int) -> Broadcast:
    """The items as a broadcast, which is refused beyond MOST_ITEM_BYTES."""
    small = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("item_id is not null and text is not null")
    weight = small.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if weight > MOST_ITEM_BYTES:
        raise ValueError(f"benchmark items have {weight} bytes; at most {MOST_ITEM_BYTES} can be sent to executors")
    rows = sorted((r.item_id, r.text) for r in small.distinct().collect())
    return items.sparkSession.sparkContext.broadcast(Benchmark.build(rows, size))


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", size: int = SHINGLE, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """A row for each document row and item of which it holds a copy: doc_id, item_id, similarity, first_word.

    Words are compared with A-Z in lower case. Null texts, empty texts and items without words match nothing; an item
    shorter than a shingle matches where its words stand in a row. Repeated document rows each get their rows. Empty
    tables give no rows. Items must be within MOST_ITEM_BYTES; beyond that the call fails rather than leave some out.
    No shuffle; only id and text are read.
    """
    bound_batches(docs.sparkSession)
    shared = shared_benchmark(items, item_col, text_col, size)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value, size, threshold, radius)
        for batch in batches:
            for texts in textops.chunks(batch.column(1)):
                found = finder.find(texts)
                if found:
                    ids = batch.column(0).take(pa.array([texts.first + f[0] for f in found]))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(finder.b.item_ids[[f[1] for f in found]]), pa.array([f[2] for f in found], pa.float64()), pa.array([f[3] for f in found], pa.int64())], names=["doc_id", "item_id", "similarity", "first_word"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(lean(run), f"doc_id {kind}, item_id long, similarity double, first_word long")


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", size: int = SHINGLE, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """The rows of docs, all columns as they are, that hold no copy of an item, as matches() finds them. No shuffle.

    Documents whose text is null, empty or without words stay. Repeated rows all stay or all go. Without items every row
    stays; an empty table gives no rows. Of items only item_col and a column named text are read.
    """
    bound_batches(docs.sparkSession)
    shared = shared_benchmark(items, item_col, "text", size)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value, size, threshold, radius)
        for batch in batches:
            for texts in textops.chunks(batch.column(place)):
                keep = np.ones(len(texts), bool)
                keep[[f[0] for f in finder.find(texts)]] = False
                yield batch.slice(texts.first, len(texts)).filter(pa.array(keep))

    return docs.mapInArrow(lean(run), docs.schema)

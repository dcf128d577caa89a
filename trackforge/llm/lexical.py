"""Ranked lexical search by a bit-sliced impact index.

Documents are indexed in blocks, each with its documents in the order of their ids: how often the queries' terms occur
in them, and how long they are. Once the corpus counts are known, what a term adds to a document's score is an integer,
its impact. A term's impacts in a block are stored as bitmaps, one for each bit of the numbers, with a bit for each
document. A query adds the bitmaps of its terms by full adders, all documents of a block and all bits at once, and
carries ripple through the slices at the end. The top k are found by going down from the most significant slice,
keeping the documents that have its bit as long as there are enough. Tasks keep the best of all their blocks; the best
of the tasks are ranked together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackforge.llm import textops
from trackforge.llm.durable import staged
from trackforge.llm.jaccard_join import NULL_ID
from trackforge.llm.packing import pack, unpack
from trackforge.llm.workers import bound_batches, lean

TERM_BYTES = np.zeros(256, bool)  # [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    TERM_BYTES[_a:_b] = True
BLOCK = 1 << 12  # documents of a block
BLOCK_ENTRIES = 1 << 21  # pairs of a document and a term after which a block ends early
SLICE_BYTES = 64 << 20  # bitmaps that a task holds at once; others are made anew
MOST_QUERY_BYTES = 64 << 20  # the queries go to every executor; more are refused, not cut
SALTS = 64


@dataclass
class Queries:
    """Queries as numbers of terms with how often each occurs; hashes of the terms in ascending order."""

    ids: list[int | None]
    terms: list[np.ndarray]
    times: list[np.ndarray]
    hashes: np.ndarray

    @classmethod
    def build(cls, rows: list[tuple[int | None, str]]) -> "Queries":
        found = [term_hashes(next(textops.chunks(pa.array([text]))))[0] for _, text in rows]
        hashes = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]))
        counted = [np.unique(np.searchsorted(hashes, h), return_counts=True) for h in found]
        return cls([i for i, _ in rows], [t for t, _ in counted], [c for _, c in counted], hashes)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the terms with these hashes, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


def term_hashes(texts: textops.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms, A-Z in lower case, and each text's bounds among them."""
    hashes, _, _, firsts = texts.lowered().word_hashes(TERM_BYTES)
    return hashes, firsts


def _blocks(shared: Broadcast):
    """doc_id, text -> blocks (docs, length, terms, holders, blob); docs and length count all documents with terms.

    terms, holders: each term of the block and the number of its documents. blob: ids and lengths of the documents that
    hold any, and entries (document, term, occurrences) by term and document.
    """

    def row(ids: list, sizes: list, entries: list, docs: int, length: int) -> pa.RecordBatch:
        ids, sizes = np.concatenate([np.zeros(0, np.int64), *ids]), np.concatenate([np.zeros(0, np.int64), *sizes])
        doc, term, times = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*entries, strict=True) if entries else ([], [], [])))
        by_id = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[by_id] = np.arange(len(ids))
        order = np.lexsort((place[doc], term))
        doc, term, times = place[doc][order], term[order], times[order]
        terms, holders = np.unique(term, return_counts=True)
        blob = pack(ids[by_id], sizes[by_id], doc.astype(np.int32), term.astype(np.int32), times)
        return pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([length]), pa.array([terms.tolist()], pa.list_(pa.int32())), pa.array([holders.tolist()], pa.list_(pa.int64())), pa.array([blob], pa.binary())], names=["docs", "length", "terms", "holders", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        ids, sizes, entries, held, n, docs, length = [], [], [], 0, 0, 0, 0
        for batch in batches:
            doc_ids = batch.column(0).to_numpy()
            for texts in textops.chunks(batch.column(1)):
                hashes, bounds = term_hashes(texts)
                size = np.diff(bounds)
                docs, length = docs + int((size > 0).sum()), length + len(hashes)
                number = queries.numbers(hashes)
                at = np.flatnonzero(number >= 0)
                text = np.searchsorted(bounds, at, side="right") - 1
                pairs, times = np.unique(text * np.int64(len(queries.hashes) + 1) + number[at], return_counts=True)
                text, term = np.divmod(pairs, np.int64(len(queries.hashes) + 1))
                there, text = np.unique(text, return_inverse=True)
                ids.append(doc_ids[texts.first + there])
                sizes.append(size[there])
                entries.append((text + held, term, times))
                held, n = held + len(there), n + len(times)
                if held >= BLOCK or n >= BLOCK_ENTRIES:
                    yield row(ids, sizes, entries, docs, length)
                    ids, sizes, entries, held, n, docs, length = [], [], [], 0, 0, 0, 0
        if docs:
            yield row(ids, sizes, entries, docs, length)

    return run


def impact_slices(values: np.ndarray, at: np.ndarray, docs: int) -> np.ndarray:
    """Bitmaps of numbers above 0: a row for each bit from the least on, a bit in 64-bit words for each document.

    values: the numbers of the documents at, all others have 0.
    """
    width = -(-docs // 64) * 64
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, count=int(values.max()).bit_length(), bitorder="little")
    rows = np.zeros((bits.shape[1], width), np.uint8)
    rows[:, at] = bits.T
    return np.packbits(rows, axis=1, bitorder="little").view("<u8")


class Sum:
    """A number for each document as bitmaps, in the carry-save form: the numbers are ones + carries."""

    def __init__(self, bits: int, words: int) -> None:
        self.ones, self.carries = np.zeros((bits, words), np.uint64), np.zeros((bits, words), np.uint64)

    def add(self, slices: np.ndarray, shift: int) -> None:
        """Adds numbers times two to the power of shift; the sum must fit into the bits."""
        part = np.zeros_like(self.ones)
        part[shift : shift + len(slices)] = slices
        either = self.ones ^ self.carries
        carry = (self.ones & self.carries) | (either & part)
        self.ones = either ^ part
        self.carries[1:] = carry[:-1]
        self.carries[0] = 0

    def slices(self) -> np.ndarray:
        """The numbers' own bits, after the last carries have rippled through."""
        out, carry = np.empty_like(self.ones), np.zeros_like(self.ones[0])
        for row, (a, b) in enumerate(zip(self.ones, self.carries, strict=True)):
            either = a ^ b
            out[row] = either ^ carry
            carry = (a & b) | (either & carry)
        return out


def top(slices: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the k highest numbers above 0, or of all if there are fewer; of equal ones the first places."""
    sure, open_ = np.zeros_like(slices[0]), np.bitwise_or.reduce(slices, axis=0)
    if int(np.bitwise_count(open_).sum()) > k:
        for row in slices[::-1]:
            having = open_ & row
            n = int(np.bitwise_count(sure | having).sum())
            if n > k:
                open_ = having
            else:
                sure |= having
                open_ = open_ & ~row
                if n == k:
                    open_ = np.zeros_like(sure)
                    break
    places = [np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little")) for x in (sure, open_)]
    found = np.concatenate([places[0], places[1][: k - len(places[0])]])
    bits = (slices[:, found >> 6] >> (found & 63).astype(np.uint64)) & np.uint64(1)
    return found, (bits << np.arange(len(slices), dtype=np.uint64)[:, None]).sum(0, dtype=np.uint64).astype(np.int64)


class Corpus:
    """Number of documents with terms, of their terms, and the weight of each term."""

    def __init__(self, docs: int, length: int, holders: np.ndarray) -> None:
        self.docs, self.length = docs, length
        self.weights = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1))) for df in holders.tolist()], np.int64)

    def impacts(self, term: np.ndarray, times: np.ndarray, size: np.ndarray) -> np.ndarray:
        different, of = np.unique(size, return_inverse=True)
        middle = np.array([100 - 25 + 25 * n * self.docs // self.length for n in different.tolist()], np.int64)[of]
        return self.weights[term] * (1_000_000_000 * times // (1000 * times + 12 * middle))


class Block:
    """The bit-sliced index of a block's documents; the bitmaps of a term are made when a query asks for it first."""

    def __init__(self, blob: bytes, corpus: Corpus) -> None:
        self.ids, sizes, self.doc, term, times = unpack(blob)
        self.impacts = corpus.impacts(term, times, sizes[self.doc])
        kept = self.impacts > 0
        self.doc, self.impacts, term = self.doc[kept], self.impacts[kept], term[kept]
        edges = np.flatnonzero(np.diff(term, prepend=-1, append=-1)).tolist()
        self.span = {int(term[a]): (a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)}
        self.most = {t: int(self.impacts[a:b].max()) for t, (a, b) in self.span.items()}
        self.made: dict[int, np.ndarray] = {}
        self.room = SLICE_BYTES

    def slices(self, term: int) -> np.ndarray:
        if term not in self.made:
            a, b = self.span[term]
            made = impact_slices(self.impacts[a:b], self.doc[a:b], len(self.ids))
            if self.room < made.nbytes:
                self.made.clear()
                self.room = SLICE_BYTES
            self.room -= made.nbytes
            self.made[term] = made
        return self.made[term]

    def best(self, terms: list[int], times: list[int], k: int, least: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and scores of the k best documents; None if none can reach least."""
        there = [(t, n) for t, n in zip(terms, times, strict=True) if t in self.span]
        bound = sum(self.most[t] * n for t, n in there)
        if not there or bound < least:
            return None
        total = Sum(bound.bit_length(), -(-len(self.ids) // 64))
        for term, n in there:
            for shift in range(n.bit_length()):
                if n >> shift & 1:
                    total.add(self.slices(term), shift)
        at, scores = top(total.slices(), k)
        return self.ids[at], scores


def _searched(shared: Broadcast, corpus: Broadcast, k: int):
    """blob -> the k best documents of a task for each query: query (its number), doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = shared.value
        wanted = [(t.tolist(), n.tolist()) for t, n in zip(queries.terms, queries.times, strict=True)]
        none = np.zeros(0, np.int64)
        best = [(none, none)] * len(wanted)
        for batch in batches:
            for blob in batch.column(0):
                block = Block(blob.as_py(), corpus.value)
                for q, (terms, times) in enumerate(wanted):
                    ids, scores = best[q]
                    found = block.best(terms, times, k, int(scores[-1]) if len(scores) == k else 1)
                    if found:
                        ids, scores = np.concatenate([ids, found[0]]), np.concatenate([scores, found[1]])
                        order = np.lexsort((ids, -scores))[:k]
                        best[q] = ids[order], scores[order]
        columns = [np.full(len(ids), q) for q, (ids, _) in enumerate(best)], [ids for ids, _ in best], [scores for _, scores in best]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *c])) for c in columns], names=["query", "doc_id", "score"])

    return run


def shared_queries(items: DataFrame, item_col: str, text_col: str) -> Broadcast:
    """The queries as a broadcast, which is refused beyond MOST_QUERY_BYTES."""
    small = items.select(items[item_col].cast("long").alias("id"), F.coalesce(items[text_col], F.lit("")).alias("text"))
    weight = small.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    if weight > MOST_QUERY_BYTES:
        raise ValueError(f"queries have {weight} bytes; at most {MOST_QUERY_BYTES} can be sent to executors")
    return items.sparkSession.sparkContext.broadcast(Queries.build([(r.id, r.text) for r in small.distinct().collect()]))


def rank(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k highest-scoring rows of docs for each item, equal scores by ascending doc_id.

    Terms are runs of letters a-z, digits and all beyond ASCII, with A-Z in lower case, told apart by 64-bit hashes.
    Null and empty texts have none; items without terms, or whose terms no document has, get no rows. Each row of docs
    is a document, so repeated rows stand side by side; a null doc_id counts as larger than all others. Items of one id
    and text are one item; texts that share an id are ranked each on its own. Empty tables give no rows. Only ids and
    texts are read. Items must be within MOST_QUERY_BYTES; beyond that the call fails rather than leave some out.
    """
    bound_batches(docs.sparkSession)
    shared = shared_queries(items, item_col, item_text_col)
    queries: Queries = shared.value
    texts = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)).alias("doc_id"), docs[text_col].alias("text"))
    index = staged(texts.mapInArrow(lean(_blocks(shared)), "docs long, length long, terms array<int>, holders array<long>, blob binary"))
    size = index.agg(F.sum("docs").alias("docs"), F.sum("length").alias("length")).first()
    holders = np.zeros(len(queries.hashes), np.int64)
    for r in index.select(F.explode(F.arrays_zip("terms", "holders")).alias("t")).groupBy("t.terms").agg(F.sum("t.holders").alias("n")).collect():
        holders[r[0]] = r[1]  # at most one for each term of the queries
    corpus = docs.sparkSession.sparkContext.broadcast(Corpus(size.docs or 0, size.length or 0, holders))
    best = index.select("blob").mapInArrow(lean(_searched(shared, corpus, k)), "query long, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id")]
    best = best.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("query", "salt").orderBy(*order))).where(F.col("rank") <= k)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
    ids = docs.sparkSession.createDataFrame(list(enumerate(queries.ids)), "query long, item_id long")
    return best.join(F.broadcast(ids), "query").select("item_id", "rank", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), "score")

"""Language-model scoring by a hidden Markov model over tokens.

Tokens are lower-cased words and one end per document. Every state emits classes: each of the most frequent tokens is
a class of its own, all others fall into RARE_CLASSES by hash and share their class's probability by their counts
(count + 1, out of the class's tokens + its distinct tokens + 1). So the states' tables are bounded, while the counts
that every probability rests on are those of the whole training set, held as a distributed table.

Baum-Welch: states start from the counts of the corpus, each disturbed by a seeded factor for each class; every round
goes over all training documents, kept as class numbers, and its expected counts are summed in each task and added up
across partitions block by block. Scores are exact likelihoods by the scaled forward recursion
over whole documents. Counts of rare tokens meet documents in buckets of packed arrays, each (document, token) once.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trackforge.llm import textops
from trackforge.llm.durable import materialise, release_shuffles, staged
from trackforge.llm.packing import by_bucket, compressed, expanded, merged, pack, rows_of, stream_of, table_of, unpack
from trackforge.llm.repeats import _bucket, _key, _text_tags
from trackforge.llm.workers import bound_batches, lean, lean_group

STATES = 8
FREQUENT = 1 << 16
RARE_CLASSES = 256
ROUNDS = 14  # over all training documents
SCALED_EVERY = 8  # places; between them values can't leave the range of 32-bit numbers
CHUNK_TOKENS = 1 << 18  # that train at once
MOST_TOKENS = 1 << 19  # of longer documents; one that is longer still trains alone
STEPS_AT_ONCE = 100
HELD_SYMBOLS = 1 << 21  # of texts that are put in order of size together
ADDED_AT_ONCE = 64  # partitions whose counts one task adds up
HELD_TOKENS = 1_500_000
BLOCKS = 64
END = np.uint64(0x5DEECE66D1234567)  # hash of the end token


def token_hashes(texts: textops.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, ends included, and the first token of each text with one more."""
    words, _, _, firsts = texts.lowered().word_hashes()
    bounds = firsts + np.arange(len(firsts))
    out = np.empty(bounds[-1], np.uint64)
    out[bounds[1:] - 1] = END
    out[textops.expand(bounds[:-1], np.diff(firsts))] = words
    return out, bounds


@dataclass
class Classes:
    """frequent: sorted hashes of the tokens that are classes, with counts; stats of the rare classes."""

    frequent: np.ndarray
    counts: np.ndarray
    rare_tokens: np.ndarray
    rare_distinct: np.ndarray

    @property
    def size(self) -> int:
        return len(self.frequent) + RARE_CLASSES

    def of(self, tokens: np.ndarray) -> np.ndarray:
        rare = len(self.frequent) + (tokens % np.uint64(RARE_CLASSES)).astype(np.int64)
        if not len(self.frequent):
            return rare
        at = np.minimum(np.searchsorted(self.frequent, tokens), len(self.frequent) - 1)
        return np.where(self.frequent[at] == tokens, at, rare)

    def shares(self) -> np.ndarray:
        n = np.concatenate([self.counts, self.rare_tokens]) + 1.0
        return n / n.sum()


class Room:
    """Arrays that are used again from chunk to chunk, so that their memory is asked for once."""

    def __init__(self) -> None:
        self.held: dict[str, np.ndarray] = {}

    def of(self, name: str, shape: tuple[int, ...], kind: type) -> np.ndarray:
        size = int(np.prod(shape))
        if name not in self.held or len(self.held[name]) < size:
            self.held[name] = np.empty(size, kind)
        return self.held[name][:size].reshape(shape)


@dataclass
class Markov:
    start: np.ndarray
    moves: np.ndarray
    emits: np.ndarray  # class x state

    @functools.cached_property
    def relative_emits(self) -> np.ndarray:
        """Each class's emissions out of its largest."""
        return (self.emits / self.emits.max(1, keepdims=True)).astype(np.float32)

    def smoothed(self, start: np.ndarray, moves: np.ndarray, emits: np.ndarray, shares: np.ndarray) -> "Markov":
        k = len(start)
        start, moves = start + 1 / k, moves + 1 / k + np.eye(k)
        emits = emits + shares[:, None] * (2.0 + 0.02 * emits.sum(0))
        return Markov(start / start.sum(), moves / moves.sum(1, keepdims=True), emits / emits.sum(0))

    def forward(self, at: np.ndarray, steps: Steps) -> np.ndarray:
        """log10 of the probability of each sequence. at: symbols in the order of steps."""
        top = self.emits.max(1)
        emitted = (self.emits / top[:, None])[at]
        alpha, ones, spans = None, np.ones(len(self.start)), steps.spans()
        total = np.bincount(steps.rank(), np.log10(top)[at], len(steps.sizes))
        for t, (a, b, n) in enumerate(spans):
            alpha = (self.start if t == 0 else alpha[:n] @ self.moves) * emitted[a:b]
            if t % SCALED_EVERY == 0 or t + 1 == len(spans) or spans[t + 1][2] < n:
                scale = alpha @ ones
                alpha /= scale[:, None]
                total[:n] += np.log10(scale)
        return total

    def expected(self, at: np.ndarray, steps: Steps, classes: int, room: Room | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of starts, moves and emissions. at: symbols in the order of steps.

        Forward values are scaled every few places and backward values by the same factors, so that their products are
        the same, up to one factor for each sequence, at all of its places; backward values start from its inverse.
        """
        k, room, at = len(self.start), room or Room(), at.astype(np.int64)
        emitted, alphas, betas = (room.of(name, (len(at), k), np.float32) for name in ("emitted", "alphas", "betas"))
        np.take(self.relative_emits, at, axis=0, out=emitted, mode="clip")
        start, moves, back = self.start.astype(np.float32), self.moves.astype(np.float32), np.ascontiguousarray(self.moves.T.astype(np.float32))
        ones, spans, scales = np.ones(k, np.float32), steps.spans(), {}
        before = None
        for t, (a, b, n) in enumerate(spans):
            alpha = alphas[a:b]
            if t == 0:
                np.multiply(emitted[a:b], start, out=alpha)
            else:
                np.matmul(before[:n], moves, out=alpha)
                alpha *= emitted[a:b]
            if t % SCALED_EVERY == 0:
                scales[t] = (1 / (alpha @ ones))[:, None]
                alpha *= scales[t]
            before = alpha
        last = steps.last()
        betas[last] = (1 / (alphas[last] @ ones))[:, None]
        counted = np.zeros((k, k), np.float32)
        sums = np.zeros((k, k))
        for t in range(len(spans) - 2, -1, -1):
            a, (c, d, m) = spans[t][0], spans[t + 1]
            ahead = emitted[c:d]
            ahead *= betas[c:d]
            if t + 1 in scales:
                ahead *= scales[t + 1]
            np.matmul(ahead, back, out=betas[a : a + m])
            np.matmul(alphas[a : a + m].T, ahead, out=counted)
            sums += counted
        alphas *= betas  # now the probability of each state
        shares = room.of("shares", (k, len(at)), np.float64)
        np.copyto(shares, alphas.T)
        return shares[:, : steps.active[0]].sum(1), sums * self.moves, np.array([np.bincount(at, x, classes) for x in shares]).T


class Steps:
    """The places of sequences in the order of their distance from the start; within it, in the order of the sequences.

    sizes: of the sequences, the longest first; none is empty.
    """

    def __init__(self, sizes: np.ndarray) -> None:
        self.sizes = sizes
        self.active = np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left")
        self.offsets = np.concatenate([[0], np.cumsum(self.active)])

    def places(self, starts: np.ndarray) -> np.ndarray:
        """Where each place's symbol stands, if the sequences begin at starts."""
        return starts[self.rank()] + np.repeat(np.arange(len(self.active)), self.active)

    def rank(self) -> np.ndarray:
        """The sequence of each place."""
        return np.arange(self.offsets[-1]) - np.repeat(self.offsets[:-1], self.active)

    def spans(self) -> list[tuple[int, int, int]]:
        """For each distance the first place, the one after the last, and their number."""
        return list(zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), self.active.tolist(), strict=True))

    def last(self) -> np.ndarray:
        """The last place of each sequence."""
        return self.offsets[self.sizes - 1] + np.arange(len(self.sizes))


def arranged(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, Steps, np.ndarray]]:
    """Numbers of some sequences at a time, their steps, and their symbols in the order of steps; like sizes come together."""
    order = np.argsort(-sizes, kind="stable")
    total = np.concatenate([[0], np.cumsum(sizes[order])])
    first = 0
    while first < len(order):
        # longer sequences take more steps, which pays for more of them at once
        room = min(max(CHUNK_TOKENS, STEPS_AT_ONCE * int(sizes[order[first]])), MOST_TOKENS)
        last = max(first + 1, int(np.searchsorted(total, total[first] + room, side="right")) - 1)
        some = order[first:last]
        steps = Steps(sizes[some])
        yield some, steps, symbols[steps.places(starts[some])]
        first = last


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """texts -> rows (token, n), each token once for each task as far as memory allows."""
    held, size = [], 0

    def summed() -> tuple[np.ndarray, np.ndarray]:
        tokens, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(tokens)
        tokens = tokens[order]
        heads = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        return tokens[heads], np.add.reduceat(n[order], heads)

    def row(tokens: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n)], names=["token", "n"])

    for batch in batches:
        for texts in textops.chunks(batch.column(0)):
            unique, n = np.unique(token_hashes(texts)[0], return_counts=True)
            held.append((unique, n))
            size += len(unique)
            if size > HELD_TOKENS:
                held = [summed()]
                size = len(held[0][0])
                if size > HELD_TOKENS // 2:
                    yield row(*held[0])
                    held, size = [], 0
    if held:
        yield row(*summed())


PREPARED = "held_out boolean, sizes binary, symbols binary, texts binary, bucket int, blob binary"


def _prepared(classes: Classes, buckets: int, fields: pa.Schema) -> Callable:
    """id, text, doc_id, held_out -> rows of some texts each, and rows (bucket, blob of token, row, times) of rare tokens.

    Texts that train and those held out come apart. Their row holds the sizes of the sequences of symbols, longest first,
    the symbols in the order of steps, and as an Arrow stream in the order of the sequences: doc_id, row (a key),
    n_tokens, known (tokens of frequent classes that are known), logs (of their counts), share (logs of the shares of
    rare classes).
    """
    log_count = np.log10(np.concatenate([classes.counts + 1.0, np.ones(RARE_CLASSES)]))
    log_share = np.concatenate([np.zeros(len(classes.frequent)), -np.log10(classes.rare_tokens + classes.rare_distinct + 1.0)])
    known = np.concatenate([classes.counts > 0, np.zeros(RARE_CLASSES, bool)]).astype(np.int64)

    def padded(columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in fields], schema=fields)

    def rare_rows(held: list[tuple]) -> pa.RecordBatch:
        tokens, rows, times = (np.concatenate(x) for x in zip(*held, strict=True))
        packed = rows_of("bucket", [(b, pack(tokens[part], rows[part], times[part])) for b, part in by_bucket(_bucket(tokens, buckets))])
        return padded({"bucket": packed.column(0), "blob": packed.column(1)}, packed.num_rows)

    def text_rows(held_out: bool, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        symbols, sizes, texts = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), pa.Table.from_batches([x[2] for x in held]).combine_chunks()
        for some, steps, at in arranged(symbols, np.cumsum(sizes) - sizes, sizes):
            blobs = {"sizes": pack(steps.sizes.astype(np.int32)), "symbols": compressed(at), "texts": stream_of(texts.take(pa.array(some)))}
            yield padded({"held_out": pa.array([held_out])} | {k: pa.array([v], pa.binary()) for k, v in blobs.items()}, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare, size = [], 0
        held, room = {True: [], False: []}, {True: 0, False: 0}
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for texts in textops.chunks(batch.column(1)):
                own = slice(texts.first, texts.first + len(texts))
                tokens, bounds = token_hashes(texts)
                symbols = classes.of(tokens).astype(np.int32)
                row = _key(ids[own], _text_tags(texts))
                sums = [np.add.reduceat(x[symbols], bounds[:-1]) for x in (known, log_count, log_share)]
                columns = [batch.column(2).slice(texts.first, len(texts)), *(pa.array(x) for x in (row.view(np.int64), np.diff(bounds), *sums))]
                whole = pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "n_tokens", "known", "logs", "share"])
                out = batch.column(3).slice(texts.first, len(texts)).to_numpy(zero_copy_only=False).astype(bool)
                for flag in (True, False):
                    at = np.flatnonzero(out == flag)
                    if len(at):
                        n = np.diff(bounds)[at]
                        held[flag].append((symbols[textops.expand(bounds[at], n)], n, whole.take(pa.array(at))))
                        room[flag] += int(n.sum())
                    if room[flag] >= HELD_SYMBOLS:
                        yield from text_rows(flag, held[flag])
                        held[flag], room[flag] = [], 0
                at = np.flatnonzero(symbols >= len(classes.frequent))
                if not len(at):
                    continue
                own_tokens, own_bounds = tokens[at], np.searchsorted(at, bounds)
                textops.sort_within(own_tokens, own_bounds)
                new = np.append(True, own_tokens[1:] != own_tokens[:-1])
                new[own_bounds[:-1][np.diff(own_bounds) > 0]] = True
                text, new = np.repeat(row, np.diff(own_bounds)), np.flatnonzero(new)
                rare.append((own_tokens[new], text[new], np.diff(np.append(new, len(at))).astype(np.int32)))
                size += len(new)
                if size > HELD_TOKENS:
                    yield rare_rows(rare)
                    rare, size = [], 0
        for flag in (True, False):
            if held[flag]:
                yield from text_rows(flag, held[flag])
        if rare:
            yield rare_rows(rare)

    return run


def _steps_of(sizes: pa.Scalar, symbols: pa.Scalar) -> tuple[np.ndarray, Steps]:
    """Symbols in the order of steps, and the steps, from a row of _prepared."""
    steps = Steps(unpack(sizes.as_py())[0].astype(np.int64))
    return expanded(symbols.as_buffer(), np.int32), steps


def _expectations(size: int, model: Markov) -> Callable:
    """sizes and symbols of rows of _prepared -> rows (block, blob): expected counts of one task, by block of classes; block -1 has starts and moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, room = None, Room()
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                found = model.expected(*_steps_of(*row), size, room)
                if total is None:
                    total = found
                else:
                    for whole, part in zip(total, found, strict=True):
                        whole += part
        if total is not None:
            rows = [(-1, np.concatenate([total[0], total[1].ravel()]).tobytes())]
            rows += [(i, part.astype(np.float32).tobytes()) for i, part in enumerate(np.array_split(total[2], BLOCKS))]
            yield rows_of("block", rows)

    return run


def _added(kind: type) -> Callable:
    """rows (block, blob of kind) of a block -> their sum."""

    def run(rows: pa.Table) -> pa.Table:
        block = rows.column("block")[0].as_py()
        total = 0.0
        for blob in rows.column("blob"):
            total = total + np.frombuffer(blob.as_buffer(), np.float64 if block < 0 else kind)
        return table_of("block", [(block, np.asarray(total, np.float64).tobytes())])

    return run


def first_model(classes: Classes, states: int) -> Markov:
    """States that stay as they are, each with the shares of the corpus disturbed by factors between 0 and 2."""
    emits = classes.shares()[:, None] * np.random.default_rng(3).uniform(0, 2, (classes.size, states))
    return Markov(np.full(states, 1 / states), np.full((states, states), 0.02 / states) + 0.98 * np.eye(states), emits / emits.sum(0))


def _forward(model: Markov) -> Callable:
    """held_out, sizes, symbols, texts of rows of _prepared -> each text's row with score, its log10 probability but for rare counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held_out, sizes, symbols, texts in zip(*batch.columns, strict=True):
                found = pa.ipc.open_stream(texts.as_buffer()).read_all().combine_chunks().to_batches()[0]
                score = model.forward(*_steps_of(sizes, symbols)) + found.column("share").to_numpy()
                yield pa.RecordBatch.from_arrays([found.column("doc_id"), pa.array([held_out.as_py()] * found.num_rows), *(found.column(c) for c in ("row", "n_tokens", "known", "logs")), pa.array(score)], names=["doc_id", "held_out", "row", "n_tokens", "known", "logs", "score"])

    return run


def _looked_up(parts: int) -> Callable:
    """(rare tokens of a bucket, counts of its tokens) -> rows (part, blob of row, sum of logs, known)."""

    def run(rare: pa.Table, counts: pa.Table) -> pa.Table:
        if not rare.num_rows:
            return table_of("part", [])
        tokens, rows, times = merged(rare.column("blob"))
        order = np.lexsort((tokens, rows))
        tokens, rows, times = tokens[order], rows[order], times[order]
        once = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (rows[1:] != rows[:-1])])  # equal rows of docs
        tokens, rows, times = tokens[once], rows[once], times[once]
        known, n = counts.column("token").to_numpy().astype(np.int64).view(np.uint64), counts.column("n").to_numpy().astype(np.int64)
        order = np.argsort(known)
        known, n = known[order], n[order]
        count = np.zeros(len(tokens), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
            count = np.where(known[at] == tokens, n[at], 0)
        heads = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        logs, seen = np.add.reduceat(np.log10(count + 1.0) * times, heads), np.add.reduceat((count > 0) * times, heads)
        out = []
        for p, part in by_bucket(_bucket(rows[heads], parts)):
            out.append((p, pack(rows[heads][part], logs[part], seen[part].astype(np.int32))))
        return table_of("part", out)

    return run


def _summed(rows: pa.Table) -> pa.Table:
    row, logs, seen = merged(rows.column("blob"))
    unique, inverse = np.unique(row, return_inverse=True)
    return pa.table({"row": unique.view(np.int64), "rare_logs": np.bincount(inverse, logs, len(unique)), "rare_known": np.bincount(inverse, seen, len(unique)).astype(np.int64)})


def often(counts: DataFrame, wanted: int) -> DataFrame:
    """The rows of counts among which the wanted most frequent are: all from the power of two on that gives enough."""
    powers = counts.groupBy(F.floor(F.log2(F.col("n"))).cast("int").alias("power")).agg(F.count("*").alias("n")).orderBy(F.desc("power")).collect()
    seen, least = 0, 0
    for r in powers:  # at most 64
        seen, least = seen + r.n, r.power
        if seen >= wanted:
            break
    return counts.where(F.col("n") >= 2**least)


def learn_classes(counts: DataFrame, frequent: int) -> tuple[Classes, int, int]:
    """Classes from the counts of all training tokens; number of tokens, of distinct ones."""
    top = often(counts, frequent).orderBy(F.desc("n"), "token").limit(frequent).toArrow()
    hashes, n = top.column("token").to_numpy().astype(np.int64).view(np.uint64), top.column("n").to_numpy().astype(np.int64)
    if not (hashes == END).any():  # the end is a class of its own, even if rarer than others
        hashes, n = np.append(hashes[: frequent - 1], END), np.append(n[: frequent - 1], counts.where(F.col("token") == int(END.astype(np.int64))).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    order = np.argsort(hashes)
    hashes, n = hashes[order], n[order]
    rare_class = F.pmod(F.col("token"), F.lit(RARE_CLASSES))  # RARE_CLASSES divides 2**64, so signed and unsigned agree
    sums = counts.groupBy(rare_class.alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    tokens, distinct = np.zeros(RARE_CLASSES, np.int64), np.zeros(RARE_CLASSES, np.int64)
    for r in sums:
        tokens[r.c], distinct[r.c] = r.n, r.v
    total, kinds = int(tokens.sum()), int(distinct.sum())
    own = (hashes % np.uint64(RARE_CLASSES)).astype(np.int64)
    np.subtract.at(tokens, own, n)
    np.subtract.at(distinct, own, (n > 0).astype(np.int64))
    return Classes(hashes, n, tokens, distinct), total, kinds


def train_model(numbered: DataFrame, classes: Classes, states: int, rounds: int) -> Markov:
    """Baum-Welch over all rows of numbered (sizes, symbols)."""
    model, shares = first_model(classes, states), classes.shares()
    groups = -(-numbered.rdd.getNumPartitions() // ADDED_AT_ONCE) if rounds else 1
    for _ in range(rounds):
        sums, kind = numbered.mapInArrow(lean(_expectations(classes.size, model)), "block int, blob binary"), np.float32
        if groups > 1:
            sums = sums.groupBy("block", F.pmod(F.spark_partition_id(), F.lit(groups)).alias("of")).applyInArrow(_added(kind), "block int, blob binary")
            kind = np.float64
        rows = sums.groupBy("block").applyInArrow(_added(kind), "block int, blob binary").collect()
        parts = {r.block: np.frombuffer(bytes(r.blob)) for r in rows}
        if -1 in parts:
            emits = np.concatenate([parts[i].reshape(-1, states) for i in range(BLOCKS)])
            model = model.smoothed(parts[-1][:states], parts[-1][states:].reshape(states, states), emits, shares)
        release_shuffles(numbered.sparkSession)
    return model


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, frequent: int = FREQUENT, rounds: int = ROUNDS, buckets: int | None = None) -> DataFrame:
    """Each row of docs with held_out, n_tokens, n_known, train_tokens, base_score and score, as log10 probabilities.

    Learns from the rows for which held_out is false or null. A null text is empty: one token, the end. Repeated rows
    count in training as often as they come, and each is scored. Without training rows, base_score is 0 and the model
    uniform. An empty table gives no rows; columns other than id and text (and what held_out reads) aren't read.
    Tokens are told apart by 64-bit hashes. Texts are read twice: to count tokens, and then to number them; the numbers
    are written once, for all rounds and the scores.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    buckets = buckets or 2 * int(spark.conf.get("spark.sql.shuffle.partitions")) + 1
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = materialise(rows.where(~F.col("held_out")).select("text").mapInArrow(lean(_count), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")))
    classes, total, kinds = learn_classes(counts, frequent)
    kind = dict(docs.dtypes)[id_col]
    prepared = staged(rows.mapInArrow(lean(_prepared(classes, buckets, to_arrow_schema(T.StructType.fromDDL(PREPARED)))), PREPARED))
    texts = prepared.where("symbols is not null")
    model = train_model(texts.where("not held_out").select("sizes", "symbols"), classes, states, rounds)
    forward = texts.select("held_out", "sizes", "symbols", "texts").mapInArrow(lean(_forward(model)), f"doc_id {kind}, held_out boolean, row long, n_tokens long, known long, logs double, score double")
    token = F.col("token")
    # the token's unsigned value modulo buckets, from its halves
    half = F.pmod(F.pmod(F.shiftrightunsigned(token, 32), F.lit(buckets)) * ((1 << 32) % buckets) + token.bitwiseAND(0xFFFFFFFF), F.lit(buckets))
    by_token = counts.select(half.cast("int").alias("bucket"), "token", "n").groupBy("bucket")
    rare = prepared.where("blob is not null").select("bucket", "blob").groupBy("bucket")
    found = rare.cogroup(by_token).applyInArrow(lean_group(_looked_up(buckets)), "part int, blob binary")
    sums = found.groupBy("part").applyInArrow(_summed, "row long, rare_logs double, rare_known long")
    logs = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0))
    return forward.join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.log10(F.lit(float(total + kinds + 1)))).alias("base_score"),
        (F.col("score") + F.coalesce("rare_logs", F.lit(0.0))).alias("score"),
    )

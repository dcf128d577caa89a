"""Language ID by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary (single bytes included, so that any word
can be spelt). A word's probability is the sum over all its segmentations into pieces, by a forward algorithm; a
text's is the product over its words and the language's share of the training rows. The piece probabilities are
fitted by expectation-maximisation, whose expected counts come from the forward and backward sums.

The fit uses all words of at most sample_rows labelled rows of each language, chosen by a hash of their id: the bound
is a parameter. The list of languages and their shares come from all labelled rows. Word counts stay distributed: each
round adds up expected counts within tasks and then across them. Words of more than PART bytes are fitted in parts,
cut between characters. Everything else covers all rows.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackforge.llm import textops
from trackforge.llm.durable import materialise
from trackforge.llm.packing import rows_of, table_of
from trackforge.llm.workers import bound_batches, kept, lean

SAMPLE_ROWS = 4_000
PART = 40  # bytes of a word that are fitted at once
MAX_PIECE = 16
LONG_WORD, FEW_ROWS = 256, 64  # words longer than this are scored one by one, if there are few of a length
SEGMENT = 1 << 15  # bytes of a long word whose pieces are looked up at once
MOST_LANGUAGES = 500  # the model has a column for each and goes to every executor; more are refused, not cut
CHUNK = 1 << 20  # bytes of text whose words are looked up at once
ROUNDS = 3
SMOOTHING = 0.02  # uses that every piece is given
BLOCKS = 16  # parts in which expected counts are added up
REMEMBERED = 300_000
UNDETERMINED = "und"
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


class PieceIndex:
    """Numbers of pieces by the hash of their bytes, looked up for whole arrays."""

    BITS = 20

    def __init__(self, pieces: list[bytes]) -> None:
        self.pieces = pieces
        blob = np.frombuffer(b"".join(pieces), np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        self.hashes = textops.span_hashes(textops.prefix_sums(textops._BYTE[blob]), bounds[:-1], bounds[1:])
        self.hashes = np.append(self.hashes, np.uint64(0))
        slots = (self.hashes[:-1] >> np.uint64(64 - self.BITS)).astype(np.int64)
        self.tables: list[np.ndarray] = []
        order = np.argsort(slots, kind="stable")
        rank = np.arange(len(order)) - np.searchsorted(slots[order], slots[order])
        for depth in range(int(rank.max(initial=0)) + 1):
            table = np.full(1 << self.BITS, len(pieces), np.int32)
            table[slots[order[rank == depth]]] = order[rank == depth]
            self.tables.append(table)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each piece, len(pieces) for none."""
        slots = (hashes >> np.uint64(64 - self.BITS)).astype(np.int64)
        found = np.full(len(hashes), len(self.pieces), np.int32)
        for table in self.tables:
            at = table[slots]
            found = np.where(self.hashes[at] == hashes, at, found)
        return found


def piece_list(model_path: str) -> list[bytes]:
    """All single bytes, then the vocabulary's pieces of 2 to MAX_PIECE bytes, with the word mark as a space."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = [model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    return [bytes([b]) for b in range(256)] + sorted({p for p in pieces if 2 <= len(p) <= MAX_PIECE})


@dataclass
class LanguageModel:
    languages: list[str]
    log_prior: np.ndarray
    probabilities: np.ndarray  # piece x language; a last row of zeros stands for "no piece"
    index: PieceIndex

    def lattice(self, words: np.ndarray) -> list[list[np.ndarray]]:
        """words: a matrix of equally long words. [j][n - 1]: number of the piece of n bytes that ends at j."""
        rows, length = words.shape
        up, down = textops._POWERS[textops._BASE].upto(length + 1)
        sums = np.zeros((rows, length + 1), np.uint64)
        np.cumsum(textops._BYTE[words] * up[:length], axis=1, out=sums[:, 1:])
        out = [[]]
        for j in range(1, length + 1):
            out.append([self.index.find(textops.mix((sums[:, j] - sums[:, j - n]) * down[j - n])) for n in range(1, min(j, MAX_PIECE) + 1)])
        return out

    def log_likelihood(self, words: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each word (a row of words) in each language."""
        rows, length = words.shape
        none = len(self.index.pieces)
        recent, scale = [np.ones((rows, len(self.languages)))], np.zeros((rows, 1))
        up, down = textops._POWERS[textops._BASE].upto(length + 1)
        sums = np.zeros((rows, length + 1), np.uint64)
        np.cumsum(textops._BYTE[words] * up[:length], axis=1, out=sums[:, 1:])
        for j in range(1, length + 1):
            new = np.zeros_like(recent[0])
            for n in range(1, len(recent) + 1):
                at = self.index.find(textops.mix((sums[:, j] - sums[:, j - n]) * down[j - n]))
                some = np.flatnonzero(at != none)
                if len(some):
                    new[some] += recent[-n][some] * self.probabilities[at[some]]
            recent = [*recent[-(MAX_PIECE - 1) :], new]
            if j % 8 == 0:
                top = np.maximum(np.max(recent, axis=(0, 2)), 1e-300)[:, None]
                recent = [r / top for r in recent]
                scale += np.log(top)
        return np.log(np.maximum(recent[-1], 1e-300)) + scale

    def long_log_likelihood(self, word: np.ndarray) -> np.ndarray:
        """log_likelihood of one long word: all its pieces are looked up at once, so a byte costs one small sum."""
        none, up_to = len(self.index.pieces), len(word)
        up, down = textops._POWERS[textops._BASE].upto(up_to + 1)
        sums = np.zeros(up_to + 1, np.uint64)
        np.cumsum(textops._BYTE[word] * up[:up_to], out=sums[1:])
        recent, scale = np.zeros((MAX_PIECE, len(self.languages))), 0.0  # the prefix of j bytes in row j modulo MAX_PIECE
        recent[0] = 1
        for a in range(0, up_to, SEGMENT):
            ends = np.arange(a + 1, min(up_to, a + SEGMENT) + 1)
            found = np.full((len(ends), MAX_PIECE), none)
            for n in range(1, MAX_PIECE + 1):
                begin = ends - n
                ok = begin >= 0
                found[ok, n - 1] = self.index.find(textops.mix((sums[ends[ok]] - sums[begin[ok]]) * down[begin[ok]]))
            row, size = np.nonzero(found != none)
            before, chance = (ends[row] - size - 1) % MAX_PIECE, self.probabilities[found[row, size]]
            cuts = np.searchsorted(row, np.arange(len(ends) + 1)).tolist()
            for j, x, y in zip(ends.tolist(), cuts[:-1], cuts[1:], strict=True):
                recent[j % MAX_PIECE] = (recent[before[x:y]] * chance[x:y]).sum(0)
                if j % 8 == 0:
                    top = max(float(recent.max()), 1e-300)
                    recent /= top
                    scale += np.log(top)
        return np.log(np.maximum(recent[up_to % MAX_PIECE], 1e-300)) + scale

    def expected_counts(self, words: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Expected uses of each piece. weights: times of each word in each language."""
        rows, length = words.shape
        lattice, k = self.lattice(words), len(self.languages)
        forward = np.zeros((length + 1, rows, k))
        forward[0] = 1
        for j in range(1, length + 1):
            for n, at in enumerate(lattice[j], 1):
                some = np.flatnonzero(at != len(self.index.pieces))
                if len(some):
                    forward[j][some] += forward[j - n][some] * self.probabilities[at[some]]
        backward = np.zeros((length + 1, rows, k))
        backward[length] = weights / np.maximum(forward[length], 1e-290)
        uses, times = [], []
        for j in range(length, 0, -1):
            for n, at in enumerate(lattice[j], 1):
                some = np.flatnonzero(at != len(self.index.pieces))
                if len(some):
                    through = self.probabilities[at[some]] * backward[j][some]
                    backward[j - n][some] += through
                    uses.append(at[some])
                    times.append(through * forward[j - n][some])
        uses, times = np.concatenate(uses), np.concatenate(times)
        return np.stack([np.bincount(uses, times[:, i], len(self.index.pieces) + 1) for i in range(k)], axis=1)


def parts(word: bytes) -> Iterator[bytes]:
    """The word in parts of at most PART bytes, cut between characters."""
    while len(word) > PART:
        n = PART
        while n > 1 and word[n] & 0xC0 == 0x80:
            n -= 1
        yield word[:n]
        word = word[n:]
    yield word


def by_length(words: list[bytes], rows: int = 4_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Matrices of equally long words with their places."""
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        for i in range(0, len(at), rows):
            part = at[i : i + rows]
            yield np.frombuffer(b"".join([words[x] for x in part]), np.uint8).reshape(len(part), n), part


def first_model(priors: dict[str, int], pieces: list[bytes]) -> LanguageModel:
    """Shares by priors; all pieces of a size equally likely, shorter ones more."""
    languages = sorted(priors)
    total = np.array([priors[x] for x in languages], float)
    size = np.array([len(p) for p in pieces], float)
    start = np.repeat(np.append(1 / (size * len(pieces)), 0)[:, None], len(languages), axis=1)
    return LanguageModel(languages, np.log(total / total.sum()), start / start.sum(0), PieceIndex(pieces))


def refitted(model: LanguageModel, counts: np.ndarray) -> LanguageModel:
    """The model with the probabilities that expected counts give; its last row stands for "no piece"."""
    counts = counts.copy()
    counts[:-1] += SMOOTHING
    counts[-1] = 0
    return LanguageModel(model.languages, model.log_prior, counts / counts.sum(0), model.index)


def _expected(shared: Broadcast) -> Callable:
    """word, weights (times in each language) -> rows (block, blob): expected uses of pieces, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, total = shared.value, None
        for batch in batches:
            found: dict[bytes, np.ndarray] = {}
            weights = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            for word, w in zip(batch.column(0).to_pylist(), weights, strict=True):
                for part in parts(b" " + word.encode()):
                    found[part] = found[part] + w if part in found else w
            words, of = list(found), np.array(list(found.values()))
            for matrix, at in by_length(words) if words else ():
                counts = model.expected_counts(matrix, of[at])
                total = counts if total is None else total + counts
        if total is not None:
            yield rows_of("block", [(i, part.tobytes()) for i, part in enumerate(np.array_split(total, BLOCKS))])

    return run


def _summed(rows: pa.Table) -> pa.Table:
    return table_of("block", [(rows.column("block")[0].as_py(), sum(np.frombuffer(b.as_buffer()) for b in rows.column("blob")).tobytes())])


def fit(words: DataFrame, priors: dict[str, int], pieces: list[bytes]) -> LanguageModel:
    """words: lang, word, n. Expectation-maximisation over all of them; without a word the model is that of the priors."""
    model, spark = first_model(priors, pieces), words.sparkSession
    times = F.array(*(F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).cast("double") for x in model.languages))
    weighted = materialise(words.groupBy("word").agg(times.alias("weights")))
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)  # at most 33,000 pieces for each language
        found = weighted.mapInArrow(lean(_expected(shared), "langid"), "block int, blob binary").groupBy("block").applyInArrow(_summed, "block int, blob binary").collect()
        blobs = {r.block: np.frombuffer(bytes(r.blob)).reshape(-1, len(model.languages)) for r in found}
        shared.unpersist()
        if blobs:
            model = refitted(model, np.concatenate([blobs[i] for i in range(BLOCKS)]))
    return model


def held_out(id_col: str, modulus: int) -> "F.Column":
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus) == 0


def train(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> LanguageModel | None:
    """Fits on labelled rows of docs, as many of each language as sample_rows allows; None if there are none.

    Rows without id, text or language aren't used; empty texts have no words, but count for their language's share.
    Ties among hashes go to the smaller id; all rows of an id that is taken are used. A-Z count as lower case. Columns
    other than id, text and language aren't read. More than MOST_LANGUAGES languages are refused.
    """
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    usable = usable.select(F.col(id_col).alias("i"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    priors = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(priors) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages are labelled; clean the labels or raise MOST_LANGUAGES")
    if not priors:
        return None
    totals = docs.sparkSession.createDataFrame(list(priors.items()), f"lang {dict(usable.dtypes)['lang']}, total long")
    place = F.pmod(F.xxhash64("i"), F.lit(1 << 31))
    some = usable.select("i", "lang", place.alias("place")).join(F.broadcast(totals), "lang")
    some = some.where(F.col("place") * F.col("total").cast("double") <= 2.0 * (1 << 31) * sample_rows)  # of places in order, enough for the first sample_rows
    first = F.row_number().over(Window.partitionBy("lang").orderBy("place", "i"))
    ids = some.withColumn("first", first).where(F.col("first") <= sample_rows).select("i", "lang").distinct()
    sample = usable.join(F.broadcast(ids), ["i", "lang"], "left_semi").select("lang", "text")
    word = F.explode(F.split(F.translate("text", string.ascii_uppercase, string.ascii_lowercase), "[ \\x09-\\x0D]+")).alias("word")
    counted = sample.select("lang", word).where("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("n"))
    return fit(counted, priors, piece_list(model_path))


class Scorer:
    """Scores texts; remembers the words it has met, up to REMEMBERED."""

    def __init__(self, model: LanguageModel) -> None:
        self.model, self.known = model, {}
        self.scores = np.zeros((REMEMBERED, len(model.languages)))

    def _learn(self, hashes: list[int], words: list[bytes]) -> None:
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
        base = len(self.known)
        if base + len(words) > len(self.scores):
            self.scores = np.zeros((base + len(words), len(self.model.languages)))
        for matrix, at in by_length(words):
            long = matrix.shape[1] > LONG_WORD and len(matrix) < FEW_ROWS
            self.scores[base + at] = [self.model.long_log_likelihood(w) for w in matrix] if long else self.model.log_likelihood(matrix)
        self.known.update(zip(hashes, range(base, base + len(hashes)), strict=True))

    def score(self, texts: textops.Texts) -> np.ndarray:
        """Log probability of each text in each language, with the prior."""
        hashes, starts, ends, firsts = texts.lowered().word_hashes()
        lowered = texts.lowered().data
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        keys = unique.tolist()
        new = [i for i, h in enumerate(keys) if h not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(range(len(keys)))
        if new:
            blob = lowered.tobytes()
            self._learn([keys[i] for i in new], [b" " + blob[starts[first[i]] : ends[first[i]]] for i in new])
        rows = np.fromiter((self.known[h] for h in keys), np.int64, len(keys))
        per_word = self.scores[rows[inverse]]
        sums = np.concatenate([np.zeros((1, per_word.shape[1])), np.cumsum(per_word, axis=0)])
        return sums[firsts[1:]] - sums[firsts[:-1]] + self.model.log_prior


def has_letter(texts: textops.Texts) -> np.ndarray:
    seen = np.concatenate([[0], np.cumsum(_ASCII_LETTER[texts.data])])
    out = seen[texts.bounds[1:]] > seen[texts.bounds[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in texts.bytes_of(i).decode("utf-8", "replace"))
    return out


def predict(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds nothing to docs: one row for each, with doc_id, lang_pred and score (the language's posterior probability).

    Whole texts, no shuffle. Texts that are null, empty or without a letter get "und" and 0, and so does every text
    without a trained model. Ties go to the language that is first in order. Repeated rows stay; an empty table gives
    no rows; columns other than id and text aren't read.
    """
    kind = dict(docs.dtypes)[id_col]
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 33,000 pieces for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value and worker_scorer(shared.value)
        for batch in batches:
            for texts in textops.chunks(batch.column(1), CHUNK):
                letters = has_letter(texts)
                names, best = [UNDETERMINED] * len(texts), np.zeros(len(texts))
                if scorer:
                    logs = scorer.score(texts)
                    top = logs.argmax(1)
                    best = np.where(letters, 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1), 0)
                    names = [scorer.model.languages[t] if ok else UNDETERMINED for t, ok in zip(top, letters, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.first, len(texts)), pa.array(names, pa.string()), pa.array(best, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(lean(run, "langid"), f"doc_id {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel | None, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns as they are, whose language is found with a posterior of at least least.

    Texts that are null, empty or without a letter go. Without a model (no labelled row) there is no language to find:
    texts with a letter stay. Repeated rows all stay or all go; an empty table gives no rows; columns may have any names.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value and worker_scorer(shared.value)
        for batch in batches:
            for texts in textops.chunks(batch.column(place), CHUNK):
                keep = has_letter(texts)
                if scorer:
                    logs = scorer.score(texts)
                    keep &= 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1) >= least
                yield batch.slice(texts.first, len(texts)).filter(pa.array(keep))

    return docs.mapInArrow(lean(run, "langid"), docs.schema)


_SCORERS: list[tuple[LanguageModel, Scorer]] = []
kept("langid", _SCORERS.clear)


def worker_scorer(model: LanguageModel) -> Scorer:
    """One scorer for each model and Python worker, so that its words are remembered from task to task."""
    if not _SCORERS or _SCORERS[0][0] is not model:
        _SCORERS[:] = [(model, Scorer(model))]
    return _SCORERS[0][1]

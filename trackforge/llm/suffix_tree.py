"""Substring dedup by prefix-partitioned suffix trees over words.

Suffixes are first split by prefixes of variable length: a group of suffixes that is too large for memory is split by
one more word until it fits. Over each group a subtree is built from its root down, all its nodes of one depth at a
time; a node of one suffix is a leaf and drops out. Internal nodes as deep as the window are the repeats: the suffixes
below them begin with the same words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackforge.llm import textops
from trackforge.llm.repeats import NULL_ID, Shard, Windows, remove_repeats

WINDOW = 35
ANCHOR = 6
GROUP_SUFFIXES = 400_000  # suffixes of a subtree in memory
STRIDE = 5  # words of an edge that are read at once


def prefix_groups(words: np.ndarray, suffixes: np.ndarray, depth: int, limit: int, known: int = 0) -> Iterator[tuple[np.ndarray, int]]:
    """Groups of suffixes with the length of the prefix that they share; suffixes alone with their prefix are left out.

    Small groups of the same prefix length come together as one forest.
    """
    if len(suffixes) <= limit or known == depth:
        yield suffixes, known
        return
    order = suffixes[np.argsort(words[suffixes + known], kind="stable")]
    cuts = np.flatnonzero(np.diff(words[order + known])) + 1
    forest, held = [], 0
    for part in np.split(order, cuts):
        if len(part) > limit:
            yield from prefix_groups(words, part, depth, limit, known + 1)
        elif len(part) > 1:
            if held + len(part) > limit:
                yield np.concatenate(forest), known
                forest, held = [], 0
            forest.append(part)
            held += len(part)
    if forest:
        yield np.concatenate(forest), known


def deep_nodes(words: np.ndarray, suffixes: np.ndarray, known: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes below internal nodes of the given depth, and their nodes, by building the subtree downwards."""
    node = np.zeros(len(suffixes), np.int64)
    while known < depth and len(suffixes):
        step = min(STRIDE, depth - known)
        edge = textops.grams(words, step)[suffixes + known] if step > 1 else words[suffixes + known]
        order = np.lexsort((edge, node))
        n, e = node[order], edge[order]
        new = np.concatenate([[True], (n[1:] != n[:-1]) | (e[1:] != e[:-1])])
        child = np.cumsum(new) - 1
        inner = np.bincount(child)[child] > 1
        suffixes, node = suffixes[order[inner]], child[inner]
        known += step
    return suffixes, node


def repeated_windows(words: np.ndarray, suffixes: np.ndarray, depth: int, weights: np.ndarray, limit: int = GROUP_SUFFIXES) -> np.ndarray:
    """A flag for each suffix: its first depth words begin another suffix too. weights: 2 counts as two suffixes."""
    flags = np.zeros(len(suffixes), bool)
    place = np.full(int(suffixes.max(initial=-1)) + 1, -1)
    place[suffixes] = np.arange(len(suffixes))
    for group, known in prefix_groups(words, suffixes, depth, limit):
        below, _ = deep_nodes(words, group, known, depth)
        flags[place[below]] = True
    return flags | (weights > 1)


def hashed_words(texts: textops.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the first of each text. Hashing takes some thirty bytes for each byte, so it goes by pieces."""
    hashes, firsts, done = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for piece in texts.pieces():
        found, _, _, first = piece.word_hashes()
        hashes.append(found)
        firsts.append(first[:-1] + done)
        done += len(found)
    return np.concatenate(hashes), np.concatenate(firsts)


def judge(shard: Shard, depth: int = WINDOW) -> np.ndarray:
    hashes, firsts = hashed_words(shard.contents)
    suffixes = textops.expand(firsts, shard.windows)
    return repeated_windows(hashes, suffixes, depth, np.repeat(shard.copies, shard.windows))


def _words_of(texts: textops.Texts, i: int, removed: np.ndarray, firsts: np.ndarray, spans: tuple[np.ndarray, np.ndarray]) -> bytes:
    """Kept words of text i, joined by one space."""
    a, b = firsts[i], firsts[i + 1]
    kept = np.flatnonzero(~removed[a:b]) + a
    if not len(kept):
        return b""
    starts, sizes = spans[0][kept], spans[1][kept] - spans[0][kept]
    out = np.full(int(sizes.sum()) + len(kept), 32, np.uint8)
    places = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    out[textops.expand(places, sizes)] = texts.data[textops.expand(starts, sizes)]
    return out[:-1].tobytes()


def _digest(texts: textops.Texts, ids: np.ndarray, removed: np.ndarray, firsts: np.ndarray, spans: tuple) -> list[tuple]:
    out = []
    for i, x in enumerate(ids.tolist()):
        a, b = int(firsts[i]), int(firsts[i + 1])
        out.append((None if x == NULL_ID else x, b - a, int(removed[a:b].sum()), hashlib.sha256(_words_of(texts, i, removed, firsts, spans)).hexdigest()))
    return out


def _text(texts: textops.Texts, ids: np.ndarray, removed: np.ndarray, firsts: np.ndarray, spans: tuple) -> list[tuple]:
    out = []
    for i, x in enumerate(ids.tolist()):
        gone = int(removed[firsts[i] : firsts[i + 1]].sum())
        whole = texts.bytes_of(i) if not gone else _words_of(texts, i, removed, firsts, spans)
        out.append((None if x == NULL_ID else x, int(firsts[i + 1] - firsts[i]), gone, whole.decode("utf-8", "replace")))
    return out


def dedup_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Each row of docs without the words of repeated windows: numbers of words, of removed words, digest of the rest.

    A null text has no words. Texts shorter than a window keep all words. A row that comes twice is its own repeat.
    A null doc_id stays null. An empty table gives no rows; columns other than id and text aren't read. Words are
    compared by 64-bit hashes.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
    return remove_repeats(docs, Windows("word", WINDOW, ANCHOR, False), judge, _digest, schema, "doc_id long, n_words long, n_removed long, kept_sha256 string", id_col, text_col, buckets)


def dedup_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None, carry: list[str] | None = None) -> DataFrame:
    """As dedup_digests, with the text that is kept: unchanged where nothing was removed, else its words joined by one space.

    carry: columns of docs that stay with their rows; their names must differ from those of the result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
    return remove_repeats(docs, Windows("word", WINDOW, ANCHOR, False), judge, _text, schema, "doc_id long, n_words long, n_removed long, kept string", id_col, text_col, buckets, carry)

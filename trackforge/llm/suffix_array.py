"""Suffix-array dedup of bytes by induced sorting.

Suffixes are classified as larger (L) or smaller (S) than their right neighbour. Leftmost smaller (LMS) substrings are
sorted by inducing and named by their ranks; the string of their names is sorted by recursion, for as long as names
repeat, and from the order of the LMS suffixes all others are induced: the L suffixes along the runs that lead to an
LMS suffix, then the S suffixes along the runs that lead to an L suffix. A pass ranks all runs at once, doubling the
part of each run that its rank covers, and only what isn't told apart yet is ranked again; so its steps are array
operations at every level, whatever the number of names. Common prefixes are computed in text order (permuted) with
each suffix's left neighbour in the array, up to the window's length.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trackforge.llm import textops
from trackforge.llm.repeats import NULL_ID, Shard, Windows, remove_repeats

WINDOW = 50
ANCHOR = 24
SORTED_BYTES = 1 << 18  # about how much text is sorted at once


def smaller_types(s: np.ndarray) -> np.ndarray:
    """True for suffixes that are smaller than their right neighbour; the last one is."""
    n = len(s)
    differs = np.flatnonzero(s[:-1] != s[1:])
    out = np.ones(n, bool)
    if len(differs):
        at = np.searchsorted(differs, np.arange(n - 1))
        inside = at < len(differs)
        nearest = differs[np.minimum(at, len(differs) - 1)]
        out[:-1] = np.where(inside, s[nearest] < s[np.minimum(nearest + 1, n - 1)], False)
    return out


def _ranked_runs(code: np.ndarray, members: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Ranks of the members of a string by their code and, in runs, by what follows as far as the run's end.

    members: places in ascending order. runs: true for places whose rank also depends on the next place, which is a
    member; a run ends at the first member that isn't in it. Equal ones share the rank of the first of them.
    """
    rank = np.zeros(len(code), np.int64)
    own = code[members]
    order = np.argsort(own)
    ordered = own[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    heads = np.flatnonzero(new)
    size = np.diff(np.append(heads, len(order)))
    rank[members[order]] = np.repeat(heads, size)
    many = np.zeros(len(members), bool)
    many[order] = np.repeat(size > 1, size)
    active = members[many & runs[members]]
    ahead = active + 1
    place = np.full(len(code), -1)
    while len(active):
        place[active] = np.arange(len(active))
        key = rank[active] * (len(code) + 1) + rank[ahead]
        order = np.argsort(key)
        ordered, group = key[order], rank[active[order]]
        heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        size = np.diff(np.append(heads, len(order)))
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        base = np.repeat(first, np.diff(np.append(first, len(order))))
        again = place[ahead]  # of the place ahead, if it isn't told apart either
        onward = np.where(again >= 0, ahead[np.maximum(again, 0)], -1)
        place[active] = -1
        rank[active[order]] = group + np.repeat(heads, size) - base
        open_ = np.zeros(len(active), bool)
        open_[order] = np.repeat(size > 1, size)
        open_ &= onward >= 0
        active, ahead = active[open_], onward[open_]
    return rank


def induced_ranks(s: np.ndarray, small: np.ndarray, lms: np.ndarray, lms_ranks: np.ndarray | None) -> np.ndarray:
    """Rank of every suffix, induced from the ranks of the LMS suffixes; without them, LMS substrings get their ranks."""
    n = len(s)
    wide = n + 1
    code = (2 * s.astype(np.int64) + small) * wide
    if lms_ranks is not None:
        code[lms] += lms_ranks + 1
    is_end = np.zeros(n, bool)
    is_end[lms] = True
    larger = ~small
    rank = _ranked_runs(code, np.flatnonzero(larger | is_end), larger)
    code = (2 * s.astype(np.int64) + small) * wide
    code[larger] += rank[larger]
    runs = small.copy()
    runs[n - 1] = False
    return _ranked_runs(code, np.arange(n), runs)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """All suffixes of s in order. The last symbol is 0 and stands nowhere else."""
    if len(s) < 3:
        return np.argsort(s, kind="stable")
    small = smaller_types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    names = induced_ranks(s, small, lms, None)[lms]
    distinct, names = np.unique(names, return_inverse=True)
    if len(distinct) < len(lms):
        ranks = np.empty(len(lms), np.int64)
        ranks[suffix_array(names)] = np.arange(len(lms))  # its last name is 0 and unique: the end of s
    else:
        ranks = names
    out = np.empty(len(s), np.int64)
    out[induced_ranks(s, small, lms, ranks)] = np.arange(len(s))
    return out


def permuted_common_prefixes(s: np.ndarray, array: np.ndarray, most: int) -> np.ndarray:
    """For each place, in text order, the common prefix with the left neighbour in the array, up to most symbols.

    s holds bytes; eight of them are compared at once.
    """
    left = np.full(len(s), len(s), np.int64)
    left[array[1:]] = array[:-1]
    padded = np.concatenate([s, np.zeros(most + 16, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    words = np.ascontiguousarray(eight).view("<u8").ravel()
    out = np.zeros(len(s), np.int64)
    active = np.flatnonzero(left < len(s))
    for t in range(0, most, 8):
        differs = words[active + t] ^ words[left[active] + t]
        low = differs & (~differs + np.uint64(1))  # its lowest bit shows the first byte that differs
        out[active] = t + np.where(differs == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8)
        active = active[differs == 0]
    return np.minimum(out, most)


def _keys(contents: textops.Texts, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each neighbourhood, and of the anchor that all its windows name."""
    content, anchor = [], []
    at = 0
    while at < len(contents):
        to = max(at + 1, int(np.searchsorted(contents.bounds, contents.bounds[at] + textops.CHUNK_BYTES, side="right")) - 1)
        some = textops.Texts(contents.data[contents.bounds[at] : contents.bounds[to]], contents.bounds[at : to + 1] - contents.bounds[at])
        content.append(textops.span_hashes(textops.prefix_sums(textops._BYTE[some.data]), some.bounds[:-1], some.bounds[1:]))
        found = windows.neighbourhoods(some)
        anchor.append(found.hashes[found.rank == 0])
        at = to
    return np.concatenate(content), np.concatenate(anchor)


def judge(shard: Shard, windows: Windows = Windows("byte", WINDOW, ANCHOR, True)) -> np.ndarray:
    """A flag for each window: its bytes also begin in a document of smaller id.

    Equal windows name equal anchors, so each anchor's neighbourhoods are judged by themselves, as many anchors at once
    as fit in memory. Equal neighbourhoods are sorted once, under the smallest of their ids; the others' windows all
    go. An anchor whose neighbourhoods are all equal needs no sorting.
    """
    content, anchor = _keys(shard.contents, windows)
    order = np.lexsort((shard.ids, content, anchor))
    new = np.concatenate([[True], (content[order][1:] != content[order][:-1]) | (anchor[order][1:] != anchor[order][:-1])])
    lead = order[new]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    later = shard.ids > shard.ids[lead][group]

    named = anchor[lead]
    alone = np.concatenate([[True], named[1:] != named[:-1]]) & np.concatenate([named[1:] != named[:-1], [True]])
    own = shard.windows[lead]
    starts = np.concatenate([[0], np.cumsum(own)])
    flags = np.zeros(starts[-1], bool)
    sizes = np.diff(shard.contents.bounds)[lead]
    part = (named >> np.uint64(8)) % np.uint64(1 + int(sizes[~alone].sum()) // SORTED_BYTES)
    for p in np.unique(part[~alone]):
        mine = np.flatnonzero((part == p) & ~alone)
        data = shard.contents.data[textops.expand(shard.contents.bounds[lead[mine]], sizes[mine])]
        flags[textops.expand(starts[mine], own[mine])] = _sorted_flags(data, np.concatenate([[0], np.cumsum(sizes[mine])]), shard.ids[lead[mine]], own[mine], windows.length)
    return flags[textops.expand(starts[group], shard.windows)] | np.repeat(later, shard.windows)


def _sorted_flags(data: np.ndarray, bounds: np.ndarray, ids_of: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """A flag for each window of different neighbourhoods, by the suffix array of all of them."""
    n = len(data) + len(bounds) - 1
    shift = np.arange(len(bounds) - 1)
    used = np.zeros(256, np.int64)
    used[np.unique(data)] = 1
    code = np.where(used > 0, np.cumsum(used) + 1, 0)  # 0: the end, 1: between neighbourhoods
    # UTF-8 has no bytes 0xC0, 0xC1 and 0xF5-0xFF, so the codes stay within a byte
    s = np.ones(n + 1, np.uint8)
    s[n] = 0
    s[textops.expand(bounds[:-1] + shift, np.diff(bounds))] = code[data]
    begins = textops.expand(bounds[:-1] + shift, windows)
    owner = np.full(n + 1, -1)
    owner[begins] = np.repeat(np.arange(len(shift)), windows)
    array = suffix_array(s)
    common = permuted_common_prefixes(s, array, length)
    ordered = array[owner[array] >= 0]
    new = common[ordered] < length
    new[0] = True
    ids = ids_of[owner[ordered]]
    heads = np.flatnonzero(new)
    least = np.repeat(np.minimum.reduceat(ids, heads), np.diff(np.append(heads, len(ids))))
    gone = np.zeros(n + 1, bool)
    gone[ordered] = least < ids
    return gone[begins]


def _digest(texts: textops.Texts, ids: np.ndarray, removed: np.ndarray, firsts: np.ndarray, spans: None) -> list[tuple]:
    out = []
    for i, x in enumerate(ids.tolist()):
        a, b = int(firsts[i]), int(firsts[i + 1])
        gone = removed[a:b]
        runs = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(b > a and gone[0])
        out.append((None if x == NULL_ID else x, b - a, int(gone.sum()), runs, hashlib.sha256(texts.data[a:b][~gone].tobytes()).hexdigest()))
    return out


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Each row of docs without the bytes of windows that begin in a document of smaller id as well.

    A null text is empty. Texts shorter than a window stay whole. Rows that share an id aren't smaller than each other.
    A null doc_id counts as larger than all others and stays null. An empty table gives no rows; columns other than id
    and text aren't read. Equal neighbourhoods are recognised by two 64-bit hashes, windows by their bytes.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    return remove_repeats(docs, Windows("byte", WINDOW, ANCHOR, True), judge, _digest, schema, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", id_col, text_col, buckets)

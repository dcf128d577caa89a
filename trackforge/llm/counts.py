"""How often hashes occur in the corpus, told to the parts of the documents that hold them.

Documents are in parts, which later steps read again. Every part names each of its hashes once, with its count, to the
bucket of the hash; the bucket returns those that occur more than once to the parts that named them, with the power of
two of the total. A hash that stands in a third of all documents costs a bucket one entry for each part, or for each
task that meets it in many parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from trackforge.llm import textops
from trackforge.llm.packing import by_bucket, merged, pack, rows_of, table_of
from trackforge.llm.workers import lean, lean_group

HELD = 700_000  # hashes that a task holds before it passes them on


def halves(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each hash, by its upper half, and the lower half, which names it there.

    So a few hashes may pass for one, and count as repeated, that aren't; which ones is the same for all parts.
    """
    return (hashes >> np.uint64(32)) % np.uint64(buckets), hashes & np.uint64(0xFFFFFFFF)


def names(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and name in one number, as repeated() returns them."""
    bucket, name = halves(hashes, buckets)
    return ((bucket << np.uint64(32)) | name).view(np.int64)


def _both_sorted(values: np.ndarray, parts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Values below 2**48 and their parts, which are at most most, in the order of both."""
    if most < 1 << 16:
        key = (values << np.uint64(16)) | parts.astype(np.uint64)
        key.sort()
        return key >> np.uint64(16), (key & np.uint64(0xFFFF)).astype(np.int32)
    order = np.lexsort((parts, values))
    return values[order], parts[order].astype(np.int32)


def dealt(found: Callable[[textops.Texts], tuple[np.ndarray, np.ndarray]], buckets: int) -> Callable:
    """part, text -> rows (bucket, blob of name, part, count).

    found: hashes of some texts and each text's bounds among them. A hash that a task meets in more than a quarter of
    all parts, of which there are as many as buckets, is passed on once, for every part.
    """
    kind = np.uint16 if buckets < 1 << 16 else np.int32

    def passed_on(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        hashes, parts = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        hashes, part = _both_sorted(names(hashes, buckets).view(np.uint64), parts, buckets)
        new = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (part[1:] != part[:-1])]))
        times, hashes, part = np.diff(np.append(new, len(hashes))), hashes[new], part[new]
        heads = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        size = np.diff(np.append(heads, len(hashes)))
        wide = size > max(4, buckets // 4)
        total = np.add.reduceat(times, heads)
        keep = ~np.repeat(wide, size)
        keep[heads[wide]] = True
        part[heads[wide]], times[heads[wide]] = buckets, total[wide]  # in place of a part: every part
        hashes, part, times = hashes[keep], part[keep].astype(kind), times[keep].astype(np.int32)
        cuts = np.searchsorted(hashes >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64)).tolist()
        name = hashes.astype(np.uint32).view(np.int32)
        return rows_of("bucket", [(b, pack(name[i:j], part[i:j], times[i:j])) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            parts = batch.column(0).to_numpy(zero_copy_only=False)
            for texts in textops.chunks(batch.column(1)):
                hashes, bounds = found(texts)
                held.append((hashes, np.repeat(parts[texts.first : texts.first + len(texts)], np.diff(bounds))))
                n += len(hashes)
                if n >= HELD:
                    yield passed_on(held)
                    n = 0
        if n:
            yield passed_on(held)

    return lean(run)


def repeated(buckets: int) -> Callable:
    """rows of a bucket -> rows (part, blob of name with bucket, power of two of the total) of what occurs more than once."""

    def run(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        name, part, times = merged(rows.column("blob"))
        name = name.view(np.uint32)
        order = np.sort((name.astype(np.uint64) << np.uint64(32)) | np.arange(len(name), dtype=np.uint64)).astype(np.uint32)
        name, part, times = name[order], part[order], times[order]
        heads = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        size = np.diff(np.append(heads, len(name)))
        total = np.add.reduceat(times.astype(np.int64), heads)
        again, wide = total > 1, np.maximum.reduceat(part, heads) == buckets
        power = np.ceil(np.log2(np.maximum(total, 1))).astype(np.uint8)
        base = np.int64(bucket) << 32
        everywhere = again & wide
        for_all, power_for_all = base + name[heads[everywhere]].astype(np.int64), power[everywhere]
        keep = np.flatnonzero(np.repeat(again & ~wide, size))
        own, power = base + name[keep].astype(np.int64), np.repeat(power, size)[keep]
        there = dict(by_bucket(part[keep]))
        out = []
        for p in range(buckets) if len(for_all) else sorted(there):
            at = there.get(p, keep[:0])
            x, first = np.unique(np.concatenate([own[at], for_all]), return_index=True)
            out.append((p, pack(x, np.concatenate([power[at], power_for_all])[first])))
        return table_of("part", out)

    return lean_group(run)

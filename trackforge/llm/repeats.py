"""Distributed search for windows of text that occur more than once, shared by the two substring operators.

A window is a fixed number of consecutive units (words or bytes) of one document. Every window names one of its own
short grams, the one of least hash, as its anchor; equal windows name equal anchors, and neighbouring windows mostly
share one, so anchors are far fewer than windows. The steps:

1. Anchors: the hashes of all anchors meet in buckets by hash, each once for a part of the documents with its count;
   those that occur once in the corpus drop out, and with them all windows that name them, which cannot repeat.
2. Neighbourhoods: around each anchor that is left, the text of all windows that name it goes to the bucket of the
   anchor's hash. So all copies of a window are in one bucket, whole, and buckets are sized to fit in memory.
3. In each bucket the caller's index (suffix tree or suffix array) judges the windows by their text.
4. The verdicts return to the documents.

Each step deals packed arrays, and each task first merges what repeats within its own input: anchors are passed on once
for each part, frequent ones once for all parts, and equal neighbourhoods are passed on as one. So content that stands
in a third of all rows costs a bucket at most one entry for each task. Text moves twice, to groups of documents by
doc_id; nothing is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from trackforge.llm import counts, textops
from trackforge.llm.durable import materialise, release_shuffles
from trackforge.llm.packing import by_bucket, merged, pack, rows_of, stream_of, table_of
from trackforge.llm.workers import bound_batches, lean, lean_group

NULL_ID = (1 << 63) - 1  # stands for a null doc_id, which counts as larger than all others
BUCKET_BYTES = 8 << 20  # text of a part of the documents


@dataclass(frozen=True)
class Windows:
    """unit: "word" or "byte"; length: units of a window; gram: units of an anchor."""

    unit: str
    length: int
    gram: int
    across_documents: bool  # only copies in other documents count

    def units(self, texts: textops.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash of the gram at each unit, first unit of each text and one more, start and end byte of each unit."""
        if self.unit == "byte":
            at = np.arange(len(texts.data))
            return texts.byte_grams(self.gram), texts.bounds, at, at + 1
        hashes, starts, ends, firsts = texts.word_hashes()
        return textops.grams(hashes, self.gram), firsts, starts, ends

    def neighbourhoods(self, texts: textops.Texts) -> "Neighbourhoods":
        grams, firsts, starts, ends = self.units(texts)
        width = self.length - self.gram + 1
        sizes = np.diff(firsts)
        at = textops.expand(firsts[:-1], np.maximum(sizes - self.length + 1, 0))  # first unit of every window
        if not len(at):
            none = np.zeros(0, np.int64)
            return Neighbourhoods(none.astype(np.uint64), none, none, none, none, firsts, starts, ends)
        keys = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        named = (textops.sliding(keys, width)[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (named[1:] != named[:-1]) | (at[1:] != at[:-1] + 1)]))
        last = at[np.append(new[1:], len(at)) - 1]
        text = np.searchsorted(firsts, at[new], side="right") - 1
        rank = np.arange(len(new)) - np.searchsorted(text, text)
        return Neighbourhoods(grams[named[new]], at[new], last, text, rank, firsts, starts, ends)


@dataclass
class Neighbourhoods:
    """Runs of windows that name one anchor. first, last: units at which the first and last window begin."""

    hashes: np.ndarray
    first: np.ndarray
    last: np.ndarray
    text: np.ndarray
    rank: np.ndarray
    firsts: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def _group(ids: np.ndarray, groups: int) -> np.ndarray:
    return (ids ^ (ids >> 17) ^ (ids >> 34)) % groups


def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each pair of numbers."""
    return textops.mix(textops.mix(a.astype(np.int64).view(np.uint64)) + b.astype(np.int64).view(np.uint64))


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in known, which is sorted."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes % np.uint64(buckets)).astype(np.int64)


def _anchors(windows: Windows, buckets: int) -> Callable:
    """part, text -> each anchor of a part with how often it occurs, as counts.dealt(); once for a text, if only other documents count."""

    def found(texts: textops.Texts) -> tuple[np.ndarray, np.ndarray]:
        near = windows.neighbourhoods(texts)
        bounds = np.searchsorted(near.text, np.arange(len(texts) + 1))
        return textops.distinct_in_order(near.hashes, bounds) if windows.across_documents else (near.hashes, bounds)

    return counts.dealt(found, buckets)


def _text_tags(texts: textops.Texts) -> np.ndarray:
    """A hash of each whole text."""
    return textops.span_hashes(textops.prefix_sums(textops._BYTE[texts.data]), texts.bounds[:-1], texts.bounds[1:]).view(np.int64)


def _doubtful(ids: np.ndarray) -> np.ndarray:
    """Ids of several rows. All rows of an id are in one group of documents, so every step finds the same."""
    unique, times = np.unique(ids, return_counts=True)
    return unique[times > 1]


def _tags(texts: textops.Texts, ids: np.ndarray, doubtful: np.ndarray) -> np.ndarray:
    """What tells rows of one id apart: a hash of the text for doubtful ids, else 0."""
    if not len(doubtful):
        return np.zeros(len(texts), np.int64)
    return np.where(np.isin(ids, doubtful), _text_tags(texts), 0)


def _dealt(groups: int) -> Callable:
    """documents, doc_id first -> rows (part, blob): those of a part, as a compressed Arrow stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            if len(ids):
                yield rows_of("part", [(p, stream_of(batch.take(pa.array(at)))) for p, at in by_bucket(_group(ids, groups))])

    return run


def documents_of(rows: pa.Table, schema: pa.Schema) -> pa.Table:
    """The documents of a part; schema: theirs."""
    tables = [pa.ipc.open_stream(blob.as_buffer()).read_all() for blob in rows.column("blob")]
    return pa.concat_tables(tables).combine_chunks() if tables else schema.empty_table()


@dataclass
class Shard:
    """Neighbourhoods of one bucket. tags tell rows of one doc_id apart."""

    contents: textops.Texts
    ids: np.ndarray
    tags: np.ndarray
    first: np.ndarray  # unit of the document at which the first window begins
    windows: np.ndarray  # number of windows
    copies: np.ndarray  # 2 if the same neighbourhood was met before and is settled, else 1


def _neighbourhood_rows(windows: Windows, buckets: int, fields: pa.Schema) -> Callable:
    """(documents of a part, their repeated anchors) -> rows (bucket, blob)."""

    def run(packed: pa.Table, anchors: pa.Table) -> pa.Table:
        if not packed.num_rows or not anchors.num_rows:
            return table_of("bucket", [])
        texts_of = documents_of(packed, fields)
        wanted = np.sort(merged(anchors.column("blob"))[0])
        ids_all = texts_of.column("doc_id").to_numpy().astype(np.int64)
        doubtful = _doubtful(ids_all)
        held: list[tuple] = []
        done = 0
        for column in texts_of.column("text").chunks:
            for texts in textops.chunks(column):
                ids = ids_all[done + texts.first : done + texts.first + len(texts)]
                found = windows.neighbourhoods(texts)
                of = ids[found.text]
                keep = np.flatnonzero(among(counts.names(found.hashes, buckets), wanted))
                if len(keep):
                    a, b = found.starts[found.first[keep]], found.ends[found.last[keep] + windows.length - 1]
                    sums = textops.prefix_sums(textops._BYTE[texts.data])
                    within = found.first[keep] - found.firsts[found.text[keep]]
                    blob = texts.data[textops.expand(a, b - a)]
                    held.append((found.hashes[keep], textops.span_hashes(sums, a, b), of[keep], _tags(texts, ids, doubtful)[found.text[keep]], within, found.last[keep] - found.first[keep] + 1, b - a, blob))
            done += len(column)
        if not held:
            return table_of("bucket", [])
        anchor, content, ids, tags, first, count, size, blob = (np.concatenate(x) for x in zip(*held, strict=True))
        at = np.concatenate([[0], np.cumsum(size)])
        order = np.lexsort((first, ids, content, anchor))
        new = np.concatenate([[True], (anchor[order][1:] != anchor[order][:-1]) | (content[order][1:] != content[order][:-1])])
        copies = np.diff(np.append(np.flatnonzero(new), len(order)))
        lead, rest = order[new], order[~new]
        if windows.across_documents:  # copies in the document of smallest id aren't settled by each other
            least = np.repeat(ids[lead], copies)[~new]
            extra = rest[ids[rest] == least]
            rest = rest[ids[rest] != least]
            lead, weight = np.concatenate([lead, extra]), np.ones(len(lead) + len(extra), np.uint8)
        else:
            weight = np.minimum(copies, 2).astype(np.uint8)
            rest = np.concatenate([rest, lead[copies > 1]])
        rows = []
        for b, part in by_bucket(_bucket(anchor[lead], buckets)):
            part = part[np.lexsort((first[lead[part]], ids[lead[part]]))]
            here = lead[part]
            rows.append((b, pack(ids[here], tags[here], first[here], count[here], size[here], weight[part], blob[textops.expand(at[here], size[here])], *[np.zeros(0, np.int64)] * 4)))
        none = [np.zeros(0, np.int64)] * 5 + [np.zeros(0, np.uint8)] * 2
        for b, part in by_bucket(_group(ids[rest], buckets)):
            here = rest[part]
            here = here[np.lexsort((first[here], ids[here]))]
            rows.append((b, pack(*none, ids[here], tags[here], first[here], count[here])))
        return table_of("bucket", rows)

    return run


def _judge(windows: Windows, groups: int, judge: Callable[[Shard], np.ndarray]) -> Callable:
    """rows of a bucket -> rows (part, blob of doc_id, tag, first window, number of windows) that are to go."""

    def run(rows: pa.Table) -> pa.Table:
        ids, tags, first, count, size, weight, blob, *settled = merged(rows.column("blob"))
        found = [settled]
        if len(ids):
            shard = Shard(textops.Texts(blob, np.concatenate([[0], np.cumsum(size)])), ids, tags, first, count, weight)
            goes = judge(shard)  # a flag for each window, neighbourhood after neighbourhood
            of = np.repeat(np.arange(len(ids)), count)
            unit = textops.expand(first, count)
            at = np.flatnonzero(goes)
            if len(at):
                new = np.flatnonzero(np.concatenate([[True], (of[at][1:] != of[at][:-1]) | (unit[at][1:] != unit[at][:-1] + 1)]))
                runs = np.diff(np.append(new, len(at)))
                lead = at[new]
                found.append([ids[of[lead]], tags[of[lead]], unit[lead], runs])
        ids, tags, first, count = (np.concatenate(x) for x in zip(*found, strict=True))
        out = []
        for g, part in by_bucket(_group(ids, groups)):
            part = part[np.lexsort((first[part], tags[part], ids[part]))]
            out.append((g, pack(ids[part], tags[part], first[part], count[part])))
        return table_of("part", out)

    return run


def _applied(windows: Windows, describe: Callable, schema: pa.Schema, carry: list[str], fields: pa.Schema) -> Callable:
    """(documents of a part, windows that are to go) -> a row for each text, with the columns to carry."""

    def run(packed: pa.Table, gone: pa.Table) -> pa.Table:
        texts_of = documents_of(packed, fields)
        runs = merged(gone.column("blob")) if gone.num_rows else [np.zeros(0, np.int64)] * 4
        keys = _key(runs[0], runs[1])
        order = np.lexsort((runs[2], keys))
        keys, first, count = keys[order], runs[2][order], runs[3][order]
        ids_all, out, done = texts_of.column("doc_id").to_numpy().astype(np.int64) if texts_of.num_rows else np.zeros(0, np.int64), [], 0
        doubtful = _doubtful(ids_all)
        for column in texts_of.column("text").chunks:
            for texts in textops.chunks(column):
                ids = ids_all[done + texts.first : done + texts.first + len(texts)]
                mine = _key(ids, _tags(texts, ids, doubtful))
                low, high = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
                if windows.unit == "byte":
                    starts, firsts = None, texts.bounds
                else:
                    starts, ends, firsts = texts.words()
                change = np.zeros(firsts[-1] + 1, np.int64)
                at = textops.expand(low, high - low)
                base = np.repeat(firsts[:-1], high - low)
                np.add.at(change, base + first[at], 1)
                np.add.at(change, base + first[at] + count[at] + windows.length - 1, -1)
                removed = np.cumsum(change)[:-1] > 0
                out += describe(texts, ids, removed, firsts, None if starts is None else (starts, ends))
            done += len(column)
        columns = list(zip(*out, strict=True)) or [()] * len(schema)
        found = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        for i, c in enumerate(carry):
            found = found.append_column(c, texts_of.column(f"carry_{i}"))
        return found

    return run


def enough_buckets(docs: DataFrame, text_col: str, least: int) -> int:
    """How many buckets keep each at BUCKET_BYTES of text on average, least at least."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
    return max(least, -(-total // BUCKET_BYTES)) + 1


def remove_repeats(docs: DataFrame, windows: Windows, judge: Callable[[Shard], np.ndarray], describe: Callable, schema: pa.Schema, ddl: str, id_col: str, text_col: str, buckets: int | None = None, carry: list[str] | None = None) -> DataFrame:
    """describe(...) of each text without the windows that judge finds; see the module's text for the steps.

    buckets: into how many parts hashes and documents are dealt; by default one for each shuffle partition, and more if
    the texts are large for so few, as a bucket is held in memory. carry: columns of docs that stay with their rows.
    """
    carry = carry or []
    spark = docs.sparkSession
    bound_batches(spark)
    buckets = buckets or enough_buckets(docs, text_col, int(spark.conf.get("spark.sql.shuffle.partitions")))
    x = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id")
    texts = docs.select(x, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    carried = docs.select(x, F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)))
    dealt = lambda df: df.mapInArrow(lean(_dealt(buckets)), "part int, blob binary").groupBy("part")
    ddl += "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema) if carry else ""
    d = F.col("doc_id")
    part = F.pmod(d.bitwiseXOR(F.shiftright(d, 17)).bitwiseXOR(F.shiftright(d, 34)), F.lit(buckets)).cast("int")  # as _group()
    anchors = texts.select(part.alias("part"), "text").mapInArrow(_anchors(windows, buckets), "bucket int, blob binary")
    repeated = anchors.groupBy("bucket").applyInArrow(counts.repeated(buckets), "part int, blob binary")
    repeated = materialise(repeated)
    release_shuffles(spark)
    near = dealt(texts).cogroup(repeated.groupBy("part")).applyInArrow(lean_group(_neighbourhood_rows(windows, buckets, to_arrow_schema(texts.schema))), "bucket int, blob binary")
    gone = near.groupBy("bucket").applyInArrow(lean_group(_judge(windows, buckets, judge)), "part int, blob binary")
    gone = materialise(gone)
    release_shuffles(spark)
    return dealt(carried).cogroup(gone.groupBy("part")).applyInArrow(lean_group(_applied(windows, describe, schema, carry, to_arrow_schema(carried.schema))), ddl)

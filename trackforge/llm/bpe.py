"""Byte-level BPE encoding and decoding with a public vocabulary.

A pre-token's symbols form a doubly linked list. A priority queue holds the ranks of its adjacent pairs; the pair of
lowest rank (leftmost on ties) is merged, its neighbours' new pairs are queued, and entries whose symbols have
changed since are skipped. Decoding concatenates the vocabulary's strings.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from trackforge.llm.workers import bound_batches, kept, lean

#: Pre-tokens remembered in a Python worker; beyond that the memory is emptied and filled anew.
REMEMBERED = 600_000
ROWS = 256


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class BytePairCodec:
    """Encoder and decoder for a tokenizer file of the byte-level kind."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.raw = {c: b for b, c in enumerate(letters)}
        vocab = spec["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.of_byte = [vocab[c] for c in letters]
        self.strings: dict[int, bytes] = {i: self._bytes(s) for s, i in vocab.items()}
        self.strings |= {i: s.encode() for s, i in self.specials.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.pieces = regex.compile(pattern)
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.known: dict[str, bytes] = {}

    def _bytes(self, s: str) -> bytes:
        return bytes(self.raw[c] for c in s) if all(c in self.raw for c in s) else s.encode()

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ids = [self.of_byte[b] for b in piece]
        n = len(ids)
        if n == 1:
            return ids
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        merges, queue = self.merges, []
        for i in range(n - 1):
            if found := merges.get((ids[i], ids[i + 1])):
                queue.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, a, b, made = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # stale: one of the two has been merged meanwhile
            ids[i], ids[j] = made, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := merges.get((made, ids[k])):
                    heapq.heappush(queue, (found[0], i, made, ids[k], found[1]))
            if (h := before[i]) >= 0 and (found := merges.get((ids[h], made))):
                heapq.heappush(queue, (found[0], h, ids[h], made, found[1]))
        return [x for x in ids if x >= 0]

    def _packed(self, piece: str) -> bytes:
        out = np.array(self.merge(piece.encode()), "<u4").tobytes()
        if len(piece) <= 64:  # long ones hardly come again
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        get, packed, out = self.known.get, self._packed, []
        for part in self.parts.split(text) if self.parts else [text]:
            if part in self.specials:
                out.append(np.array([self.specials[part]], "<u4").tobytes())
            elif part:
                out += [get(p) or packed(p) for p in self.pieces.findall(part)]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        strings = self.strings
        return b"".join([strings[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_CODECS: dict[tuple[str, str], BytePairCodec] = {}
kept("bpe", _CODECS.clear)


def codec(path: str, pattern: str) -> BytePairCodec:
    """One codec for each vocabulary and Python worker."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = BytePairCodec(path, pattern)
    return _CODECS[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Each row of docs with its token count, the digests of ids and decoded text, and with keep_ids the packed ids.

    No shuffle; whole texts of any length. A null text counts as empty: no ids, the digest of no bytes. Repeated rows
    stay. Columns other than id and text aren't read. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                counts, ids_sha, text_sha, kept = [], [], [], []
                for text in pc.fill_null(batch.column(1), "").to_pylist():
                    ids = coder.encode(text)
                    counts.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
                    if keep_ids:
                        kept.append(ids)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())] + ([pa.array(kept, pa.binary())] if keep_ids else []), names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids)

    bound_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(lean(run, "bpe"), schema)

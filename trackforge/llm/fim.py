"""Fill-in-middle transformation: texts cut in three at random tokens and put in another order between marks.

Tokens are those of a Split pre-tokenizer whose regex matches stand alone; nothing is trained. Its code-point offsets
make one array for each text: the array's length is the number of tokens, and the offsets at the ranks that are drawn
are where the text is cut. Very long texts are tokenised in pieces that end between tokens.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from trackforge.llm.workers import bound_batches, lean

PIECE = 1 << 16  # code points that are tokenised at once
ROWS = 256
TOKENS = "[A-Za-z]+|[^A-Za-z]"
LETTERS = re.compile("[A-Za-z]*")


@dataclass(frozen=True)
class FillInMiddle:
    """Marks before prefix, suffix and middle; of 100 texts plain stay as they are, of 100 others spm begin with the suffix."""

    seed: int = 1
    plain: int = 10
    spm: int = 20
    marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")

    def draws(self, doc_id: int | None) -> list[int]:
        """Four 32-bit numbers from seed and id alone."""
        digest = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).digest()
        return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def splitter() -> pre_tokenizers.Split:
    return pre_tokenizers.Split(Regex(TOKENS), behavior="isolated")


def token_ends(text: str, split: pre_tokenizers.Split) -> np.ndarray:
    """Code-point offsets at which the tokens of a text end; a run of letters is never cut by a piece."""
    ends, at = [np.zeros(0, np.int64)], 0
    while at < len(text):
        to = at + PIECE
        if to < len(text) and text[to - 1].isascii() and text[to - 1].isalpha():
            to = LETTERS.match(text, to).end()
        pairs = split.pre_tokenize_str(text[at:to])
        ends.append(np.fromiter((end for _, (_, end) in pairs), np.int64, len(pairs)) + at)
        at = to
    return np.concatenate(ends)


def transformed(text: str, doc_id: int | None, how: FillInMiddle, split: pre_tokenizers.Split) -> tuple[int, str, int | None, int | None, str]:
    """Number of tokens, form, code points of prefix and middle, and the output."""
    ends = token_ends(text, split)
    n = len(ends)
    h1, h2, h3, h4 = how.draws(doc_id)
    if not text or any(m in text for m in how.marks) or h3 % 100 >= 100 - how.plain:
        return n, "plain", None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (int(ends[r - 1]) if r else 0 for r in (first, last))
    p, s, m = how.marks
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < how.spm:
        return n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def fill_in_middle(docs: DataFrame, how: FillInMiddle = FillInMiddle(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row of docs as doc_id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars and output.

    No shuffle; whole texts of any length. A null text counts as empty; empty texts and texts that hold a mark stay
    plain, with null for both lengths. Draws depend on seed and id alone, so that equal rows get equal outputs; a null
    id draws as if its decimal form were empty. Other columns aren't read. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                texts = pc.fill_null(batch.column(1), "").to_pylist()
                rows = [transformed(t, i, how, split) for i, t in zip(batch.column(0).to_pylist(), texts, strict=True)]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    bound_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(lean(run), schema)


def restored(output: Column, form: Column, how: FillInMiddle = FillInMiddle()) -> Column:
    """The text that output was made of. No part holds a mark, and none arises where parts meet: a mark's first character stands nowhere else in marks."""
    p, s, m = how.marks
    head, middle = F.substring_index(output, m, 1), F.substring_index(output, m, -1)

    def parted(opening: str, between: str) -> tuple[Column, Column]:
        first = F.substring_index(head, between, 1)
        return F.substr(first, F.lit(len(opening) + 1)), F.substring_index(head, between, -1)

    prefix, suffix = parted(p, s)
    last, first = parted(s, p)
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix)).otherwise(F.concat(first, middle, last))

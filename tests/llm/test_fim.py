"""Fill-in-middle against a plain version."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import corpus, documents, odd_texts
from trackforge.llm import fim

TOKEN = re.compile("[A-Za-z]+|[^A-Za-z]")


def plain(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    h = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(tokens)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    spm = h4 % 100 < 20
    return doc_id, n, "spm" if spm else "psm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_against_a_plain_version(spark):
    odd = [*odd_texts(), "a <P> in it", "<<", "<", "<S", "x<M", "\r\n\x00é漢字\U0001f600 ab", "<P", ">S>"]
    rows = list(enumerate((corpus(5, 60) + odd) * 3))
    rows += rows[:4]
    found = fim.fill_in_middle(documents(spark, rows).repartition(3))
    wanted = sorted((plain(i, t) for i, t in rows), key=repr)
    assert sorted(map(tuple, found.collect()), key=repr) == wanted
    assert {f for _, _, f, *_ in wanted} == {"plain", "psm", "spm"}
    back = found.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted((r.doc_id, r.text) for r in back) == sorted((i, t or "") for i, t in rows)


def test_parts_that_end_like_marks(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("<>PSMa ") for _ in range(rng.randint(1, 12)))) for i in range(3000)]
    found = fim.fill_in_middle(documents(spark, rows))
    back = {r.doc_id: r.text for r in found.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("text")).collect()}
    assert back == dict(rows)


@pytest.mark.parametrize("text", ["ab " * 60_000, "x" * 200_000, "é" * 70_000 + "y" * 70_000 + " z", "-" * 65_536 + "a"])
def test_pieces_end_between_tokens(text):
    ends = fim.token_ends(text, fim.splitter())
    assert ends.tolist() == [m.end() for m in TOKEN.finditer(text)]


def test_nulls_repeats_and_nothing(spark):
    rows = [(None, "a b c"), (None, "a b c"), (4, None), (4, None)]
    found = fim.fill_in_middle(documents(spark, rows)).collect()
    assert len(found) == 4 and len({(r.doc_id, r.output, r.form) for r in found}) == 2
    assert {(r.n, r.form) for r in found if r.doc_id == 4} == {(0, "plain")}
    assert fim.fill_in_middle(documents(spark, [])).count() == 0


def test_rates_follow_the_parameters(spark):
    rows = [(i, "one two three") for i in range(4000)]
    how = fim.FillInMiddle(seed=9, plain=40, spm=50)
    found = fim.fill_in_middle(documents(spark, rows), how).groupBy("form").count().collect()
    share = {r.form: r["count"] / 4000 for r in found}
    assert abs(share["plain"] - 0.4) < 0.04 and abs(share["spm"] - 0.3) < 0.04

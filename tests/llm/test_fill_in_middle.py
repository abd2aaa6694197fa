"""Cuts against the pattern itself, text by text; the query against its SQL."""

import hashlib
import random
import re

import numpy as np
import pytest
from clipwright.llm.fill_in_middle import BITS, WaveletMatrix, digests, draws, fill_in_middle, restored
from clipwright.llm.queries import OP13_SQL, op13_fill_in_middle
from pyspark.sql import functions as F
from tests.oracle import compare

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def expected(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n, (h1, h2, h3, h4) = len(units), draws(doc_id, 1)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    if h4 % 100 < 20:
        return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_query_equals_its_sql(spark, sf):
    compare(spark, sf, op13_fill_in_middle, OP13_SQL)


def test_odd_texts(spark):
    r = random.Random(3)
    texts = [None, "", "a", "<P>", "x <S> y", "<", "<<P", "P>S>M>", "é" * 40, "日本 a1\n\n b", "Z" * 70_000, "1" * 70_000, "\U0001f600 ok"]
    texts += ["".join(r.choice("aB <>PSM1\né日\U0001f600") for _ in range(r.randrange(200))) for _ in range(300)]
    rows = [(i, t, -1) for i, t in enumerate(texts)] + [(7, "again", 0), (7, "again", 0), (None, "no id", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = fill_in_middle(docs)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((expected(i, t) for i, t, _ in rows), key=repr)
    back = got.select("doc_id", restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert sorted((b.doc_id or -1, b.t) for b in back) == sorted((i or -1, t or "") for i, t, _ in rows)
    first = {x.doc_id: x for x in digests(docs).filter("doc_id = 8").collect()}[8]
    assert first.restored_sha256 == hashlib.sha256(texts[8].encode()).hexdigest()


def test_empty_table_and_other_settings(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fill_in_middle(docs).count() == 0
    docs = spark.createDataFrame([(i, "ab1é " * 5) for i in range(50)], docs.schema)
    rows = fill_in_middle(docs, seed=5, unit="character", cut_percent=100, suffix_first_percent=0, markers=("[p|", "[s|", "[m|")).collect()
    assert {x.form for x in rows} == {"psm"} and {x.n for x in rows} == {25}
    for x in rows:
        a, b = sorted(h % 26 for h in draws(x.doc_id, 5)[:2])
        assert (x.prefix_chars, x.middle_chars) == (a, b - a)
        assert x.output == "[p|" + ("ab1é " * 5)[:a] + "[s|" + ("ab1é " * 5)[b:] + "[m|" + ("ab1é " * 5)[a:b]


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_ranks_and_selection(n):
    symbols = np.random.default_rng(n).integers(0, 8, n).astype(np.uint8)
    matrix = WaveletMatrix(symbols, BITS)
    places = np.arange(n + 1)
    for some in [(3,), (0, 5), (1, 2, 3, 4, 6, 7)]:
        hits = np.isin(symbols, some)
        assert matrix.count(some, places).tolist() == [0, *np.cumsum(hits)]
        at = np.flatnonzero(hits)
        wanted = np.arange(1, len(at) + 2)
        ends = np.full(len(wanted), n)
        assert matrix.select(some, wanted, np.zeros(len(wanted), int), ends).tolist() == [*at, n]


@pytest.mark.parametrize("n", [63, 127, 64 * 20 + 63, 64 * 20 + 62, 64 * 20])
def test_place_found_at_the_end_while_others_are_open(n):
    symbols = np.random.default_rng(n).integers(0, 8, n).astype(np.uint8)
    matrix, some = WaveletMatrix(symbols, BITS), (1, 2, 3, 4, 6, 7)
    hits = np.isin(symbols, some)
    low, high = np.array([0, n // 3, n - 2, n]), np.array([n // 3, n, n, n])
    for k in range(1, n + 2):
        at = [low[i] + np.flatnonzero(hits[low[i] : high[i]]) for i in range(4)]
        wanted = np.array([hits[: low[i]].sum() + k for i in range(4)])
        assert matrix.select(some, wanted, low, high).tolist() == [at[i][k - 1] if k <= len(at[i]) else high[i] for i in range(4)]


@pytest.mark.parametrize("last", ["", None, "xyz"])
def test_passes_that_end_a_byte_short_of_a_word(spark, last):
    for n in (63, 127, 64 * 40 + 63):
        first = ("a1 é\n" * n).encode()[: n - len(last or "")].decode(errors="ignore")
        first += "q" * (n - len(last or "") - len(first.encode()))
        for i in range(0, 60, 20):
            rows = [(i, first), (i + 1, last)]
            got = fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
            assert list(map(tuple, got)) == [expected(*r) for r in rows]

"""Chunk recipes against hashing whole texts, with and without clashing chunk names."""

import hashlib
import random

import pytest
from clipwright.llm.common import table
from clipwright.llm.exact_dedup import MAX_CHUNK, MIN_CHUNK, chunked, drop_duplicates, exact_duplicates


def plain(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for doc_id, text in rows:
        ids = groups[text or ""]
        out.append((doc_id, max(ids), len(ids), doc_id == max(ids), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out)


def test_given_documents(spark, sf):
    docs = table(spark, sf, "documents")
    assert sorted(map(tuple, exact_duplicates(docs).collect())) == plain([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("bits", [64, 3])
def test_clashing_names_and_edges(spark, bits):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefgh ij\n") for _ in range(rng.choice([10, 300, 5000, 20000]))) for _ in range(12)]
    rows = [(i, rng.choice(base)) for i in range(40)]
    rows += [(100, None), (101, ""), (102, " "), (103, base[0] + "x"), (104, "x" + base[0]), (105, "z" * 30000), (106, "z" * 30000), (106, "z" * 30000), (107, "z" * 30001), (108, "é" * 5000)]
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, kept int")
    assert sorted(map(tuple, exact_duplicates(docs, bits).collect())) == plain(rows)


def test_chunks_rebuild_texts_whatever_stands_beside_them():
    rng = random.Random(4)
    texts = [rng.randbytes(n) for n in (0, 1, MIN_CHUNK, 5, 9000, MAX_CHUNK * 3, 700)]
    alone = {t: list(chunked([t]))[0][1] for t in texts}
    together = {t: p for t, (_, p) in zip(texts, chunked(texts), strict=True)}
    for t in texts:
        assert b"".join(alone[t]) == t and alone[t] == together[t]
        assert all(len(c) <= MAX_CHUNK for c in alone[t])


def test_empty_table_and_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, extra int")
    assert exact_duplicates(docs).count() == 0
    rows = spark.createDataFrame([(1, "a", 7), (2, "a", 8), (3, "b", 9)], "doc_id long, text string, keep_id int")
    kept = drop_duplicates(rows)
    assert kept.columns == rows.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]

"""Repeat removal against a dictionary of all 100-byte strings."""

import hashlib
import random

import pytest
from clipwright.llm import suffix_dedup
from clipwright.llm.common import table
from clipwright.llm.suffix_dedup import remove_repeats


def plain(rows):
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            s = data[p : p + 100]
            if s in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(s)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_given_documents(spark, sf):
    docs = table(spark, sf, "documents")
    assert sorted(map(tuple, remove_repeats(docs).collect())) == plain([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("segment", [1 << 20, 500])
def test_awkward_repeats(spark, monkeypatch, segment):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passage, line = word(260), word(99)
    rows = [(1, None), (2, ""), (3, "a" * 1500), (4, "ab" * 400), (5, "a" * 130), (6, word(50) + passage + word(70)), (7, passage), (8, passage[:140] + word(3) + passage[100:])]
    rows += [(9, line + word(10)), (10, word(10) + line), (11, line + "z"), (12, line + "z"), (13, (word(37) * 30)), (14, word(5) + passage[30:200]), (-5, passage[60:190] + word(400))]
    rows += [(20 + i, word(rng.randint(0, 60)) + passage[rng.randint(0, 60) : rng.randint(150, 260)] + word(60)) for i in range(40)]
    docs = spark.createDataFrame([(a, b, 0) for a, b in rows], "doc_id long, text string, n_bytes int")
    assert sorted(map(tuple, remove_repeats(docs).collect())) == plain(rows)


def test_repeated_rows_and_empty_table(spark):
    text = "".join(random.Random(1).choices("abcdef ", k=300))
    docs = spark.createDataFrame([(4, text), (4, text), (9, text)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed, r.kept.decode()) for r in remove_repeats(docs, with_text=True).collect())
    assert got == [(4, 0, text), (4, 0, text), (9, 300, "")]
    assert remove_repeats(docs.limit(0)).count() == 0


def test_null_ids_and_ids_beyond_double_precision(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    line, other, big = word(150), word(150), (1 << 53) + 1
    rows = [(None, word(30) + "x" + line), (big, line), (big + 1, word(20) + "y" + line), (None, other + word(9)), ((1 << 63) - 1, word(9) + other), (None, word(400))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = [(0, 150), (1, 0), (2, 150), (3, 150), (4, 0), (5, 0)]
    got = {(r.doc_id, r.kept_sha256): (r.n_bytes, r.n_removed) for r in remove_repeats(docs).collect()}
    kept = [(rows[i][0], rows[i][1].replace(line if i < 3 else other, "") if gone else rows[i][1], gone) for i, gone in want]
    assert got == {(i, hashlib.sha256(t.encode()).hexdigest()): (len(t) + gone, gone) for i, t, gone in kept}


@pytest.mark.parametrize(("many", "frequent"), [(1, 1_000_000), (4096, 1), (3, 4)])
def test_frequent_and_large_buckets(spark, monkeypatch, many, frequent):
    """Buckets dealt out window by window, some of them and all."""
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    monkeypatch.setattr(suffix_dedup, "FREQUENT", frequent)
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passage, line = word(240), word(118)
    rows = [(i, word(rng.randint(0, 90)) + passage[rng.randint(0, 90) : rng.randint(150, 240)] + word(rng.randint(0, 80)) + line) for i in range(60)]
    rows += [(100, passage), (101, "a" * 700), (102, line + line)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, remove_repeats(docs).collect())) == plain(rows)


def test_very_long_texts(spark):
    """Texts of several segments, with repeats across and within them."""
    rng = random.Random(12)
    word = lambda n: "".join(rng.choices("abcdefghijklmnop ", k=n))
    passage = word(3000)
    long = word(700_000) + passage + word(600_000) + passage[1000:2000] + word(90)
    rows = [(1, passage[500:900]), (2, long), (3, "x" + long[520_000:530_000] + "y"), (4, long[-70_000:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, remove_repeats(docs).collect())) == plain(rows)


def test_texts_of_one_doc_id_stay_apart(spark):
    rng = random.Random(13)
    word = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    line = word(150)
    rows = [(7, "b" + line), (7, word(300)), (8, line + "c"), (None, ""), (None, line + "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed) for r in remove_repeats(docs).collect())
    assert got == [(False, 7, 151, 0), (False, 7, 300, 0), (False, 8, 151, 150), (True, 0, 0, 0), (True, 0, 151, 150)]

"""Held-out accuracy, the kernel against sets of n-grams, and edge cases."""

import zlib

import numpy as np
from clipwright.llm.common import table
from clipwright.llm.language_id import RIDGE, Model, fit, gram_bits, identify, keep_identified, predict


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = {r.doc_id: r for r in identify(docs).collect()}
    rows = docs.select("doc_id", "lang").collect()
    assert len(got) == len(rows)
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [got[r.doc_id].lang_pred == r.lang for r in rows if got[r.doc_id].held_out]
    assert len(held) > 100 and np.mean(held) >= 0.95, np.mean(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_kernel_is_that_of_gram_sets():
    texts = ["abc abd", "abd xyz", "éa b", "12 ab"]
    (_, bits, known), *rest = gram_bits(texts)
    assert not rest and known.all()
    model = Model(bits, np.array(list("abcd"), object), np.arange(4))

    def grams(text):
        text = "".join(c if c.isalpha() else " " for c in text)
        return {text[i : i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1)}

    sets = [grams(t) for t in texts]
    want = [[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets]
    assert np.allclose(model.kernel(bits), want, atol=1e-6)


def test_edges(spark):
    rows = [(i, f"the cat and the dog number {i} went home", "en", 1) for i in range(40)] + [(100 + i, f"der hund und die katze gehen {i} nach haus", "de", 1) for i in range(40)]
    rows += [(200, None, "en", 0), (201, "", None, 0), (202, " 12,3 !", "de", 0), (203, "die katze 😀", None, 0), (203, "die katze 😀", None, 0), (204, "the dog " * 20000, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {}
    for r in identify(docs).collect():
        got.setdefault(r.doc_id, []).append(r.lang_pred)
    assert [got[i] for i in range(200, 205)] == [["und"], ["und"], ["und"], ["de", "de"], ["en"]]
    kept = keep_identified(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id >= 200").count() == 3
    assert identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in predict(docs, fit(docs.filter("lang is null"))).collect()} == {"und"}


def test_rows_of_one_id_do_not_fill_the_sample(spark):
    """A thousand rows of one doc_id count once; its least text is the one that is learnt from."""
    rows = [(7, f"the cat and the dog number {i:04d}", "en") for i in range(1000)] + [(100 + i, f"the cow and the horse {i}", "en") for i in range(30)]
    model = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), texts=20)
    assert 10 < model.marks.shape[1] <= 20


def test_decisions_are_those_of_kernel_ridge_regression():
    """With every row a landmark, the Nystrom form is ridge regression on the kernel itself; the
    bias is one more feature of ones."""
    texts = [f"the cat {i} and {'dog' if i % 2 else 'cow'} went home" for i in range(25)] + [f"der hund {i} und {'katze' if i % 3 else 'maus'} gehen" for i in range(25)]
    labels = np.array(["en"] * 25 + ["de"] * 25, object)
    (_, bits, _), *_ = gram_bits(texts)
    model = Model(bits, labels, np.arange(50))
    full = bits.astype(float)
    length = np.sqrt(full.sum(axis=1))
    kernel = full @ full.T / np.outer(length, length)
    rank = np.linalg.matrix_rank(kernel, tol=1e-6 * np.linalg.eigvalsh(kernel).max())
    ridge = RIDGE * 50 / (rank + 1)
    target = np.where(labels[:, None] == np.array(["de", "en"], object), 1.0, -1.0)
    want = (kernel + 1) @ np.linalg.solve(kernel + 1 + ridge * np.eye(50), target)
    assert np.allclose(model.scores(bits), want, atol=2e-3)

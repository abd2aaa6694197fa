"""Held-out accuracy, planted spellings, the kernel by enumeration, edge cases."""

import zlib
from itertools import combinations

import numpy as np
import pytest
from clipwright.llm.common import table
from clipwright.llm.toxicity import DECAY, SPAN, Projection, dense, detect, fit, plain_words, predict, tokens
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    return fit(docs.join(labels.filter("crc32(cast(string(doc_id) as binary)) % 3 <> 1"), "doc_id"))


def test_held_out_accuracy(spark, model):
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    held = docs.join(labels, "doc_id").filter("crc32(cast(string(doc_id) as binary)) % 3 = 1")
    rows = held.select("doc_id", "toxic").collect()
    got = {r.doc_id: r.predicted for r in predict(held, model).collect()}
    caught = np.mean([got[r.doc_id] for r in rows if r.toxic])
    false = np.mean([got[r.doc_id] for r in rows if not r.toxic])
    assert caught >= 0.88 and false <= 0.01, (caught, false)


def test_planted_spellings(spark, model):
    clean = "And therhean is the is esndha reedes ha only this atsh erin at ntreou"
    rows = [(i, f"{clean} {w} {clean}") for i, w in enumerate(["idiot", "IDIOT!", "id-iot", "m*o*r*o*n", "s c u m", "pathetic.", "patheetic", "diszgusting"])] + [(100, clean), (101, ""), (102, None), (103, "a b c d"), (104, "x" * 10000)]
    got = {r.doc_id: r.predicted for r in predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [got[i] for i in range(8)] == [1] * 8
    assert [got[i] for i in range(100, 105)] == [0] * 5


def test_insults_in_texts_without_spaces(spark, model):
    clean = "the weather is calm today and the report says {} about the plan for the week ahead"
    bad, good = clean.format("you idiot"), clean.format("nothing")
    forms = [lambda t: t, lambda t: t.replace(" ", ""), lambda t: t.replace(" ", "-"), lambda t: t.replace(" ", ","), lambda t: f"https://x.org/{t.replace(' ', '/')}?q=1", lambda t: t.replace(" ", "") * 300]
    rows = [(i, f(bad)) for i, f in enumerate(forms)] + [(100 + i, f(good)) for i, f in enumerate(forms)] + [(50, clean.format("calm/idiot")), (51, good.replace(" ", "") * 300 + "idiot")]
    got = {r.doc_id: r.predicted for r in predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert all(p == (i < 100) for i, p in got.items()), got


def test_score_by_a_direct_computation(spark, model):
    """Decisions by the kernel's features and score by the logistic function, word by word."""
    text = "you pathetic id-iot said the man, calm as ever"
    words = ["you", "pathetic", "id", "iot", "idiot", "said", "the", "man", "calm", "as", "ever"]
    d = dict(zip(words, model.decide(words), strict=True))
    tokens_ = [(d["you"],), (d["pathetic"],), (max(d["id"], d["iot"], d["idiot"]), min(d["id"], d["iot"])), (d["said"],), (d["the"],), (d["man"],), (d["calm"],), (d["as"],), (d["ever"],)]
    first = max(t[0] for t in tokens_)
    rest = sorted((x for t in tokens_ for x in t), reverse=True)
    second = rest[1]
    x = np.array([np.clip(first, -1, 3), np.clip(second, -1, 2), np.log1p(20) / 4, 1.0])
    (got,) = predict(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
    assert abs(got.score - 1 / (1 + np.exp(-x @ model.weights))) < 1e-9


def test_kernel_by_enumeration():
    words = ["aba", "abab", "idiot", "idxiot", "élan", "bbb"]

    def features(word):
        word, out = f"^{word}$", {}
        for c in combinations(range(len(word)), 3):
            if c[2] - c[0] < SPAN:
                key = "".join(word[i] for i in c)
                out[key] = out.get(key, 0) + DECAY ** (c[2] - c[0] + 1)
        return out

    def kernel(a, b):
        a, b = features(a), features(b)
        dot = lambda x, y: sum(v * y.get(k, 0) for k, v in x.items())
        return dot(a, b) / np.sqrt(max(dot(a, a), 1e-12) * max(dot(b, b), 1e-12))

    used, rows = dense(words)
    want = [[kernel(a, b) for b in words] for a in words]
    assert np.allclose(rows @ rows.T, want, atol=1e-5)
    assert np.allclose(Projection(used, rows.T.astype(float))(words), want, atol=1e-5)


def test_words():
    assert plain_words("M*o-r.o_N1!")[-1] == "moron" and plain_words("123") == [] and plain_words("x" * 900) == ["x" * 900]
    assert plain_words("calm/idiot") == ["calm", "idiot", "calmidiot"]
    assert plain_words("a-very-very-long-way-i-d-i-o-t-to-say-so")[-1] == "idiot"
    assert "scum" in tokens("you s c u m here") and tokens("") == set()


def test_query_contract_and_edges(spark):
    filler = [" ".join(f"{chr(97 + (i * 7 + k) % 26)}{chr(97 + (i + 3 * k) % 26)}ra" for k in range(8)) for i in range(60)]
    docs = spark.createDataFrame([(i, f"calm words stand {filler[i]}" if i % 2 else f"{filler[i]} worthless clown", 3) for i in range(60)] + [(70, None, 1), (71, "", 1), (71, "", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, 1, 1 - i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    got = detect(docs, labels).collect()
    assert len(got) == 63 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(r.predicted == (1 if r.doc_id < 60 and r.doc_id % 2 == 0 else 0) for r in got)
    none = detect(docs, labels.limit(0)).collect()
    assert len(none) == 63 and not any(r.predicted for r in none)
    assert detect(docs.limit(0), labels).count() == 0


def test_a_giant_text_takes_no_other_out_of_the_sample(spark):
    rows = [(i, f"quiet {chr(97 + i % 26)}ara {chr(97 + i % 7)}olo stones lie by {chr(97 + i % 11)}una", 0) for i in range(60)]
    rows += [(100 + i, f"{chr(97 + i % 26)}ara {chr(97 + (3 * i) % 26)}ine worthless {chr(97 + (5 * i) % 26)}otu clown", 1) for i in range(60)]
    giant = [(-1, "stone " * 2_000_000, 1), (-2, "stone " * 2_000_000, 0)]
    asked = [(1, "a worthless one"), (2, "quiet stones"), (3, "you clown"), (4, "stone " * 2_000_000 + "worthless clown")]
    docs, schema = spark.createDataFrame(asked, "doc_id long, text string"), "doc_id long, text string, toxic int"

    def told(rows, parts):
        model = fit(spark.createDataFrame(rows, schema).repartition(parts))
        return {r.doc_id: (r.score, r.predicted) for r in predict(docs, model).collect()}

    plain, first, last = told(rows, 1), told(giant + rows, 1), told(rows[::-1] + giant, 5)
    assert [plain[i][1] for i in (1, 2, 3, 4)] == [1, 0, 1, 1]
    for got in (first, last):
        assert all(got[i][1] == plain[i][1] and abs(got[i][0] - plain[i][0]) < 1e-6 for i in plain)


def test_sample_is_a_prefix_in_hash_order(spark, monkeypatch):
    seen = []
    monkeypatch.setattr("clipwright.llm.toxicity.Model", lambda chosen: seen.append(chosen))
    rows = [(i, f"text{i:03d} " + "x" * (i % 5), i % 2) for i in range(80)]
    docs = spark.createDataFrame(rows + [rows[3]] * 5, "doc_id long, text string, toxic int")
    order = [r.doc_id for r in docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id")).collect()]
    for frame in (docs.coalesce(1), docs.repartition(7, "text")):
        fit(frame, characters=400, learnt=11)
        want = []
        for label in (1, 0):
            held = 0
            for i in (i for i in order if i % 2 == label and len(rows[i][1]) <= 11):
                held += len(rows[i][1])
                if held > 200:
                    break
                want.append((rows[i][1], label))
        assert seen.pop() == want


def test_texts_too_long_to_learn_from_leave_scores(spark):
    """A label all of whose texts are too long teaches nothing; every row is scored all the same."""
    rows = [(i, ("you idiot " if i % 2 else "kind words ") + "and more " * (50 if i % 2 else 1), i % 2) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = predict(docs, fit(docs, learnt=60)).collect()
    assert len(got) == 12 and {r.predicted for r in got} == {0} and all(0 <= r.score <= 1 for r in got)

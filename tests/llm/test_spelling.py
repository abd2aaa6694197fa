"""Near words against all pairs; the query against its SQL."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from clipwright.llm.queries import OP12_SQL, op12_spelling
from clipwright.llm.spelling import _codes, corpus_words, groups, near_pairs, near_words, variants
from tests.oracle import compare


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def expected(counts, least=2, ratio=10):
    words = {w: n for w, n in counts.items() if n >= least}
    near = {w: sorted((v for v in words if one_edit(v, w)), key=lambda v: (-words[v], v)) for w in words}
    form = {w: near[w][0] if near[w] and words[near[w][0]] >= ratio * words[w] else None for w in words}
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, words[w], len(near[w]), form[w], words[form[w]] if form[w] else None, root))
    return sorted(out, key=repr)


def test_query_equals_its_sql(spark, sf):
    compare(spark, sf, op12_spelling, OP12_SQL)


@pytest.mark.parametrize("alphabet", ["ab", "abé\U00010400", "abcdefgh"])
def test_walk_equals_all_pairs(alphabet):
    r = random.Random(len(alphabet))
    words = sorted({"".join(r.choice(alphabet) for _ in range(r.randrange(8))) for _ in range(400)})
    # Two groups that hold the same words: no pair goes across.
    codes, offsets = _codes(words + words)
    group = np.repeat([0, 1], len(words))
    got = [(int(a), int(b)) for q, w in near_pairs(codes, offsets, group, np.arange(2 * len(words))) for a, b in zip(q, w, strict=True)]
    want = {(i + k, j + k) for i, a in enumerate(words) for j, b in enumerate(words) if one_edit(a, b) for k in (0, len(words))}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("hot", [20_000, 3])
def test_variants_equal_brute_force(spark, hot):
    """Words with much in common at either end, long ones, and every group dealt out again."""
    r = random.Random(hot)
    long = 3000 if hot > 100 else 60
    counts = {"": 5, "a": 50, "ab": 1, "tie" * 3: 100, "tie" * 3 + "x": 5, "tie" * 3 + "y": 5, "z" * long: 40, "z" * (long - 1): 4, "z" * (long - 10) + "y" + "z" * 9: 2}
    for stem in ("prefixprefix", "ähnlichkeit", "aaaaaaaaaaaa", ""):
        for _ in range(80):
            tail = "".join(r.choice("abc") for _ in range(r.randrange(2, 6)))
            for word in (stem + tail, tail + stem):
                counts[word] = r.choice([1, 2, 3, 30, 400, 5000])
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = variants(words, hot=hot).collect()
    assert sorted(((x.word, x.n, x.n_near, x.form, x.form_n, x.root) for x in got), key=repr) == expected(counts)
    if hot == 3:
        settled = groups(words, hot)
        assert settled.filter("pre > 0 AND suf > 0").count() > 0
        assert near_words(words, hot).count() == near_words(words).count()


def test_words_of_texts(spark):
    texts = [None, "", "Hello WORLD wonderful wonderful", "ÀÉÎÔÛàé ×÷×÷×÷× naïveté's", "Ÿellowish yellowish " * 200, "a" * 3_000_000, ("lengthy " * 300_000), "٣٣٣٣٣٣٣"]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(2, texts[2], 0), (None, "wonderful", 0), (8, "wonderfully", 0)]
    got = {x.word: x.n for x in corpus_words(spark.createDataFrame(rows, "doc_id long, text string, word int")).collect()}
    want = Counter()
    for i, t, _ in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        run = ""
        for c in low + " ":
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if h % 31 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                if len(run) >= 7:
                    want[run] += 1
            run = ""
    assert got == want


def test_no_words(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert variants(corpus_words(docs)).count() == 0
    assert variants(spark.createDataFrame([(None, 9)], "word string, n long")).count() == 0
    with pytest.raises(ValueError, match="ratio"):
        variants(spark.createDataFrame([("a", 9)], "word string, n long"), ratio=1)

"""Rarest-label-first folds against a version that places one row at a time."""

import hashlib
import random
from collections import Counter

import pandas as pd
import pytest
from clipwright.operators.stratify import dealt, iterative_folds, multilabel_split, plan
from clipwright.plans.dataset import annotations


def one_by_one(wanted, n, overall):
    wanted, overall, given = list(wanted), list(overall), [0] * len(wanted)
    for _ in range(n):
        f = max(range(len(wanted)), key=lambda f: (round(wanted[f], 9), round(overall[f], 9), -f))
        given[f] += 1
        wanted[f] -= 1
        overall[f] -= 1
    return given


def test_levelling_equals_one_row_at_a_time():
    r = random.Random(1)
    for _ in range(3000):
        k = r.randrange(1, 6)
        wanted = [r.choice([r.randrange(-5, 30), r.random() * 20]) for _ in range(k)]
        overall = [r.randrange(0, 50) for _ in range(k)]
        n = r.randrange(0, 40)
        got, want = dealt(wanted, n, overall), one_by_one(wanted, n, overall)
        assert sum(got) == n
        # Of folds that want equally much after whole steps, either may be the one.
        rest = lambda g: sorted(round(w - x, 6) for w, x in zip(wanted, g, strict=True))
        assert rest(got) == rest(want), (wanted, n, overall)


def test_rows_equal_plain_python(spark, sf):
    rows = annotations(spark, sf).select("clip_id", "emotion", "language", "genre")
    labels, shares = ["emotion", "language", "genre"], [1 / 3] * 3
    got = {x.clip_id: x.fold for x in iterative_folds(rows, "clip_id", labels, shares, 42).collect()}
    local = [(r.clip_id, tuple("" if x is None else f"={x}" for x in r[1:])) for r in rows.collect()]
    table = pd.DataFrame([(*k, n) for k, n in sorted(Counter(x for _, x in local).items())], columns=[*labels, "n"])
    want = {}
    for combination, counts in zip(table[labels].itertuples(index=False, name=None), plan(table, labels, shares), strict=True):
        mine = sorted((k for k, x in local if x == combination), key=lambda k: (hashlib.md5(f"{k}:42".encode()).hexdigest(), k))
        folds = [f for f, n in enumerate(counts) for _ in range(n)]
        want |= dict(zip(mine, folds, strict=True))
    assert got == want
    for c in range(3):
        for value, n in Counter(x[c] for _, x in local).items():
            each = Counter(got[k] for k, x in local if x[c] == value)
            assert all(abs(each[f] - n / 3) <= 1.01 for f in range(3)), (labels[c], value, each)


def test_no_rows_nulls_and_names(spark):
    schema = "k long, a string, b string"
    assert iterative_folds(spark.createDataFrame([], schema), "k", ["a", "b"], [0.5, 0.5], 1).count() == 0
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else "x", "y" if i % 50 == 0 else None) for i in range(200)], schema)
    got = multilabel_split(rows, "k", ["a", "b"], ["train", "val", "test"], [0.7, 0.2, 0.1], 3).collect()
    sizes = Counter(x.split for x in got)
    assert sum(sizes.values()) == 200 and abs(sizes["train"] - 133) <= 2 and sizes["val"] > sizes["test"] > 0


@pytest.mark.parametrize("seed", range(5))
def test_every_label_near_its_demand(seed):
    r = random.Random(seed)
    rows = [(r.choices("abcdefgh", [40, 25, 12, 10, 6, 4, 2, 1])[0], r.choice("ve"), r.choices("mnop", [8, 4, 2, 1])[0]) for _ in range(3000)]
    table = pd.DataFrame([(*k, n) for k, n in sorted(Counter(rows).items())], columns=["a", "b", "c", "n"])
    shares = [0.25] * 4
    given = plan(table, ["a", "b", "c"], shares)
    for c in "abc":
        for value in set(table[c]):
            at = table.index[table[c] == value]
            for f in range(4):
                assert abs(sum(given[i][f] for i in at) - table["n"][at].sum() / 4) <= 3

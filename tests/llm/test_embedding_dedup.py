"""Recall and exactness against all pairs."""

import numpy as np
from clipwright.llm.common import table
from clipwright.llm.embedding_dedup import near_duplicates


def plain(rows, threshold=0.93):
    """{vec_id: links}, and the component of each, by all pairs."""
    good = []
    for vec_id, v, label in rows:
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            good.append((vec_id, label, x / np.linalg.norm(x)))
    links = {}
    for a, la, x in good:
        for b, lb, y in good:
            if a < b and la == lb and len(x) == len(y) and x @ y >= threshold:
                links.setdefault(a, set()).add(b)
                links.setdefault(b, set()).add(a)
    return links


def test_recall_on_given_vectors(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "embeddings").select("vec_id", "embedding", "label").collect()]
    want = plain(rows)
    got = {r.vec_id: r for r in near_duplicates(table(spark, sf, "embeddings")).collect()}
    assert len(got) == len(rows)
    assert all(r.n_links <= len(want.get(i, ())) for i, r in got.items())
    assert sum(r.n_links for r in got.values()) >= 0.9 * sum(map(len, want.values()))
    assert all(r.kept == (r.component_id == i) and r.component_id <= i for i, r in got.items())


def test_recall_on_pairs_planted_among_given_vectors(spark, sf):
    """Partners of the given vectors at cosines of 0.931 to 0.95, where links are hardest to find."""
    given = [(r.vec_id, np.array(r.embedding, np.float64), r.label) for r in table(spark, sf, "embeddings").collect()]
    rng, rows = np.random.default_rng(9), []
    for vec_id, v, label in given:
        v = v / np.linalg.norm(v)
        aside = rng.standard_normal(len(v))
        aside -= (aside @ v) * v
        c = rng.uniform(0.931, 0.95)
        other = c * v + np.sqrt(1 - c * c) * aside / np.linalg.norm(aside)
        rows += [(vec_id, v.tolist(), label), (100_000 + vec_id, other.tolist(), label)]
    got = {r.vec_id: r.n_links for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert sum(got[100_000 + i] > 0 for i, _, _ in given) >= 0.97 * len(given)


def test_recall_near_the_threshold_and_a_hot_group(spark):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(60):
        centre = rng.standard_normal(48)
        centre /= np.linalg.norm(centre)
        for _ in range(600 if c == 0 else 4):
            noise = rng.standard_normal(48)
            noise /= np.linalg.norm(noise)
            rows.append((len(rows), [float(x) for x in centre + noise * rng.uniform(0.05, 0.3)], c % 2))
    rows += [(5000, rows[700][1], rows[700][2]), (5001, rows[700][1], rows[700][2]), (5002, rows[700][1], 1 - rows[700][2])]
    want = plain(rows)
    got = {r.vec_id: r for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert all(r.n_links <= len(want.get(i, ())) for i, r in got.items())
    assert sum(r.n_links for r in got.values()) >= 0.93 * sum(map(len, want.values()))
    assert got[5001].component_id == got[700].component_id == got[5000].component_id and got[5002].n_links == 0


def test_unusable_vectors_and_empty_table(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, [2.0, 4.0, 6.0], 1), (3, v, None), (4, None, 1), (5, [0.0] * 3, 1), (6, [1.0, None, 3.0], 1), (7, [float("nan"), 2.0, 3.0], 1), (8, [float("inf"), 2.0, 3.0], 1), (9, v, 2), (10, [1.0, 2.0], 1), (11, [], 1), (12, v, 1), (-1, [-1.0, -2.0, -3.0], 1)]
    table_ = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int, kept int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(table_).collect()}
    assert got == {i: (0, i, True) for i, _, _ in rows} | {1: (2, 1, True), 2: (2, 1, False), 12: (2, 1, False)}
    assert near_duplicates(table_.limit(0)).count() == 0

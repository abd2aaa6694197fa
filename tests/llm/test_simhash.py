"""SimHash against all pairs on a fixture, and the defined edge cases."""

from itertools import combinations

import numpy as np
import pytest
import xxhash
from clipwright.llm.common import connected_components, table
from clipwright.llm.simhash import families, fingerprint, keep_one_per_component, links, near_duplicates


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(ids, fps, bits=4):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                parent[root(i)] = root(j)
    least = {}
    for i in range(len(ids)):
        least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return [least[root(i)] for i in range(len(ids))]


def test_given_documents_match_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicates(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    comps = plain_components([r.doc_id for r in rows], fps)
    assert got == {r.doc_id: (f"{f:016x}", c) for r, f, c in zip(rows, fps, comps, strict=True)}


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "A b", "a b c d", "É\x1fÀ x\x0by Z  w q", "a b c d e " * 50, "  nbsp x y z w"])
def test_fingerprint_edges(text):
    assert fingerprint((text or "").encode()) == plain_fingerprint(text)


def test_links_lose_no_pair(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 2**63, 12)]
    fps = {0, (1 << 64) - 1}
    for b in base:
        for _ in range(25):
            flips = rng.choice(64, rng.integers(0, 7), replace=False)
            fps.add(b ^ sum(1 << int(i) for i in flips))
    fps = sorted(fps)
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    for block in (1024, 3):
        monkeypatch.setattr("clipwright.llm.simhash.BLOCK", block)
        found = links(spark.createDataFrame(rows, "rep long, fp long"))
        named = {r.node: r.component for r in connected_components(found).collect()}
        assert [named.get(i, i) for i in range(len(fps))] == plain_components(list(range(len(fps))), fps)


@pytest.mark.parametrize("least", range(1, 9))
def test_any_shared_positions_hold_a_list(least):
    for shared in combinations(range(8), least):
        assert any(set(g) <= set(shared) for g in families(least))
    assert len(families(4)) == 20


def test_edges_of_the_operator(spark):
    rows = [(5, None, 1), (3, "", 2), (9, " \n", 3), (7, "alpha beta", 4), (8, "ALPHA  beta", 5), (8, "ALPHA  beta", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted((r.doc_id, r.component_id) for r in near_duplicates(docs).collect())
    assert got == [(3, 3), (5, 3), (7, 7), (8, 7), (8, 7), (9, 3)]
    assert {r.fingerprint for r in near_duplicates(docs).collect() if r.component_id == 3} == {"0" * 16}
    assert near_duplicates(docs.limit(0)).count() == 0
    kept = keep_one_per_component(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 7]


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(260, 7), (1, 260)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 1 for i in [1, 7, *range(200, 261)])

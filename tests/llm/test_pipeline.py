"""The pipeline against a brute-force version of its stages on a small table."""

import sys
import zlib
from pathlib import Path

import numpy as np

sys.path[:0] = [str(Path(__file__).resolve().parents[2]), str(Path(__file__).resolve().parent)]

import corpus_pipeline
from clipwright.llm.packing import default_path
from clipwright.llm.secrets import masked
from test_simhash import plain_components, plain_fingerprint
from tokenizers import Tokenizer


def test_stages_on_the_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = [(9001, None, None, "x", 0), (9002, "123 -- 456", None, "x", 0), (9003, "", "en", "x", 0), (9004, "a planted line with token = abcdef0123456789 in it", "en", "x", 0)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    before, last = docs, None
    kept = {r.doc_id: r.text for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, sf)
        if name == "packing":
            last = out
            break
        assert out.columns == docs.columns, name
        got = {r.doc_id: r.text for r in out.collect()}
        if name == "exact_dedup":
            newest = {}
            for i, t in kept.items():
                newest[t] = max(i, newest.get(t, i))
            kept = {i: t for i, t in kept.items() if newest[t] == i}
        if name == "near_dedup":
            ids = list(kept)
            named = plain_components(ids, [plain_fingerprint(kept[i]) for i in ids])
            kept = {i: kept[i] for i, c in zip(ids, named, strict=True) if i == c}
        if name == "secrets":
            assert set(got) == set(kept)
            assert sum(t != kept[i] for i, t in got.items()) > 0
            assert all("[secret]" in t for i, t in got.items() if t != kept[i])
            kept = got
        assert got == kept, name
        before = out
    tokenizer, parts = Tokenizer.from_file(default_path()), {}
    for r in last.collect():
        parts.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    assert set(parts) == set(kept)
    for i, text in kept.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in parts[i])
        assert sum(n for _, n, _ in parts[i]) == len(ids)


def test_run_and_empty_tables(spark, sf, tmp_path):
    assert corpus_pipeline.run(spark, sf).count() > 0
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0, name
    assert masked(empty).count() == 0


def test_rows_are_judged_by_themselves(spark):
    from clipwright.llm.exact_dedup import drop_duplicates
    from clipwright.llm.language_id import keep_identified
    from clipwright.llm.simhash import keep_one_per_component

    schema = "doc_id long, text string, lang string, n int"

    def kept(stage, rows):
        out = stage(spark.createDataFrame([(i, t, "en", n) for n, (i, t) in enumerate(rows)], schema))
        assert out.columns == ["doc_id", "text", "lang", "n"]
        return sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)

    assert kept(keep_identified, [(1, "some words"), (None, "more words"), (2, None), (2, "words"), (3, "12"), (1, "")]) == [(1, "some words"), (2, "words"), (None, "more words")]
    assert kept(drop_duplicates, [(5, "A"), (5, "B"), (7, "A"), (7, "A"), (None, "A"), (None, "C"), (None, "C"), (None, "D")]) == [(5, "B"), (7, "A"), (None, "C"), (None, "D")]
    a, b, c = "alpha beta", "gamma delta", "other words"
    assert kept(keep_one_per_component, [(5, a), (7, a), (5, b), (3, b), (7, b), (3, b), (None, a), (None, c), (None, c)]) == [(3, b), (5, a), (None, c)]

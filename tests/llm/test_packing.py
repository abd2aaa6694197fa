"""Ids against the tokenizer itself; packing against its own rules and an exact round trip."""

import zlib

import numpy as np
from clipwright.llm.common import table
from clipwright.llm.packing import CAPACITY, document_pieces, pack, sequences
from clipwright.llm.token_ids import UnitEncoder, default_path
from tokenizers import Tokenizer

ODD = ["", " ", "Don't stop, o'clock 's 'll", "İstanbul ŉ Σας ΟΔΟΣ.", "a\tb\x0bc\x1fd e f", "x.,y ,. a.. (b.) é́", "<|endoftext|> a<|startoftext|>b", "naïve Ærø µm ªº", "日本語テキスト " * 3, "42nd 1,000.5", "ﬁne École", "A." + "q" * 500, "😀 ok."]


def expected(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_ids_are_those_of_the_tokenizer(spark, sf):
    tokenizer = Tokenizer.from_file(default_path())
    texts = ODD + [r.text for r in table(spark, sf, "documents").select("text").collect()]
    coder = UnitEncoder(default_path())
    for _ in range(2):
        for text, ids in zip(texts, coder.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == expected(tokenizer, text)[:-1], text


def test_pieces_cover_every_length():
    for n in range(1, 5000):
        cut = document_pieces(n)
        assert sum(cut) == n and all(0 < x <= CAPACITY for x in cut)


def test_packing_and_round_trip(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    extra = [(-1, None), (-2, ""), (-3, "two words"), (-3, "two words"), (-4, "é " * 9000)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    placed = pack(docs)
    rows = placed.collect()
    tokenizer = Tokenizer.from_file(default_path())
    want = {}
    for r in docs.collect():
        want[r.doc_id] = expected(tokenizer, r.text)
    by_doc, by_sequence = {}, {}
    for r in rows:
        part = want[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(want[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == set(want)
    for doc_id, cut in by_doc.items():
        if doc_id == -3:
            assert len(cut) == 2
            continue
        at = 0
        for start, length in sorted(cut):
            assert start == at
            at += length
        assert at == len(want[doc_id])
    total = padding = 0
    for cut in by_sequence.values():
        at = 0
        for offset, length in sorted(cut):
            assert offset == at
            at += length
        assert at <= CAPACITY
        total += at
        padding += 0 if at.bit_count() == 1 else CAPACITY - at
    assert padding <= 0.03 * total, (padding, total)
    made = {r.sequence_id: r for r in sequences(docs, placed).collect()}
    for r in rows:
        if r.doc_id != -3:
            assert made[r.sequence_id].ids[r.offset : r.offset + r.length] == want[r.doc_id][r.start : r.start + r.length]
    assert all(len(r.ids) == CAPACITY or len(r.ids).bit_count() == 1 for r in made.values())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, start int, offset int")
    assert pack(docs).count() == 0

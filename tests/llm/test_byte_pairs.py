"""Ids against the tiktoken library, decoding against the texts."""

import base64
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from clipwright.llm.byte_pairs import Encoder, decode, default_path, default_pattern, document_digests, encode, stretches
from clipwright.llm.common import flat_bytes, table

ODD = "aabbcdeéñ  \n\t 　 \u0085\x1c\x0b'sltre.,-1٣日本\U0001f600<|>xyz̀ßÀ​\U00010ee7"


@pytest.fixture(scope="module")
def library():
    with open(default_path(), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=default_pattern(), mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    r = random.Random(1)
    texts = [None, "", "a" * 3000, " " * 300 + "x", "ab" * 1500, "<|endoftext|> a", "I'll 've 'LL", "x\r\n\r\n y", "é  　 b"]
    texts += ["".join(r.choice(ODD) for _ in range(r.randrange(60))) for _ in range(3000)]
    return texts + ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2000))) for _ in range(30)]


def test_ids_are_those_of_the_library(spark, sf, library):
    texts = odd_texts() + [r.text for r in table(spark, sf, "documents").select("text").collect()]
    texts += [chr(c) + " " + chr(c) + "a 1" + chr(c) for c in [*range(0xD800), *range(0xE000, 0x20000)]]
    coder = Encoder(default_path(), default_pattern())
    for _ in range(2):
        ids, bounds = coder.encode(pa.array(texts))
        for text, a, b in zip(texts, bounds, bounds[1:], strict=False):
            assert ids[a:b].tolist() == library.encode_ordinary(text or ""), text


def test_one_word_of_a_million_bytes(library):
    word = "".join(random.Random(2).choices("abcdeilnorst", k=1 << 20))
    coder = Encoder(default_path(), default_pattern())
    ids, _ = coder.encode(pa.array([word]))
    assert b"".join(library.decode_single_token_bytes(i) for i in ids.tolist()) == word.encode()
    # Cut between tokens that are far apart, the library's own ids are the same.
    assert ids[:2000].tolist() == library.encode_ordinary(word[:20_000])[:2000]
    assert not coder.recent


def test_a_new_pair_of_lower_rank_goes_first():
    coder = Encoder(default_path(), default_pattern())
    m = coder.merges
    # a, b, c are 0 to 2; ab has rank 9, aba the lower rank 4, abab 20.
    m.joined = {(0, 1): 9, (9, 0): 4, (9, 9): 20, (4, 1): 20}
    m.byte_ids = np.array([{97: 0, 98: 1, 99: 2}.get(i, -1) for i in range(256)])
    m.of_bytes = np.full(65536, 1 << 30)
    m.of_bytes[97 * 256 + 98] = 9
    # As the library would: ab first, then aba (rank 4) before the second ab, then abab.
    assert np.frombuffer(m.replay([b"abab"])[0], "<u4").tolist() == [20]
    assert np.frombuffer(m.replay([b"ababc"])[0], "<u4").tolist() == [20, 2]
    assert np.frombuffer(m.replay([b"abaab"])[0], "<u4").tolist() == [4, 9]


def test_stretches_tile_the_texts():
    texts = odd_texts()
    data, offsets = flat_bytes(pa.array(texts))
    cuts = set(stretches(data, offsets).tolist())
    assert {a for a, b in zip(offsets, offsets[1:], strict=False) if b > a} <= cuts
    assert len(stretches(*flat_bytes(pa.array([], pa.string())))) == 0


def test_documents_and_round_trip(spark, sf, library):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    extra = [(-1, None), (-2, ""), (-3, "two words"), (-3, "two words"), (None, "no id"), (-4, "é " * 90_000)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema)).selectExpr("*", "1 AS ids", "2 AS n_tokens")
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    want = []
    for doc_id, text in texts:
        ids = library.encode_ordinary(text)
        want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, document_digests(docs).collect()), key=repr) == sorted(want, key=repr)
    back = decode(encode(docs)).collect()
    assert sorted((r.doc_id or 0, bytes(r.data)) for r in back) == sorted((i or 0, t.encode()) for i, t in texts)


def test_empty_table_and_unknown_ids(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert document_digests(docs).count() == 0 and decode(encode(docs)).count() == 0
    rows = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [bytes(r.data) for r in decode(rows).collect()] == [b"", b""]
    with pytest.raises(Exception, match="not in the vocabulary"):
        decode(spark.createDataFrame([(1, [1 << 28])], "doc_id long, ids array<int>")).collect()

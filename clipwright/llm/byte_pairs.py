"""Byte-level BPE: encoding by a replay of merges over whole slices of a corpus, and decoding.

The distinct words of a slice of texts are laid out as one row of byte tokens. An inverted
index holds, for every pair of tokens that a merge joins, the places in all words where it
stands, under the merge's rank. The merges are replayed in rank order: the places of one
rank are joined, and of the index only the pairs with a joined token's neighbours change.
A join costs the same in a word of ten bytes or of ten million.

Texts are cut before white space that follows something else, where no match of the
pattern goes on; these stretches recur, so each is matched and encoded once and kept in a
bounded cache. Slices are those of Spark's own tasks: the same distinct words are replayed
in several of them, but no occurrence is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipwright.llm.common import flat_bytes, passes

#: Bytes of text taken at a time, bytes of words replayed together, places laid out together.
SLICE_BYTES, REPLAY_BYTES, LAID = 8 << 20, 4 << 20, 1 << 22
#: Stretches kept in each of the two generations of the cache, and the longest one kept, in bytes.
CACHED, CACHED_LENGTH = 300_000, 64
#: Rank of a pair that no merge joins.
NONE = 1 << 30


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Merges:
    """The merges of one vocabulary file: token bytes and their ranks, which are the ids."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        get = self.ranks.get
        #: The rank under which two neighbouring tokens are joined.
        self.joined = {
            (left, right): rank
            for token, rank in self.ranks.items()
            for cut in range(1, len(token))
            if (left := get(token[:cut])) is not None and (right := get(token[cut:])) is not None
        }
        self.byte_ids = np.array([get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.byte_ids < 0).any():
            raise ValueError(f"{path} lacks tokens of single bytes")
        self.of_bytes = np.full(65536, NONE, np.int64)
        for b in range(65536):
            self.of_bytes[b] = get(bytes(divmod(b, 256)), NONE)
        size = max(self.ranks.values()) + 1
        pieces: list[bytes] = [b""] * size
        for token, rank in self.ranks.items():
            pieces[rank] = token
        self.text, self.decimal = Pool(pieces), Pool([b"%d," % i for i in range(size)])

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The ids of every word (none empty), as little-endian unsigned 32-bit numbers."""
        out: list[bytes] = []
        for a, b in passes(list(map(len, words)), REPLAY_BYTES):
            out += self._replay(words[a:b])
        return out

    def _replay(self, words: list[bytes]) -> list[bytes]:
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        ranks = np.full(len(data), NONE, np.int64)
        ranks[:-1] = self.of_bytes[data[:-1].astype(np.int64) * 256 + data[1:]]
        ranks[ends - 1] = NONE
        before, after = np.arange(-1, len(data) - 1), np.arange(1, len(data) + 1)
        before[np.concatenate(([0], ends[:-1]))] = after[ends - 1] = -1

        # The inverted index: places of every rank, in order.
        places = np.flatnonzero(ranks < NONE)
        places = places[np.argsort(ranks[places], kind="stable")]
        found, starts = np.unique(ranks[places], return_index=True)
        index = {rank: part.tolist() for rank, part in zip(found.tolist(), np.split(places, starts[1:]), strict=False)}
        queue = list(index)
        heapq.heapify(queue)

        token, rank_at, before, after = self.byte_ids[data].tolist(), ranks.tolist(), before.tolist(), after.tolist()
        joined = self.joined.get
        while queue:
            rank = heapq.heappop(queue)
            at = sorted(index.pop(rank))
            for i, p in enumerate(at):
                if rank_at[p] != rank:
                    continue
                gone, least = after[p], NONE
                token[p], token[gone], rank_at[gone] = rank, -1, NONE
                q = after[p] = after[gone]
                if q >= 0:
                    before[q] = p
                    least = rank_at[p] = joined((rank, token[q]), NONE)
                    if least < NONE:
                        if least not in index:
                            index[least] = []
                            heapq.heappush(queue, least)
                        index[least].append(p)
                else:
                    rank_at[p] = NONE
                o = before[p]
                if o >= 0:
                    new = rank_at[o] = joined((token[o], rank), NONE)
                    if new < NONE:
                        if new not in index:
                            index[new] = []
                            heapq.heappush(queue, new)
                        index[new].append(o)
                        least = min(least, new)
                if least < rank and i + 1 < len(at):
                    # A pair of lower rank has come up: it goes before what is left of this one.
                    index[rank] = at[i + 1 :]
                    heapq.heappush(queue, rank)
                    break
        ids = np.array(token, np.int64)
        alive = ids >= 0
        upto = np.concatenate(([0], np.cumsum(alive)))[np.concatenate(([0], ends))].tolist()
        flat = ids[alive].astype("<u4").tobytes()
        return [flat[4 * a : 4 * b] for a, b in zip(upto, upto[1:], strict=False)]


class Pool:
    """Byte strings that are laid out by number, many at a time."""

    def __init__(self, strings: list[bytes]):
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        self.sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def laid_out(self, numbers: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The strings of ``numbers`` one after the other, and where each begins (one more)."""
        sums = np.concatenate(([0], np.cumsum(self.sizes[numbers])))
        return gathered(self.data, self.starts[numbers], self.sizes[numbers], sums).tobytes(), sums


def gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """``data[starts[i] : starts[i] + sizes[i]]`` for each i, one after the other, about LAID at a time."""
    out, begin = np.empty(sums[-1], data.dtype), 0
    while begin < len(starts):
        end = max(begin + 1, int(np.searchsorted(sums, sums[begin] + LAID, "right")) - 1)
        low, high = sums[begin], sums[end]
        shift = starts[begin:end] - (sums[begin:end] - low)
        out[low:high] = data[np.repeat(shift, sizes[begin:end]) + np.arange(high - low)]
        begin = end
    return out


#: White space that starts a stretch, and last bytes of characters that may be white space.
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
MAYBE_BLANK = np.isin(np.arange(256), [*range(9, 14), *range(28, 33), *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF])
#: What stands before such a last byte if the character is white space of more than one byte.
LEADS = np.isin(np.arange(256), [0xC2, 0x80, 0x81, 0x9A])


def stretches(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where stretches begin: texts, and white space right after anything else. A match of the
    pattern that holds something else ends before white space, so none goes across. Doubtful
    characters count as white space, which only makes a stretch longer."""
    if not len(data):
        return np.zeros(0, np.int64)
    blank = MAYBE_BLANK[data]
    blank[1:] &= (data[1:] < 0x80) | LEADS[data[:-1]]
    new = BLANK[data]
    new[1:] &= ~blank[:-1]
    starts = offsets[:-1]
    new[starts[starts < len(data)]] = True
    return np.flatnonzero(new)


@cache
def newer_letters() -> str:
    """Letters and numbers of a later Unicode version than the one that the tiktoken library
    has: `regex` knows them, for the vocabulary's own encoder they are neither."""
    letters = r"[\p{L}\p{N}]"
    found = regex.findall(letters, "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)])))
    late = "".join(c for c in found if unicodedata.category(c) == "Cn")
    library = tiktoken.Encoding("letters", pat_str=letters, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    return "".join(sorted(set(late).difference(library.decode(library.encode_ordinary(late)))))


class Encoder:
    """Encodes texts, stretch by stretch, with a bounded cache."""

    def __init__(self, path: str, pattern: str):
        self.merges, self.pattern = Merges(path), regex.compile(pattern)
        self.newer = frozenset(newer_letters())
        self.as_unassigned = dict.fromkeys(map(ord, self.newer), 0x10FFFF)
        self.recent: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, bounds)``: the ids of all texts of a column, one after the other, and where
        each text's ids begin (one more than texts). Null counts as empty."""
        data, offsets = flat_bytes(texts)
        cuts = stretches(data, offsets)
        places = np.concatenate((cuts, [len(data)])).astype(np.int64)
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(places), pa.py_buffer(data)])
        named = column.dictionary_encode()
        parts = self._ids_of(named.dictionary.to_pylist())
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        pool, at = np.frombuffer(b"".join(parts), "<u4"), named.indices.to_numpy()
        starts = np.cumsum(sizes) - sizes
        sums = np.concatenate(([0], np.cumsum(sizes[at])))
        ids = gathered(pool, starts[at], sizes[at], sums)
        return ids, sums[np.searchsorted(cuts, offsets)]

    def _ids_of(self, units: list[bytes]) -> list[bytes]:
        known, fresh = self.recent, []
        for u in units:
            if u not in known:
                if (ids := self.older.get(u)) is not None:
                    known[u] = ids
                else:
                    fresh.append(u)
        if fresh:
            known.update(zip(fresh, self._fresh(fresh), strict=True))
        out = list(map(known.__getitem__, units))
        for u in fresh:
            if len(u) > CACHED_LENGTH:
                del known[u]
        if len(known) > CACHED:
            self.older, self.recent = known, {}
        return out

    def _matches(self, text: str) -> list[str]:
        if text.isascii() or self.newer.isdisjoint(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.as_unassigned))]

    def _fresh(self, units: list[bytes]) -> list[bytes]:
        """Every match of the pattern in a unit by itself: a token of its own if the vocabulary
        has it whole, else what the replay over all distinct matches makes of it."""
        words = [[m.encode() for m in self._matches(u.decode())] for u in units]
        ranks = self.merges.ranks
        ids: dict[bytes, bytes] = {}
        missing = []
        for w in {w for each in words for w in each}:
            if (rank := ranks.get(w)) is None:
                missing.append(w)
            else:
                ids[w] = rank.to_bytes(4, "little")
        ids.update(zip(missing, self.merges.replay(missing), strict=True))
        return [b"".join(map(ids.__getitem__, each)) for each in words]


@cache
def encoder(path: str, pattern: str) -> Encoder:
    """The worker's encoder for one vocabulary file and pattern."""
    return Encoder(path, pattern)


@cache
def merges(path: str) -> Merges:
    """The worker's merges for one vocabulary file."""
    return Merges(path)


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, pa.Array]]:
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        for a, b in passes(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), SLICE_BYTES):
            yield ids[a:b], texts.slice(a, b - a)


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(doc_id, ids array<int>)``, one row per row of ``docs``.

    A null or empty text has no ids; doc_ids are carried along, null and repeated ones too.
    Special tokens are ordinary text. Other columns are not read, and nothing is shuffled.
    """
    path, pattern = path or default_path(), pattern or default_pattern()

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, texts in _slices(batches):
            ids, bounds = encoder(path, pattern).encode(texts)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), lists], ["doc_id", "ids"])

    return _documents(docs).mapInArrow(each, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, data binary)``: the bytes that the ids of ``(doc_id, ids array<int>)`` stand
    for. A null list counts as empty; an id that the vocabulary lacks raises."""
    path = path or default_path()

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            pool = merges(path).text
            if len(ids) and (ids.min() < 0 or ids.max() >= len(pool.sizes) or not pool.sizes[ids].all()):
                raise ValueError("an id is not in the vocabulary")
            flat, sums = pool.laid_out(ids)
            bounds = sums[np.concatenate(([0], np.cumsum(sizes)))].tolist()
            texts = [flat[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["doc_id", "data"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(each, "doc_id long, data binary")


def document_digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: digests of the ids of every text, as
    decimals joined by commas, and of the bytes that these ids decode to."""
    path, pattern = path or default_path(), pattern or default_pattern()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, texts in _slices(batches):
            coder = encoder(path, pattern)
            ids, bounds = coder.encode(texts)
            columns: list[list] = []
            for pool, tail in ((coder.merges.decimal, 1), (coder.merges.text, 0)):
                flat, sums = pool.laid_out(ids)
                ends = sums[bounds].tolist()
                columns.append([hashlib.sha256(flat[a : max(a, b - tail)]).hexdigest() for a, b in zip(ends, ends[1:], strict=False)])
            arrays = [pa.array(doc_ids, pa.int64()), pa.array(np.diff(bounds)), *map(pa.array, columns)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return _documents(docs).mapInArrow(each, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

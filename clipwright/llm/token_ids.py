"""Token ids of whole texts, word by word, with a bounded cache in each Python worker.

The tokenizer drops white space and never joins what stands on its two sides, so a text's
ids are those of its space-separated units in order. Arrow splits a column of texts and
names its distinct units; units recur, so most are read from the cache, the rest are
encoded together, and numpy lays the ids out for every place a unit stands at.
"""

from __future__ import annotations

import os
import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer
from tokenizers.normalizers import Sequence as Normalizers
from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

# A task has one core; threads of the tokenizer's own would only take it from other tasks.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Units kept in each of the two generations of the cache, and the longest unit kept.
CACHED_UNITS, CACHED_LENGTH = 150_000, 64
#: Words encoded as one text, of which several make a batch; ids laid out at once.
WORDS, BATCH, LAID = 50, 20_000, 1 << 22
WORD = re.compile("([A-Za-zªµºÀ-ÖØ-öø-ÿ]+)([.,]?)").fullmatch


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class UnitEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids, as bytes."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        # For lower-case words of letters, which normalising and the pattern leave as they are.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = Normalizers([])
        self.plain.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        special = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.special and not t.normalized)
        self.separator = special[0] if special else None
        self.separator_id = vocabulary.get(self.separator)
        self.words: dict[str, bytes] = {}
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of every text of a list."""
        ids, ends = self.encode_column(pa.array(texts, pa.large_string()))
        flat, starts = ids.tobytes(), [0, *ends.tolist()]
        return [flat[4 * a : 4 * b] for a, b in zip(starts, starts[1:], strict=False)]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, ends)``: the ids of all texts, one after the other, and where each text's
        ids end. A null text counts as empty."""
        spaced = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
        split = pc.split_pattern(spaced, " ")
        named = split.flatten().dictionary_encode()
        units, places = named.dictionary.to_numpy(zero_copy_only=False).tolist(), named.indices.to_numpy()
        known = self.recent
        fresh = []
        for u in units:
            if u not in known:
                if (ids := self.older.get(u)) is not None:
                    known[u] = ids
                else:
                    fresh.append(u)
        self._learn(fresh, known)
        parts = list(map(known.__getitem__, units))
        for u in fresh:
            if len(u) > CACHED_LENGTH:
                del known[u]
        if len(known) > CACHED_UNITS:
            self.older, self.recent = known, {}
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        pool = np.frombuffer(b"".join(parts), "<u4")
        sums = np.concatenate(([0], np.cumsum(sizes[places])))
        bounds = pc.list_value_length(split).to_numpy().astype(np.int64).cumsum()
        return _laid_out(pool, np.cumsum(sizes) - sizes, sizes, places, sums), sums[bounds]

    def _learn(self, fresh: list[str], into: dict[str, bytes]) -> None:
        """Units of Latin-1 letters, with one point or comma at most, are one word and a mark:
        they share the lower-case word's ids. All others are encoded as they stand."""
        simple: dict[str, str] = {}
        marked: dict[str, list[str]] = {".": [], ",": []}
        odd: list[str] = []
        for u in fresh:
            if u.isalpha() and u.isascii():
                simple[u] = u.lower()
            elif m := WORD(u):
                simple[u] = m[1].lower()
                if m[2]:
                    marked[m[2]].append(u)
            else:
                odd.append(u)
        words = self.words
        missing = list(set(simple.values()).difference(words))
        for i in range(0, len(missing), BATCH):
            block = missing[i : i + BATCH]
            texts = [" ".join(block[j : j + WORDS]) for j in range(0, len(block), WORDS)]
            found = self.plain.encode_batch_fast(texts, add_special_tokens=False)
            ids = np.array([x for each in found for x in each.ids], "<u4")
            stops = np.flatnonzero(self.ends_word[ids]) + 1
            if len(stops) != len(block):
                raise ValueError("the vocabulary does not end every word")
            flat, begin = ids.tobytes(), 0
            for low, stop in zip(block, (4 * stops).tolist(), strict=True):
                words[low] = flat[begin:stop]
                begin = stop
        into.update(zip(simple, map(words.__getitem__, simple.values()), strict=True))
        for mark, units in marked.items():
            ids = self._whole(mark)
            for u in units:
                into[u] += ids
        if len(words) > CACHED_UNITS:
            words.clear()
        self._learn_odd(odd, into)

    def _learn_odd(self, odd: list[str], into: dict[str, bytes]) -> None:
        """Units of any kind, encoded together with a special token between them: it is cut
        out before anything else is done, so its neighbours do not see each other."""
        apart = [u for u in odd if self.separator is None or self.separator in u or not u]
        for u in apart:
            into[u] = self._whole(u)
        together = list(set(odd).difference(apart))
        for i in range(0, len(together), BATCH):
            block = together[i : i + BATCH]
            ids = np.array(self._ids(self.separator.join(block)), "<u4")
            cuts = [-1, *np.flatnonzero(ids == self.separator_id).tolist(), len(ids)]
            if len(cuts) != len(block) + 1:
                raise ValueError("the separator is not kept apart")
            flat = ids.tobytes()
            for u, a, b in zip(block, cuts[:-1], cuts[1:], strict=True):
                into[u] = flat[4 * (a + 1) : 4 * b]

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _whole(self, unit: str) -> bytes:
        if not unit:
            return b""
        return np.array(self._ids(unit), "<u4").tobytes()


def _laid_out(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray, places: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """``pool[starts[p] : starts[p] + sizes[p]]`` for each p of ``places``, one after the other;
    ``sums`` are the running numbers of ids. LAID ids or so are laid out at a time."""
    out = np.empty(sums[-1], "<u4")
    begin = 0
    while begin < len(places):
        end = max(begin + 1, int(np.searchsorted(sums, sums[begin] + LAID, "right")) - 1)
        at, low, high = places[begin:end], sums[begin], sums[end]
        shift = starts[at] - (sums[begin:end] - low)
        out[low:high] = pool[np.repeat(shift, sizes[at]) + np.arange(high - low)]
        begin = end
    return out


@cache
def encoder(path: str) -> UnitEncoder:
    """The worker's encoder for one vocabulary file."""
    return UnitEncoder(path)

"""SentencePiece segmentation as a max-plus parallel scan, and decoding.

A segmentation is a path of pieces; the best one maximises the sum of their scores. Cut a
document anywhere: a piece that crosses the cut reaches 0..longest-1 characters into the
next chunk, and that overhang is all that the next chunk needs to know. So a chunk is a
matrix of best scores from the overhang it is entered with to the one it leaves, chunks
combine by the (associative) max-plus product, and once the overhangs at all cuts are known
every chunk finds its own pieces. Products are taken in two levels, of GROUP chunks and of
groups, so no task holds more of a giant document than that.

Scores are whole numbers, so products are exact in any order. Of equally good paths the one
whose last piece starts first is taken, then the one whose piece before that does, and so
on. A matrix carries a second term for this: for each exit, the order in which entries are
preferred. A later chunk's choice goes before an earlier one's, so orders combine as well,
and no result depends on where a document is cut.

No piece of the vocabulary
has the space mark behind another character; between a character and a space mark every
path has a boundary. A chunk with such a sure boundary has a matrix of rank one, kept as
the two vectors it is the sum of; what all its paths share between its first and its last
sure boundary is left out, as it moves no choice. Stretches between sure boundaries recur:
the distinct ones of a batch are segmented together, those of one length in one numpy
lattice, and their ids are gathered for all documents of the batch at once.

The vocabulary's scores are read as a unigram model's: the result is the best-scoring
segmentation, not the order of merges that a BPE trainer's own encoder follows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipwright.llm.common import passes, stored

SPACE = "▁"
CHUNK, GROUP = 16_384, 128
#: Stretches kept in a worker, and the longest that are segmented in a lattice of many.
CACHED, ALIKE = 300_000, 64
#: Cells (texts x positions) of one lattice, and characters of one pass.
CELLS, PASS = 1 << 17, 2 << 20
NEVER = -(1 << 60)
_STRETCH = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_SURE = re.compile(f"(?<=[^{SPACE}]){SPACE}")
_C1, _C2, _C3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))
_SLOTS = 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _codes(texts: list[str]) -> np.ndarray:
    """Code points of texts of one length, a row each."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(texts), -1)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    both = []
    for base in (int(_C3), pow(int(_C3), -1, 1 << 64)):
        out = np.full(n, base, np.uint64)
        out[0] = 1
        both.append(np.cumprod(out, dtype=np.uint64))
    return both[0], both[1]


class _Sums:
    """Prefix sums of rows of code points, from which any substring's 64-bit key follows."""

    def __init__(self, codes: np.ndarray):
        m, length = codes.shape
        power, self.inverse = _powers(1 << max(6, length.bit_length()))
        mixed = (codes.astype(np.uint64) + np.uint64(1)) * _C1
        mixed ^= mixed >> np.uint64(29)
        self.sums = np.zeros((m, length + 1), np.uint64)
        np.cumsum(mixed * power[:length], axis=1, out=self.sums[:, 1:])

    def of_length(self, n: int, starts: int) -> np.ndarray:
        """Keys of the n characters from each of the first ``starts`` positions on."""
        return self._key(self.sums[:, n : n + starts] - self.sums[:, :starts], self.inverse[:starts])

    def between(self, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._key(self.sums[row, end] - self.sums[row, start], self.inverse[start])

    @staticmethod
    def _key(difference: np.ndarray, inverse: np.ndarray) -> np.ndarray:
        key = difference * inverse
        key ^= key >> np.uint64(32)
        return key * _C2


class Pieces:
    """The vocabulary with whole scores, best segmentations and their texts."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.texts = [model.id_to_piece(i) for i in range(size)]
        scores = {i: model.get_score(i) for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
        self.scores = {self.texts[i]: (round(s), i) for i, s in scores.items()}
        self.unknown_score = round(min(scores.values())) - 10
        self.bytes = {int(self.texts[i][1:-1], 16): i for i in range(size) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        #: What each id says on its own; ids of bytes from 128 on do not.
        self.says = [chr(b) if (b := self.byte_of.get(i)) is not None else t for i, t in enumerate(self.texts)]
        self.joint = np.zeros(size, bool)
        self.joint[[i for i, b in self.byte_of.items() if b >= 128]] = True
        self.unknown = model.unk_id()
        self.longest = max(map(len, self.scores))
        if any(SPACE in t.lstrip(SPACE) for t in self.scores):
            raise ValueError("a piece holds a space mark behind another character")
        self._index()

    def _index(self) -> None:
        """Pieces by key, in two tables of slots: the second takes what the first has no room for."""
        by_length: dict[int, list[str]] = {}
        for t in self.scores:
            by_length.setdefault(len(t), []).append(t)
        listed = [t for texts in by_length.values() for t in texts]
        self.keys = np.concatenate([_Sums(_codes(texts)).of_length(n, 1)[:, 0] for n, texts in by_length.items()] + [np.zeros(1, np.uint64)])
        self.key_scores = np.array([self.scores[t][0] for t in listed] + [NEVER], np.int64)
        self.key_ids = np.array([self.scores[t][1] for t in listed] + [-1], np.int64)
        own = np.arange(len(listed), dtype=np.int32)
        self.first, self.second = np.full((2, 1 << _SLOTS), -1, np.int32)
        self.first[self._slot(self.keys[:-1], 64 - _SLOTS)] = own
        rest = own[self.first[self._slot(self.keys[:-1], 64 - _SLOTS)] != own]
        slot = self._slot(self.keys[rest], 64 - 2 * _SLOTS)
        if len(np.unique(slot)) < len(rest) or len(np.unique(self.keys)) <= len(listed):
            raise ValueError("the vocabulary's keys collide")
        self.second[slot] = rest

    @staticmethod
    def _slot(keys: np.ndarray, shift: int) -> np.ndarray:
        return ((keys >> np.uint64(shift)) & np.uint64((1 << _SLOTS) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of the pieces with these keys, or -1."""
        at = self.first[self._slot(keys, 64 - _SLOTS)]
        wrong = np.flatnonzero((self.keys[at] != keys) & (at >= 0))
        other = self.second[self._slot(keys.ravel()[wrong], 64 - 2 * _SLOTS)]
        at.ravel()[wrong] = np.where(self.keys[other] == keys.ravel()[wrong], other, -1)
        return at

    def lattice(self, sums: _Sums, stop: int) -> np.ndarray:
        """[text, end - 1, longest - length]: scores of the pieces that start before ``stop``."""
        m, length = sums.sums.shape[0], sums.sums.shape[1] - 1
        out = np.full((m, length, self.longest), NEVER, np.int64)
        for n in range(1, min(self.longest, length) + 1):
            starts = min(length - n + 1, stop)
            found = self.key_scores[self.find(sums.of_length(n, starts))]
            if n == 1:
                found[found == NEVER] = self.unknown_score
            out[:, n - 1 : n - 1 + starts, self.longest - n] = found
        return out

    def sweep(self, lattice: np.ndarray, entries: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """([text, entry, position], same): best scores of reaching each position, and by
        which column of the lattice; of equal ones by the longest piece."""
        (m, length, longest), count = lattice.shape, len(entries)
        best = np.full((length + 1 + longest, m, count), NEVER, np.int64)
        back = np.zeros((length + 1, m, count), np.int8)
        for e, entry in enumerate(entries):
            if entry <= length:
                best[longest + entry, :, e] = 0
        columns = np.ascontiguousarray(lattice.transpose(1, 2, 0))[:, :, :, None]
        for j in range(1, length + 1):
            reached = best[j : j + longest] + columns[j - 1]
            by = reached.argmax(axis=0)
            top = np.take_along_axis(reached, by[None], 0)[0]
            here = best[longest + j]
            back[j] = np.where(top > here, by, back[j])
            np.maximum(here, top, out=here)
        best[best < NEVER // 2] = NEVER
        return best[longest:].transpose(1, 2, 0), back.transpose(1, 2, 0)

    def forward(self, text: str, entry: int, stop: int) -> tuple[np.ndarray, list[int]]:
        """Best scores of reaching each position from ``entry`` by pieces that start before
        ``stop``, and where the last piece starts: for a text on its own."""
        size = min(len(text), stop + self.longest - 1) + 1
        best, back = [NEVER] * size, [-1] * size
        best[entry] = 0
        scores, longest, unknown = self.scores, self.longest, self.unknown_score
        for i in range(entry, min(stop, len(text))):
            here = best[i]
            if here == NEVER:
                continue
            single = False
            for j in range(i + 1, min(i + longest, len(text)) + 1):
                if (found := scores.get(text[i:j])) is not None:
                    single = single or j == i + 1
                    if here + found[0] > best[j]:
                        best[j], back[j] = here + found[0], i
            if not single and here + unknown > best[i + 1]:
                best[i + 1], back[i + 1] = here + unknown, i
        return np.array(best, np.int64), back

    def ids(self, piece: str) -> tuple[int, ...]:
        if (found := self.scores.get(piece)) is not None:
            return (found[1],)
        return tuple(self.bytes.get(b, self.unknown) for b in piece.encode("utf-8", "surrogatepass"))

    def path(self, text: str, entry: int, stop: int, leave: int) -> tuple[int, list[int], list[int]]:
        """(score, ids, their places) of the best path from ``entry`` to ``leave`` behind
        ``stop``. A place is four times the character's, plus the number of the byte in it."""
        best, back = self.forward(text, entry, stop)
        end, cuts = stop + leave, []
        while end > entry:
            cuts.append((back[end], end))
            end = back[end]
        made = [(i, 4 * a + k) for a, b in cuts[::-1] for k, i in enumerate(self.ids(text[a:b]))]
        return int(best[stop + leave]), [i for i, _ in made], [p for _, p in made]

    def paths(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(scores, numbers of ids, all ids, their places) of texts of one length."""
        length = len(texts[0])
        sums = _Sums(_codes(texts))
        best, back = self.sweep(self.lattice(sums, length), [0])
        back = back[:, 0].astype(np.int64)
        rows, end, steps = np.arange(len(texts)), np.full(len(texts), length), []
        while len(rows):
            start = end - self.longest + back[rows, end]
            steps.append((rows, start, end))
            more = start > 0
            rows, end = rows[more], start[more]
        row, start, end = (np.concatenate(x) for x in zip(*steps, strict=True))
        order = np.lexsort((start, row))
        row, start, end = row[order], start[order], end[order]
        ids = self.key_ids[self.find(sums.between(row, start, end))]
        place = 4 * start
        missing = np.flatnonzero(ids < 0)
        if len(missing):
            spelt = [self.ids(texts[r][a]) for r, a in zip(row[missing].tolist(), start[missing].tolist(), strict=True)]
            count = np.ones(len(ids), np.int64)
            count[missing] = [len(x) for x in spelt]
            begins = np.cumsum(count) - count
            row, ids, place = (np.repeat(x, count) for x in (row, ids, place))
            place += np.arange(len(row)) - np.repeat(begins, count)
            ids[ids < 0] = list(chain.from_iterable(spelt))
        return best[:, 0, -1], np.bincount(row, minlength=len(texts)), ids, place

    def text_of(self, ids: Iterable[int]) -> str:
        """The text of a run of ids, with space marks."""
        parts, held = [], bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                held.append(b)
                continue
            if held:
                parts.append(held.decode("utf-8", "surrogatepass"))
                held.clear()
            parts.append(self.texts[i])
        if held:
            parts.append(held.decode("utf-8", "surrogatepass"))
        return "".join(parts)

    def sure(self, text: str, stop: int) -> tuple[int, int]:
        """First and last sure boundary within (0, stop), or (0, 0)."""
        first = _SURE.search(text, 0, stop)
        if not first:
            return 0, 0
        last = text.rfind(SPACE, 0, stop)
        while text[last - 1] == SPACE:
            last -= 1
        return first.start(), last

    def transfers(self, texts: list[str], stops: list[int]) -> list[bytes]:
        """The chunks' matrices: [overhang at entry, overhang at exit] -> best score, up to
        what all paths share, and the order of entries for each exit. ``texts`` read
        ``longest - 1`` characters past the chunks' ends ``stops``. A matrix of rank one is its
        two vectors, of entry and of exit, and one order of entries."""
        n, out, whole = self.longest, [b""] * len(texts), {}
        for k, (text, stop) in enumerate(zip(texts, stops, strict=True)):
            a, b = self.sure(text, stop)
            if a:
                vectors = np.full((3, n), NEVER, np.int64)
                heads = [self.forward(text[:a], i, a) for i in range(min(n, a + 1))]
                vectors[0, : a + 1] = [int(best[a]) for best, _ in heads]
                vectors[2] = preferred(vectors[0], [self.starts(back, i, a) if best[a] > NEVER else [] for i, (best, back) in enumerate(heads)])
                tail = self.forward(text[b:], 0, stop - b)[0][stop - b :][:n]
                vectors[1, : len(tail)] = tail
                out[k] = vectors.tobytes()
            else:
                whole.setdefault((len(text), stop), []).append(k)
        for (length, stop), alike in whole.items():
            step = max(1, CELLS // length)
            for i in range(0, len(alike), step):
                part = alike[i : i + step]
                best, back = self.sweep(self.lattice(_Sums(_codes([texts[k] for k in part])), stop), list(range(n)))
                for k, scores, order in zip(part, best, self.orders(best, back), strict=True):
                    matrix = np.full((2 * n, n), NEVER, np.int64)
                    reached = scores[:, stop : stop + n]
                    matrix[:n, : reached.shape[1]] = reached
                    matrix[n:] = 0
                    matrix[n:, : reached.shape[1]] = order[:, stop : stop + n]
                    out[k] = matrix.tobytes()
        return out

    @staticmethod
    def starts(back: list[int], entry: int, end: int) -> list[int]:
        """Where the pieces of a path from ``entry`` start, from ``end`` backwards."""
        out = []
        while end > entry:
            end = back[end]
            out.append(end)
        return out

    def orders(self, best: np.ndarray, back: np.ndarray) -> np.ndarray:
        """[text, entry, position]: the place of each entry among those that reach a position, by
        the starts of their paths' pieces. The piece that ends at an entry starts before all."""
        m, count, size = best.shape
        order = np.zeros((size, m, count), np.int16)
        text, entry = np.arange(m)[:, None], np.arange(count)[None, :]
        for j in range(size):
            start = j - self.longest + back[:, :, j].astype(np.int64)
            key = start * count + order[np.maximum(start, 0), text, entry]
            if j < count:
                key[:, j] = -1
            key[best[:, :, j] == NEVER] = 1 << 60
            order[j] = _ranks(key, 1)
        return order.transpose(1, 2, 0)


class Segments:
    """The segmentations that a worker has met: for each its score, length, ids and places."""

    def __init__(self, coder: Pieces):
        self.coder = coder
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self.score, self.chars, self.count, self.begin = (np.zeros(1 << 12, np.int64) for _ in range(4))
        self.ids, self.place = (np.zeros(1 << 14, np.int64) for _ in range(2))
        self.used = 0

    def _add(self, score: np.ndarray, chars: np.ndarray, count: np.ndarray, ids: np.ndarray, place: np.ndarray) -> int:
        """Appends segmentations; returns the number of the first."""
        first, n = self.held, len(score)
        for name, size in (("score", first + n), ("chars", first + n), ("count", first + n), ("begin", first + n), ("ids", self.used + len(ids)), ("place", self.used + len(ids))):
            if size > len(getattr(self, name)):
                setattr(self, name, np.concatenate([getattr(self, name), np.zeros(size, np.int64)]))
        self.score[first : first + n], self.chars[first : first + n], self.count[first : first + n] = score, chars, count
        self.begin[first : first + n] = self.used + np.cumsum(count) - count
        self.ids[self.used : self.used + len(ids)], self.place[self.used : self.used + len(ids)] = ids, place
        self.held, self.used = first + n, self.used + len(ids)
        return first

    def part(self, text: str, entry: int, stop: int, leave: int) -> int:
        """A path between given overhangs, as a segmentation of ``stop`` characters."""
        score, ids, place = self.coder.path(text, entry, stop, leave)
        return self._add(np.array([score]), np.array([stop]), np.array([len(ids)]), np.array(ids, np.int64), np.array(place, np.int64))

    def learn(self, stretches: Iterable[str]) -> None:
        """Segments what is not known yet, stretches of one length together."""
        by_length: dict[int, list[str]] = {}
        for s in stretches:
            if len(s) <= ALIKE:
                by_length.setdefault(len(s), []).append(s)
            else:
                self.known[s] = self.part(s, 0, len(s), 0)
        for length, alike in by_length.items():
            step = max(1, CELLS // length)
            for i in range(0, len(alike), step):
                texts = alike[i : i + step]
                score, count, ids, place = self.coder.paths(texts)
                first = self._add(score, np.full(len(texts), length), count, ids, place)
                self.known.update(zip(texts, range(first, first + len(texts)), strict=True))

    def numbers(self, chunks: list[tuple[str, int, int, int]]) -> list[np.ndarray]:
        """The segmentations that chunks (text, stop, entry, leave) consist of, in order."""
        if self.held > CACHED:
            self.clear()
        ends, middles = [], []
        for text, stop, entry, leave in chunks:
            if entry == leave == 0 and stop == len(text):
                ends.append(((), ()))
                middles.append(_STRETCH.findall(text))
                continue
            a, b = self.coder.sure(text, stop)
            if a and entry <= a:
                ends.append(((self.part(text[:a], entry, a, 0),), (self.part(text[b:], 0, stop - b, leave),)))
                middles.append(_STRETCH.findall(text, a, b))
            else:
                ends.append(((self.part(text, entry, stop, leave),) if entry < stop + leave else (), ()))
                middles.append([])
        self.learn(set().union(*middles).difference(self.known))
        number = self.known.__getitem__
        return [np.array([*head, *map(number, middle), *tail], np.int64) for (head, tail), middle in zip(ends, middles, strict=True)]

    def results(self, chunks: list[tuple[str, int, int, int]], starts: list[int]) -> Iterator[tuple[int, np.ndarray, int, bool]]:
        """(score, ids, digest of ids and places, whether they decode to the text) of chunks."""
        numbers = self.numbers(chunks)
        each = np.array([len(x) for x in numbers], np.int64)
        flat = np.concatenate([*numbers, np.empty(0, np.int64)])
        chars, count = self.chars[flat], self.count[flat]
        upto = np.concatenate(([0], np.cumsum(chars)))
        last = np.cumsum(each)
        first = last - each
        place = np.repeat(upto[:-1] - np.repeat(upto[first] - np.array(starts, np.int64), each), count) * 4
        source = np.repeat(self.begin[flat] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        ids, place = self.ids[source], place + self.place[source]
        mixed = (place.astype(np.uint64) + np.uint64(1)) * _C1 ^ (ids.astype(np.uint64) + np.uint64(1)) * _C2
        mixed = ((mixed ^ (mixed >> np.uint64(31))) * _C3 >> np.uint64(33)).astype(np.int64)
        mixed, score, total = (np.concatenate(([0], np.cumsum(x))) for x in (mixed, self.score[flat], count))
        joint = np.concatenate(([0], np.cumsum(self.coder.joint[ids])))
        says = self.coder.says
        for (text, stop, entry, leave), i, j in zip(chunks, first.tolist(), last.tolist(), strict=True):
            a, b = int(total[i]), int(total[j])
            own = ids[a:b]
            said = self.coder.text_of(own.tolist()) if joint[b] > joint[a] else "".join(map(says.__getitem__, own.tolist()))
            yield int(score[j] - score[i]), own, int(mixed[b] - mixed[a]), said == text[entry : stop + leave]


@cache
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


@cache
def segments_of(path: str) -> Segments:
    """The worker's segmentations for one vocabulary file."""
    return Segments(pieces_of(path))


def marked(text: str | None) -> str:
    """The text with space marks, and one in front unless it is empty."""
    return (SPACE + text).replace(" ", SPACE) if text else ""


def _ranks(keys: np.ndarray, axis: int) -> np.ndarray:
    return keys.argsort(axis=axis, kind="stable").argsort(axis=axis, kind="stable")


def preferred(scores: np.ndarray, starts: list[list[int]]) -> np.ndarray:
    """The place of each entry by the starts of its path's pieces; those without a path come last."""
    listed = sorted(range(len(scores)), key=lambda i: (0, [*starts[i], -1]) if i < len(starts) and scores[i] > NEVER else (1, [i]))
    order = np.empty(len(scores), np.int64)
    order[listed] = np.arange(len(scores))
    return order


class Transfer:
    """A max-plus matrix: a full one, or the two vectors of one of rank one. ``order`` tells, for
    each exit or for all, which entries are preferred among equally good ones."""

    def __init__(self, values: np.ndarray, order: np.ndarray):
        self.values, self.order, self.single = values, order, order.ndim == 1

    @classmethod
    def of(cls, data: bytes, n: int) -> Transfer:
        rows = np.frombuffer(data, np.int64).reshape(-1, n)
        return cls(rows[:2], rows[2]) if len(rows) == 3 else cls(rows[:n], rows[n:])

    def tobytes(self) -> bytes:
        return self.values.tobytes() + self.order.astype(np.int64).tobytes()

    def leave(self, reached: np.ndarray) -> np.ndarray:
        """Best scores behind the matrix, from those before it."""
        if self.single:
            return np.maximum((reached + self.values[0]).max() + self.values[1], NEVER)
        return np.maximum((reached[:, None] + self.values).max(axis=0), NEVER)

    def enter(self, reached: np.ndarray, leave: int) -> int:
        """The overhang before the matrix, on the path that is taken to ``leave`` behind it."""
        total = reached + (self.values[0] if self.single else self.values[:, leave])
        order = self.order if self.single else self.order[:, leave]
        return int(np.where(total == total.max(), order, len(order)).argmin())

    def __matmul__(self, other: Transfer) -> Transfer:
        if self.single:
            # All entries go on alike behind the sure boundary.
            return Transfer(np.stack([self.values[0], other.leave(self.values[1])]), self.order)
        n = len(self.values)
        then, later = (other.values[:1].T, other.order[:, None]) if other.single else (other.values, other.order)
        total = self.values[:, :, None] + then[None, :, :]
        best = total.max(axis=1)
        # Of equally good overhangs between the two the one that the later matrix prefers.
        between = np.where(total == best[:, None, :], later[None, :, :], n).argmin(axis=1)
        key = later[between, np.arange(later.shape[1])] * n + self.order[np.arange(n)[:, None], between]
        order, best = _ranks(key, 0), np.maximum(best, NEVER)
        return Transfer(np.stack([best[:, 0], other.values[1]]), order[:, 0]) if other.single else Transfer(best, order)


def _entries(matrices: list[Transfer], n: int, entry: int, leave: int) -> list[int]:
    """Overhangs before each matrix and after the last, on a best path from entry to leave."""
    forward = [np.full(n, NEVER, np.int64)]
    forward[0][entry] = 0
    for m in matrices:
        forward.append(m.leave(forward[-1]))
    out = [leave]
    for f, m in zip(forward[-2::-1], matrices[::-1], strict=True):
        out.append(m.enter(f, out[-1]))
    return out[::-1]


def _chunks(docs: DataFrame, path: str, chunk: int) -> DataFrame:
    """``(doc_id, row, seq, last, start, stop, text, plain)``: every chunk with what it reads
    ahead; ``plain`` tells that it has no space mark of its own."""
    names = ["doc_id", "row", "seq", "last", "start", "stop", "text", "plain"]

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead = pieces_of(path).longest - 1
        for batch in batches:
            for doc_id, row, said in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text, plain = marked(said), SPACE not in (said or "")
                count = max(1, -(-len(text) // chunk))
                for a in range(0, count, 64):
                    part = [(doc_id, row, k, count - 1, k * chunk, min(chunk, len(text) - k * chunk), text[k * chunk : (k + 1) * chunk + ahead], plain) for k in range(a, min(count, a + 64))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part, strict=True)], names)

    schema = "doc_id long, row long, seq long, last long, start long, stop long, text string, plain boolean"
    return docs.select("doc_id", "row", "text").mapInArrow(each, schema)


def _blocks(columns: Iterable[list], size: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of sorted batches (as lists of columns) by their first ``size`` values."""
    key, held = None, []
    for batch in columns:
        for row in zip(*batch, strict=True):
            if row[:size] != key:
                if held:
                    yield key, held
                key, held = row[:size], []
            held.append(row[size:])
    if held:
        yield key, held


def _by_blocks(df: DataFrame, keys: list[str], order: str, make, schema: str) -> DataFrame:
    """``make(key, rows)`` of the rows of equal keys in order, all tasks alike: partitions of
    a stated number are not drawn together, however small the matrices in them."""
    names = [f.split()[0] for f in schema.split(", ")]
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for key, rows in _blocks(([c.to_pylist() for c in b.columns] for b in batches), len(keys)):
            out += make(key, rows)
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)

    return df.repartition(tasks, *keys).sortWithinPartitions(*keys, order).mapInArrow(each, schema)


def _with_overhangs(parts: DataFrame, path: str) -> DataFrame:
    """``(row, seq, entry, leave)`` of every chunk of the giant documents."""
    n = pieces_of(path).longest

    def transfers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pieces_of(path)
        for batch in batches:
            for i in range(0, len(batch), 64):
                part = batch.slice(i, 64)
                made = coder.transfers(part.column(3).to_pylist(), part.column(4).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(made, pa.binary())], ["row", "seq", "last", "matrix"])

    def block_product(key: tuple, rows: list[tuple]) -> list[tuple]:
        total = Transfer.of(rows[0][1], n)
        for _, m in rows[1:]:
            total = total @ Transfer.of(m, n)
        return [(*key, total.tobytes())]

    def top_scan(key: tuple, rows: list[tuple]) -> list[tuple]:
        at = _entries([Transfer.of(m, n) for _, m in rows], n, 0, 0)
        return [(*key, block, a, b) for (block, _), a, b in zip(rows, at[:-1], at[1:], strict=True)]

    def block_scan(key: tuple, rows: list[tuple]) -> list[tuple]:
        at = _entries([Transfer.of(m, n) for _, m, _, _ in rows], n, rows[0][2], rows[0][3])
        return [(key[0], row[0], a, b) for row, a, b in zip(rows, at[:-1], at[1:], strict=True)]

    made = parts.select("row", "seq", "last", "text", "stop").mapInArrow(transfers, "row long, seq long, last long, matrix binary")
    matrices = stored(made.withColumn("block", F.floor(F.col("seq") / GROUP)), "pieces-transfers")
    # A document of one block is entered and left without an overhang.
    large = matrices.filter(F.col("last") >= GROUP)
    tops = _by_blocks(large.select("row", "block", "seq", "matrix"), ["row", "block"], "seq", block_product, "row long, block long, matrix binary")
    ends = stored(_by_blocks(tops, ["row"], "block", top_scan, "row long, block long, entry long, leave long"), "pieces-blocks")
    known = matrices.join(ends, ["row", "block"], "left")
    known = known.select("row", "block", "seq", "matrix", F.coalesce("entry", F.lit(0)).alias("entry"), F.coalesce("leave", F.lit(0)).alias("leave"))
    return _by_blocks(known, ["row", "block"], "seq", block_scan, "row long, seq long, entry long, leave long")


_ENCODED = "doc_id long, row long, seq long, start long, score long, n_ids long, ids_hash long, decoded boolean"


def encode(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, with_ids: bool = False) -> DataFrame:
    """Rows of chunks: ``(doc_id, row, seq, start, score, n_ids, ids_hash, decoded)`` and, on
    demand, ``ids array<int>``; a document's ids are those of its chunks in order of seq.

    ``ids_hash`` adds up 31 bits mixed of each id and the place of its character. Of equally
    good paths the one with the longest last pieces is taken, whatever ``chunk`` is.
    ``decoded`` tells that decoding the ids gives back the text (it does not where a text
    holds the space mark itself, which decodes to a space). Null and empty texts have one
    chunk without ids. ``row`` numbers input rows, so repeated doc_ids stay apart. Other
    columns are ignored.
    """
    path = path or default_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.monotonically_increasing_id())
    names = ["doc_id", "row", "seq", "start", "score", "n_ids", "ids_hash", "decoded"] + ["ids"] * with_ids
    schema = _ENCODED + ", ids array<int>" * with_ids

    def pack(keys: list[tuple], chunks: list[tuple[str, int, int, int]], plain: list[bool]) -> pa.RecordBatch:
        found = segments_of(path).results(chunks, [k[3] for k in keys])
        out = [(*key, score, len(ids), mixed, same and own, ids)[: len(names)] for key, own, (score, ids, mixed, same) in zip(keys, plain, found, strict=True)]
        kinds = [pa.int64()] * 7 + [pa.bool_()] + [pa.list_(pa.int32())] * with_ids
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def short(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, numbers, said = (c.to_pylist() for c in batch.columns)
            texts = [marked(t) for t in said]
            for i, j in passes([len(t) for t in texts], PASS):
                keys = [(d, r, 0, 0) for d, r in zip(doc_ids[i:j], numbers[i:j], strict=True)]
                yield pack(keys, [(t, len(t), 0, 0) for t in texts[i:j]], [SPACE not in (t or "") for t in said[i:j]])

    def giant(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, numbers, seqs, starts, stops, texts, plain, entries, leaves = (c.to_pylist() for c in batch.columns)
            for i, j in passes([len(t) for t in texts], PASS):
                keys = list(zip(doc_ids[i:j], numbers[i:j], seqs[i:j], starts[i:j], strict=True))
                yield pack(keys, list(zip(texts[i:j], stops[i:j], entries[i:j], leaves[i:j], strict=True)), plain[i:j])

    whole = F.coalesce(F.length("text") < chunk, F.lit(True))
    # Chunks of one document are dealt to all tasks, in a stated number of partitions.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = stored(_chunks(rows.filter(~whole), path, chunk).repartition(tasks, "row", "seq"), "pieces-chunks")
    ends = _with_overhangs(parts, path).repartition(tasks, "row", "seq")
    placed = parts.repartition(tasks, "row", "seq").join(ends, ["row", "seq"])
    placed = placed.select("doc_id", "row", "seq", "start", "stop", "text", "plain", "entry", "leave")
    return rows.filter(whole).select("doc_id", "row", "text").mapInArrow(short, schema).unionByName(placed.mapInArrow(giant, schema))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, row, seq, text)``: the text of every chunk of ``encode(..., with_ids=True)``,
    with the mark in front of a document taken off. Chunks join in order of seq."""
    path = path or default_path()

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pieces_of(path)
        for batch in batches:
            texts = [coder.text_of(ids).replace(SPACE, " ") for ids in batch.column(3).to_pylist()]
            texts = [t[1:] if seq == 0 and t else t for t, seq in zip(texts, batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts)], ["doc_id", "row", "seq", "text"])

    return encoded.select("doc_id", "row", "seq", "ids").mapInArrow(each, "doc_id long, row long, seq long, text string")


def document_digests(docs: DataFrame, path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """``(doc_id, n_ids, score, ids_hash, n_chunks, decoded)``, one row per input row."""
    parts = encode(docs, path, chunk).groupBy("doc_id", "row")
    made = parts.agg(F.sum("n_ids").alias("n_ids"), F.sum("score").alias("score"), F.sum("ids_hash").alias("ids_hash"), F.count("*").alias("n_chunks"), F.bool_and("decoded").alias("decoded"))
    return made.drop("row")

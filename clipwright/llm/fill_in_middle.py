"""Fill-in-middle: documents reordered so that a model learns to fill a gap.

A text is cut twice, at boundaries of units, and written as prefix, suffix and middle with
a marker before each. Units are counted by rank queries on a wavelet matrix: every byte is
one of eight classes, the ranks of the classes that begin a unit add up to the number of
units begun before any place, and bisection on those ranks finds the place of a cut. One
matrix serves all texts of a pass, and all their queries go through it together.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipwright.llm.common import flat_bytes, passes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents, so many are cut, and of a hundred cut ones so many have the suffix first.
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 90, 20

#: Classes of bytes. A continuation byte begins nothing, nor does a letter A-Z, a-z after another.
WITHIN, NEWLINE, SPACE, DIGIT, LETTER, LETTER_ON, MARK, LEAD = range(8)
BITS = 3
#: The classes that begin a unit.
UNITS = {
    "token": (NEWLINE, SPACE, DIGIT, LETTER, MARK, LEAD),
    "character": (NEWLINE, SPACE, DIGIT, LETTER, LETTER_ON, MARK, LEAD),
}


def _class_table() -> np.ndarray:
    table = np.full(256, MARK, np.uint8)
    for kind, characters in [(NEWLINE, b"\n"), (SPACE, b" \t\r\v\f"), (DIGIT, b"0123456789"), (LETTER, bytes([*range(65, 91), *range(97, 123)]))]:
        table[list(characters)] = kind
    table[0x80:0xC0], table[0xC0:] = WITHIN, LEAD
    return table


CLASS_OF = _class_table()


def byte_classes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The class of every byte of texts that stand one after the other."""
    kinds = CLASS_OF[data]
    letter = kinds == LETTER
    goes_on = letter[1:] & letter[:-1]
    starts = offsets[1:-1]
    goes_on[starts[(starts > 0) & (starts < len(data))] - 1] = False
    kinds[1:][goes_on] = LETTER_ON
    return kinds


class WaveletMatrix:
    """Symbols of ``bits`` bits, level by level from the highest: each level holds one bit of
    every symbol, with counts of ones up to each word of 64, and sorts zeros before ones."""

    def __init__(self, symbols: np.ndarray, bits: int = BITS):
        self.n, self.levels = len(symbols), []
        for shift in reversed(range(bits)):
            one = (symbols >> shift & 1).astype(bool)
            words = np.zeros(self.n // 64 + 1, np.uint64)
            packed = np.packbits(one, bitorder="little")
            words.view(np.uint8)[: len(packed)] = packed
            upto = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
            self.levels.append((shift, words, upto, self.n - int(upto[-1])))
            symbols = np.concatenate((symbols[~one], symbols[one]))

    @staticmethod
    def _ones(words: np.ndarray, upto: np.ndarray, places: np.ndarray) -> np.ndarray:
        word = places >> 6
        mask = (np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)
        return upto[word] + np.bitwise_count(words[word] & mask)

    def rank(self, symbol: int, places: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before each of ``places`` (0 to n)."""
        low, high = np.zeros(1, np.int64), np.asarray(places, np.int64)
        for shift, words, upto, zeros in self.levels:
            below, above = self._ones(words, upto, low), self._ones(words, upto, high)
            low, high = (zeros + below, zeros + above) if symbol >> shift & 1 else (low - below, high - above)
        return high - low

    def count(self, symbols: tuple[int, ...], places: np.ndarray) -> np.ndarray:
        """How many of ``symbols`` stand before each place: the ranks of the fewer, those in
        the set or those outside it, are added up."""
        others = [s for s in range(1 << len(self.levels)) if s not in symbols]
        if len(others) < len(symbols):
            return np.asarray(places, np.int64) - sum(self.rank(s, places) for s in others)
        return sum(self.rank(s, places) for s in symbols)

    def select(self, symbols: tuple[int, ...], wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The place of the symbol that is number ``wanted`` (from 1) of the set, by bisection
        on ranks between ``low`` and ``high``; ``high`` if there is none before it. Only what is
        still open is asked: past a place found at the very end no rank is defined."""
        low, high = low.copy(), high.copy()
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_]) >> 1
            enough = self.count(symbols, middle + 1) >= wanted[open_]
            high[open_[enough]] = middle[enough]
            low[open_[~enough]] = middle[~enough] + 1
        return low


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits that follow from seed and doc_id; a null doc_id reads as none."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(
    docs: DataFrame, seed: int = 1, unit: str = "token", cut_percent: int = CUT_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT,
    markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE),
) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)``, one row per row of ``docs``.

    ``n`` counts the units of the text, ``form`` is plain, psm (prefix, suffix, middle) or
    spm (suffix, prefix, middle). A text that is empty or null or holds a marker stays plain,
    with null character counts; so do the documents that the draw leaves whole. Equal
    doc_ids get equal draws, whatever their texts. An empty table gives no rows; columns
    other than doc_id and text are not read. No row meets another: nothing is shuffled.
    """
    begins = UNITS[unit]
    marks = [m.encode() for m in markers]
    names = [c.split()[0] for c in RESULT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in passes(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
                data, offsets = flat_bytes(texts.slice(a, b - a))
                columns = _cut(data, offsets, [draws(i, seed) for i in ids[a:b]], begins, cut_percent, suffix_first_percent, marks)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([ids[a:b], *columns], kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, RESULT)


def _cut(data: np.ndarray, offsets: np.ndarray, drawn: list[tuple], begins: tuple[int, ...], cut_percent: int, suffix_first_percent: int, marks: list[bytes]) -> list[list]:
    matrix = WaveletMatrix(byte_classes(data, offsets))
    begun, characters = matrix.count(begins, offsets), matrix.count(UNITS["character"], offsets)
    n = np.diff(begun)
    drawn = np.array(drawn, np.int64).reshape(-1, 4)
    first, second = drawn[:, 0] % (n + 1), drawn[:, 1] % (n + 1)
    low, high = offsets[:-1], offsets[1:]
    cuts = [matrix.select(begins, begun[:-1] + units + 1, low, high) for units in (np.minimum(first, second), np.maximum(first, second))]
    upto = [matrix.count(UNITS["character"], c) for c in cuts]
    prefix_chars, middle_chars = (upto[0] - characters[:-1]).tolist(), (upto[1] - upto[0]).tolist()
    whole = (drawn[:, 2] % 100 >= cut_percent).tolist()
    suffix_first = (drawn[:, 3] % 100 < suffix_first_percent).tolist()
    flat, forms, outputs = data.tobytes(), [], []
    for i, (a, x, y, b) in enumerate(zip(low.tolist(), cuts[0].tolist(), cuts[1].tolist(), high.tolist(), strict=True)):
        text = flat[a:b]
        if whole[i] or a == b or any(m in text for m in marks):
            forms.append("plain")
            outputs.append(text.decode())
            prefix_chars[i] = middle_chars[i] = None
            continue
        prefix, middle, suffix = marks[0] + flat[a:x], marks[2] + flat[x:y], marks[1] + flat[y:b]
        forms.append("spm" if suffix_first[i] else "psm")
        outputs.append((suffix + prefix + middle if suffix_first[i] else prefix + suffix + middle).decode())
    return [n.tolist(), forms, prefix_chars, middle_chars, outputs]


def restored(output: Column, form: Column, markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text itself, rebuilt from an output and its form. A text that holds a marker is
    plain and needs none of this, so a marker in any other form stands where it was put."""
    parts = F.split(output, "|".join(re.escape(m) for m in markers), -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """The cut documents with the SHA-256 of the output and of the text rebuilt from it."""
    made = fill_in_middle(docs)
    text = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))

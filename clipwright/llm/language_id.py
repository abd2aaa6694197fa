"""Language identification with blended-spectrum string kernels.

A text is the set of its character n-grams for n = 1..3 (letters lower-cased, all else a
space), kept as bits at 16-bit hashes. The kernel of two texts is the number of shared bits
over the geometric mean of their bit counts. Landmarks, a few texts of each language, span
a Nyström approximation in which one-versus-rest kernel ridge regression is solved; scoring
a block of texts is two matrix products: bits x landmark bits, then kernels x weights.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipwright.llm.common import passes

BUCKETS = 1 << 16
ORDERS = 3
#: Bounds of the fit: labelled texts and landmarks of each language. The driver gets 8 KB
#: of bits for each labelled text.
TEXTS, LANDMARKS = 240, 24
RIDGE = 1e-2
BLOCK = 64
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(1 << 16)])


def _gram_hashes(codes: np.ndarray) -> list[np.ndarray]:
    """16-bit hashes of the n-grams from each position on, for n = 1..ORDERS."""
    out, rolled = [], np.zeros(len(codes), np.uint32)
    for n in range(ORDERS):
        rolled = rolled[: len(codes) - n] * np.uint32(0x01000193) + codes[n:] + np.uint32(n)
        mixed = rolled * np.uint32(0x9E3779B1)
        out.append(((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA77)) >> np.uint32(16))
    return out


def gram_bits(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, uint8 matrix of presence, whether the text has a letter) in blocks.

    Whole texts, of any length; a pass holds some megabytes of them.
    """
    for i, j in passes([4 * len(t) for t in texts]):
        lowered = [t.lower() for t in texts[i:j]]
        codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
        low = codes < 1 << 16
        letter = np.where(low, _letters()[np.where(low, codes, 0)], False)
        for at in np.flatnonzero(~low).tolist():
            letter[at] = chr(codes[at]).isalpha()
        hashes = _gram_hashes(np.where(letter, codes, 32).astype(np.uint32))
        ends = np.cumsum([len(t) for t in lowered]).tolist()
        begins = [0, *ends[:-1]]
        for first in range(0, j - i, BLOCK):
            spans = list(zip(begins, ends, strict=True))[first : first + BLOCK]
            bits = np.zeros((len(spans), BUCKETS), np.uint8)
            for row, (a, b) in zip(bits, spans, strict=True):
                for n, h in enumerate(hashes):
                    row[h[a : max(a, b - n)]] = 1
            yield i + first, bits, np.array([letter[a:b].any() for a, b in spans])


class Model:
    """Landmark bits and weights; ``scores`` gives one decision for each language."""

    def __init__(self, bits: np.ndarray, labels: np.ndarray, landmarks: np.ndarray):
        self.languages = sorted(set(labels.tolist()))
        marks = bits[landmarks]
        self.columns = np.flatnonzero(marks.any(axis=0))
        self.marks = (marks[:, self.columns].T / np.sqrt(np.maximum(1, marks.sum(axis=1, dtype=np.int64)))).astype(np.float32)
        inner = self.kernel(marks).astype(np.float64)
        values, vectors = np.linalg.eigh(inner)
        solid = values > 1e-6 * values.max()
        whiten = vectors[:, solid] / np.sqrt(values[solid])
        features = np.concatenate([self.kernel(bits[a : a + BLOCK]) for a in range(0, len(bits), BLOCK)]) @ whiten
        features = np.hstack([features, np.ones((len(features), 1))])
        target = np.where(labels[:, None] == np.array(self.languages, object)[None, :], 1.0, -1.0)
        inner = features.T @ features + RIDGE * len(features) / max(1, features.shape[1]) * np.eye(features.shape[1])
        weights = np.linalg.solve(inner, features.T @ target)
        self.weights, self.bias = (whiten @ weights[:-1]).astype(np.float32), weights[-1]

    def kernel(self, bits: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(1, bits.sum(axis=1, dtype=np.int64)))[:, None]
        return bits[:, self.columns].astype(np.float32) @ self.marks / size

    def scores(self, bits: np.ndarray) -> np.ndarray:
        return self.kernel(bits) @ self.weights + self.bias


def fit(labelled: DataFrame, texts: int = TEXTS, landmarks: int = LANDMARKS) -> Model | None:
    """Fits on at most ``texts`` rows ``(doc_id, text, lang)`` of each language, the least by
    the hash of doc_id; of rows that share doc_id and language the one of the least text.
    Null ids, texts and languages are left out; None if nothing is left."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    usable = labelled.filter("lang is not null and text is not null")
    # Only (doc_id, lang) are ranked, with a limit in each task before the shuffle.
    ranked = usable.select("doc_id", "lang").withColumn("rank", F.dense_rank().over(order)).filter(F.col("rank") <= texts).distinct()

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, bits, known in gram_bits(batch.column(0).to_pylist()):
                part = batch.slice(first, len(bits)).filter(pa.array(known))
                packed = pa.array([r.tobytes() for r in np.packbits(bits[known], axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), packed], ["lang", "rank", "bits"])

    # At most `texts` rows of each language: a fixed bound.
    joined = usable.select("doc_id", "lang", "text").join(F.broadcast(ranked), ["doc_id", "lang"])
    sample = joined.groupBy("lang", "rank").agg(F.min("text").alias("text")).select("text", "lang", "rank")
    rows = sorted(((r.lang, r["rank"], r.bits) for r in sample.mapInArrow(each, "lang string, rank int, bits binary").toLocalIterator()))
    if not rows:
        return None
    bits = np.unpackbits(np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), -1), axis=1)
    marks = np.array([r[1] <= landmarks for r in rows])
    if not marks.any():
        marks[:] = True
    return Model(bits, np.array([r[0] for r in rows], object), np.flatnonzero(marks))


def predict(docs: DataFrame, model: Model | None, *carry: Column, with_text: bool = False) -> DataFrame:
    """``(doc_id, *carry, lang_pred, score)``, one row per row; ``with_text`` adds ``text``
    before ``lang_pred``. ``score`` is the share of the
    chosen language in the softmax of the decisions, and 0 for ``und``: a null text, one
    without a letter, or no model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carry, "text")
    passed = len(rows.columns) - (not with_text)
    names = rows.columns[:passed] + ["lang_pred", "score"]

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = shared.value
        for batch in batches:
            langs, score = np.full(len(batch), UNKNOWN, object), np.zeros(len(batch))
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            for first, bits, known in gram_bits(texts) if learned is not None else ():
                decision = 4 * learned.scores(bits)
                odds = np.exp(decision - decision.max(axis=1, keepdims=True))
                best, rows_ = decision.argmax(axis=1), slice(first, first + len(bits))
                langs[rows_] = np.where(known, np.array(learned.languages, object)[best], UNKNOWN)
                score[rows_] = np.where(known, odds.max(axis=1) / odds.sum(axis=1), 0.0)
            columns = [batch.column(i) for i in range(passed)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(score)], names)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:passed]]
    return rows.mapInArrow(each, ", ".join([*fields, "lang_pred string", "score double"]))


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % folds == fold, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``: fits on the rows that are not held out and
    predicts every row. An empty table gives no rows; repeated rows are predicted alike."""
    out = held_out(F.col("doc_id"))
    model = fit(docs.filter(~out).select("doc_id", "text", "lang"))
    return predict(docs, model, out.alias("held_out"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is told; the rejected are null, without a letter,
    or empty texts. Columns as they are. Each row is judged by its own text, so a null or
    repeated doc_id makes no difference; the model learns as in ``identify``."""
    model = fit(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_row")
    told = predict(docs, model, others, with_text=True).filter(F.col("lang_pred") != UNKNOWN)
    return told.select(*[F.col("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])

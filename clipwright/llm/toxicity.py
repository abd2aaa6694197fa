"""Toxicity with a subsequence string kernel and a Nyström support vector machine.

The unit is the word as a reader sees it, in lower case: runs of letters, and beside them
what they make with the signs between them dropped ("id-iot", "m*o*r*o*n") or, single
letters, with the spaces dropped ("s c u m"). A run longer than a word, such as a sentence
without spaces, is read through windows of a few letters at every place. Two
words are compared by the gap-weighted subsequence kernel of order three: every choice of
three letters in order counts, weighted by DECAY for each letter it spans, so an inserted
or lost letter costs a little and not everything. Landmark words span a Nyström
approximation in which a squared-hinge support vector machine is trained.

Labels are of whole texts, so training is of multiple instances: a toxic text is a bag of
words of which one at least is to be decided toxic, a clean text one of which none is. The
first round starts from words that tell toxic bags from clean ones, shown with a letter
inserted too. Each later round adds, for every toxic bag, its witness, the word that the
round before decided sharpest, and the words of clean bags that it took for toxic. A text's score is a logistic function, fitted on the training texts, of its two
sharpest words and of how many words it has, as a long text meets more by chance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipwright.llm.common import passes

DECAY = 0.7
SPAN = 6
#: Letters are put into classes: a-z, the two ends of a word, and other letters by code point.
CLASSES, BEGIN, END, OTHERS = 48, 26, 27, 28
DIMENSIONS = CLASSES**3
#: Bounds of the fit: training texts of each label and their summed length, words shown.
TEXTS, CHARACTERS, WORDS, LANDMARKS = 2500, 16 << 20, 6000, 256
#: A longer text is not learnt from, so that no single one takes the place of many; it is
#: scored like any other.
LEARNT = 1 << 20
#: A telling word: its share of toxic texts is unlikely by this many nats, and it stands in
#: so many toxic texts that are no near copies of each other.
NATS, APART = 9.0, 3
CACHED = 400_000
FEW = 20
#: Tokens that are learnt, and letters of a long run that are read, at a time.
FRESH, STRIP = 50_000, 4096
THRESHOLD = 0.7
#: Letters of a word; a longer run is read through windows of WINDOWS letters.
LONGEST, WINDOWS = 24, (5, 7, 9)
#: Signs are dropped between parts of so many letters at most, where the whole is no word.
SHORT = 1
SIGNS = ".,;:!?\"'()[]{}"
_LETTERS = re.compile(r"[^\W\d_]+")
_SPACED = re.compile(r"(?:(?<!\S)[^\W\d_](?:\s+|$)){3,}")


def plain_words(token: str) -> list[str]:
    """What a token says: its runs of letters, and what they make without the signs between,
    all of them if that is a word, else neighbouring runs of SHORT letters."""
    runs = _LETTERS.findall(token.lower())
    if len(runs) < 2:
        return runs
    if sum(map(len, runs)) <= LONGEST:
        return [*runs, "".join(runs)]
    joined, held = [], []
    for run in [*runs, " " * (SHORT + 1)]:
        if len(run) <= SHORT:
            held.append(run)
        else:
            if len(held) > 1:
                joined.append("".join(held))
            held = []
    return runs + joined


def tokens(text: str) -> set[str]:
    """Distinct tokens of a text, with runs of single letters joined to one more."""
    found = set(text.split())
    if sum(len(t) == 1 for t in found) >= 3:
        found.update(m.replace(" ", "") for m in _SPACED.findall(text))
    return found


@cache
def _choices(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Index triples of a word of this length within SPAN, and their weights."""
    triples = [(i, j, k) for i in range(length) for j in range(i + 1, min(length, i + SPAN)) for k in range(j + 1, min(length, i + SPAN))]
    index = np.array(triples, np.int64).reshape(-1, 3)
    return index, DECAY ** (index[:, 2] - index[:, 0] + 1.0)


def _classes(words: list[str], length: int) -> np.ndarray:
    """Letter classes of words of one length, with both ends marked."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, length).astype(np.int64)
    letters = np.where((codes >= 97) & (codes < 123), codes - 97, OTHERS + codes % (CLASSES - OTHERS))
    return np.hstack([np.full((len(words), 1), BEGIN), letters, np.full((len(words), 1), END)])


def subsequences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, features, weights) of words of equal length: one column for each choice; each
    word's weights are scaled so that its kernel with itself is about one."""
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    for length, rows in by_length.items():
        if length < 3:
            continue
        index, weights = _choices(length + 2)
        for a in range(0, len(rows), 2048):
            part = rows[a : a + 2048]
            letters = _classes([words[i] for i in part], length)
            features = (letters[:, index[:, 0]] * CLASSES + letters[:, index[:, 1]]) * CLASSES + letters[:, index[:, 2]]
            order = np.argsort(features, axis=1)
            ordered = np.take_along_axis(features, order, 1)
            summed = np.cumsum(weights[order], axis=1)
            last = np.ones(ordered.shape, bool)
            last[:, :-1] = ordered[:, 1:] != ordered[:, :-1]
            # Weights of a repeated choice add up before they are squared.
            total = np.where(last, summed, 0.0)
            before = np.maximum.accumulate(total, axis=1)
            before = np.hstack([np.zeros((len(part), 1)), before[:, :-1]])
            each = np.where(last, total - before, 0.0)
            norm = np.sqrt((each * each).sum(axis=1, keepdims=True))
            yield np.array(part), ordered, each / norm


class Projection:
    """A (DIMENSIONS x n) matrix of which most rows are zero."""

    def __init__(self, features: np.ndarray, rows: np.ndarray):
        self.place = np.zeros(DIMENSIONS, np.int32)
        self.place[features] = np.arange(1, len(features) + 1)
        self.rows = np.vstack([np.zeros((1, rows.shape[1])), rows])

    def __call__(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.rows.shape[1]))
        for rows, features, weights in subsequences(words):
            step = max(1, 400_000 // (features.shape[1] * self.rows.shape[1]))
            for a in range(0, len(rows), step):
                out[rows[a : a + step]] = np.einsum("wf,wfn->wn", weights[a : a + step], self.rows[self.place[features[a : a + step]]])
        return out


def dense(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features that occur, words x those features); for the fit only."""
    parts = list(subsequences(words))
    used = np.unique(np.concatenate([p[1].ravel() for p in parts])) if parts else np.empty(0, np.int64)
    out = np.zeros((len(words), len(used)), np.float32)
    for rows, features, weights in parts:
        np.add.at(out, (rows[:, None], np.searchsorted(used, features)), weights)
    return used, out


def diverse(rows: np.ndarray, n: int) -> list[int]:
    """Rows that greedy pivoting on the kernel chooses: each the worst explained so far."""
    left, chosen, basis = (rows * rows).sum(axis=1).astype(np.float64), [], []
    for _ in range(min(n, len(rows))):
        i = int(left.argmax())
        if left[i] < 1e-3:
            break
        column = (rows @ rows[i]).astype(np.float64)
        for b in basis:
            column -= b * b[i]
        column /= np.sqrt(left[i])
        basis.append(column)
        left = np.maximum(left - column * column, 0)
        chosen.append(i)
    return chosen


def train_svm(x: np.ndarray, y: np.ndarray, margin: np.ndarray, weight: np.ndarray, cost: float = 40.0, rounds: int = 60) -> np.ndarray:
    """Squared-hinge linear support vector machine by Newton steps; classes weigh the same.
    Decisions are asked to reach ``margin`` on their side."""
    x = np.hstack([x, np.ones((len(x), 1))])
    side = weight * np.where(y > 0, 0.5 / weight[y > 0].sum(), 0.5 / weight[y <= 0].sum()) * cost * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        active = y * (x @ w) < margin
        xa = x[active] * side[active, None]
        step = np.linalg.solve(np.eye(len(w)) + xa.T @ x[active], xa.T @ (y * margin)[active])
        if np.abs(step - w).max() < 1e-7:
            break
        w = step
    return w


class Model:
    """Word decisions and the curve that makes a text's score of the sharpest."""

    def __init__(self, texts: list[tuple[str, int]], seed: int = 6):
        self.direction: Projection | None = None
        self.bias, self.weights = -1.0, np.array([1.0, 0.0, 0.0, -1.0])
        sets = [({w for t in tokens(text) for w in plain_words(t) if len(w) <= LONGEST}, label) for text, label in texts]
        seen = [Counter(), Counter()]
        for words, label in sets:
            seen[label].update(w for w in words if len(w) >= 3)
        n_toxic = sum(label for _, label in sets)
        n_clean = len(sets) - n_toxic
        if not n_toxic or not n_clean:
            return
        sure = self._telling(sets, seen, n_toxic / (n_toxic + n_clean))
        positive = list(sure)
        rng = np.random.default_rng(seed)
        common = [w for w, _ in sorted(seen[0].items(), key=lambda x: (-x[1], zlib.crc32(x[0].encode())))]
        if not positive or not common:
            return
        inserted = [w[:k] + chr(97 + c) + w[k:] for w, k, c in zip(positive, [int(rng.integers(1, len(w))) for w in positive], rng.integers(0, 26, len(positive)).tolist(), strict=True)]
        known = set(positive)
        # The surer a word, the further from the clean side it is asked to lie.
        asked = np.array([1 + min(1.5, sure[w] / 100) for w in positive])
        told = np.array([seen[1][w] for w in positive], np.float64)
        clean = [w for w in common if w not in known and seen[1][w] <= seen[0][w]]
        negative = clean[: WORDS // 2] + [clean[i] for i in rng.integers(0, len(clean), WORDS // 4)]
        bags = [sorted(w for w in words if len(w) >= 3 and w not in known and not seen[0][w]) for words, label in sets if label and not words & known]
        for turn in range(4):
            pool = positive[: LANDMARKS * 2] + negative[-LANDMARKS * 2 :] + negative[:LANDMARKS]
            used, rows = dense(pool)
            surest = list(range(min(LANDMARKS // 8, len(positive))))
            marks = rows[list(dict.fromkeys(surest + diverse(rows, LANDMARKS - len(surest))))]
            values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
            solid = values > 1e-4 * values.max()
            whiten = marks.T.astype(np.float64) @ (vectors[:, solid] / np.sqrt(values[solid]))
            words = positive + inserted + negative
            y = np.r_[np.ones(len(positive) + len(inserted)), -np.ones(len(negative))]
            w = train_svm(Projection(used, whiten)(words), y, np.r_[asked, asked, np.ones(len(negative))], np.r_[told, told, np.ones(len(negative))])
            self.direction, self.bias = Projection(used, (whiten @ w[:-1])[:, None]), float(w[-1])
            if turn < 3:
                for bag in bags:
                    if bag and (d := self.decide(bag)).max() > 0 and (w := bag[int(d.argmax())]) not in known:
                        known.add(w)
                        positive.append(w)
                        asked, told = np.append(asked, 1.0), np.append(told, 1.0)
                        inserted.append(w)
                decisions = self.decide(clean)
                hard = np.argsort(-decisions)[: WORDS // 8]
                negative += [clean[i] for i in hard if decisions[i] > -0.7]
        self._calibrate(texts)

    def _telling(self, sets: list[tuple[set[str], int]], seen: list[Counter], share: float) -> dict[str, float]:
        """Words whose texts are toxic more often than chance allows, by their evidence."""
        evidence = {}
        for w, n in seen[1].items():
            rate = n / (n + seen[0][w])
            if n >= APART and rate > max(0.6, share):
                nats = n * log(rate / share) + (seen[0][w] * log((1 - rate) / (1 - share)) if rate < 1 else 0)
                if nats >= NATS:
                    evidence[w] = nats
        texts: dict[str, list[set[str]]] = {w: [] for w in evidence}
        for words, label in sets:
            if label:
                for w in words & evidence.keys():
                    if len(texts[w]) < 24:
                        texts[w].append(words)

        def apart(found: list[set[str]]) -> bool:
            kept: list[set[str]] = []
            for words in found:
                if all(2 * len(words & k) < len(words | k) for k in kept):
                    kept.append(words)
                if len(kept) == APART:
                    return True
            return False

        chosen = sorted((w for w in evidence if apart(texts[w])), key=lambda w: (-evidence[w], w))
        return {w: evidence[w] for w in chosen[: WORDS // 4]}

    def _calibrate(self, texts: list[tuple[str, int]]) -> None:
        """Logistic weights of the texts' evidence, by Newton steps; toxic texts count five times."""
        scorer, found = _Scorer(self), []
        for i, j in passes([len(t) for t, _ in texts], 2 << 20):
            found += scorer.evidence([t for t, _ in texts[i:j]])
        x = self.design(np.array(found))
        y = np.array([label for _, label in texts], np.float64)
        weight, w, ridge = 1 + 4 * y, np.zeros(x.shape[1]), np.diag([0.1, 0.1, 0.1, 1e-6])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = x.T @ (weight * (y - p)) - ridge @ w
            step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, gradient)
            w = w + step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    @staticmethod
    def design(found: np.ndarray) -> np.ndarray:
        """Two sharpest decisions, within bounds, and the logarithm of the number of words,
        of which FEW at least are counted, so that empty texts are no extremes."""
        return np.c_[np.clip(found[:, :2], -1.0, [3.0, 2.0]), np.log1p(np.maximum(found[:, 2], FEW)) / 4, np.ones(len(found))]

    def decide(self, words: list[str]) -> np.ndarray:
        """Decision of each plain word; words of under three letters are never toxic."""
        if self.direction is None:
            return np.full(len(words), -1.0)
        out = self.direction(words)[:, 0] + self.bias
        return np.where([len(w) < 3 for w in words], -1.0, out)

    def score(self, found: np.ndarray) -> np.ndarray:
        """Scores of rows of ``evidence``."""
        return 1 / (1 + np.exp(-np.clip(self.design(found) @ self.weights, -30, 30)))


def evidence(first: np.ndarray, second: float, words: int) -> tuple[float, float, float]:
    """(sharpest decision, second sharpest, number of words) of a text's tokens: the sharpest
    of each, the sharpest of what else is in one of them, and their words."""
    if len(first) < 2:
        return float(first.max(initial=-1.0)), second, float(words)
    rest, best = np.partition(first, -2)[-2:]
    return float(best), max(float(rest), second), float(words)


class _Scorer:
    """A task's scorer: decisions of tokens met before are kept, in two bounded generations.
    ``odd`` has (second sharpest, number of words) of those that are not one word."""

    def __init__(self, model: Model):
        self.model, self.recent, self.older = model, {}, {}
        self.odd: dict[str, tuple[float, int]] = {}

    def evidence(self, texts: list[str]) -> list[tuple[float, float, float]]:
        sets = [tokens(t) for t in texts]
        known, fresh = self.recent, []
        for t in set().union(*sets).difference(known):
            if (d := self.older.get(t)) is not None:
                known[t] = d
            else:
                fresh.append(t)
        for i in range(0, len(fresh), FRESH):
            self._learn(fresh[i : i + FRESH])
        out = []
        for s in sets:
            first = np.fromiter(map(known.__getitem__, s), np.float64, len(s))
            second, words = -1.0, len(s)
            for t in s & self.odd.keys():
                other, n = self.odd[t]
                second, words = max(second, other), words + n - 1
            out.append(evidence(first, second, words))
        if len(known) > CACHED:
            self.older, self.recent = known, {}
            self.odd = {t: x for t, x in self.odd.items() if t in known}
        return out

    def _learn(self, fresh: list[str]) -> None:
        """The two sharpest of each token's words, and their number. A long run's windows overlap,
        so only the sharpest of them counts; a token is one of its runs or all of them joined."""
        plain: dict[str, str] = {}
        odd: list[tuple[str, list[str], list[str]]] = []
        for t in fresh:
            word = t.strip(SIGNS)
            if word.isalpha() and len(word) <= LONGEST:
                plain[t] = word.lower()
            else:
                runs = _LETTERS.findall(t.lower())
                odd.append((t, runs, plain_words(t)[len(runs) :]))
        distinct = list(set(plain.values()).union(w for _, runs, joined in odd for w in (*runs, *joined) if len(w) <= LONGEST))
        decided = dict(zip(distinct, self.model.decide(distinct).tolist(), strict=True))
        self.recent.update(zip(plain, map(decided.__getitem__, plain.values()), strict=True))
        for t, runs, joined in odd:
            found = sorted((self._word(w, decided) for w in runs), reverse=True)
            self.recent[t] = max([d for d, _ in found[:1]] + [self._word(w, decided)[0] for w in joined], default=-1.0)
            if len(found) > 1 or (found and found[0][1] > 1):
                self.odd[t] = (found[1][0] if len(found) > 1 else -1.0, sum(n for _, n in found))

    def _word(self, word: str, decided: dict[str, float]) -> tuple[float, int]:
        """(decision, how many distinct words it counts for)."""
        if len(word) <= LONGEST:
            return decided[word], 1
        best, seen = -1.0, set()
        for i in range(0, len(word), STRIP):
            strip = word[i : i + STRIP + max(WINDOWS) - 1]
            windows = {strip[j : j + n] for n in WINDOWS for j in range(len(strip) - n + 1)} - seen
            if windows:
                best = max(best, float(self.model.decide(list(windows)).max()))
                seen |= windows
        return best, max(1, sum(len(w) == WINDOWS[0] for w in seen) // WINDOWS[0])


def fit(labelled: DataFrame, told: DataFrame | None = None, characters: int = CHARACTERS, learnt: int = LEARNT) -> Model:
    """Fits on rows ``(doc_id, text, toxic)``, or ``(doc_id, text)`` and their labels ``told
    (doc_id, toxic)``: of each label the texts of up to ``learnt`` characters in the order of
    the hash of doc_id, TEXTS of them at most and as long as they have half of ``characters``
    together. Rows of one doc_id, text and label count once; the order of rows and files does
    not matter. Null texts and labels are left out; a label all of whose texts are too long has
    none to learn from, as one without a row. Ranking needs no text, so only the texts of the sample leave their tasks."""
    marked = labelled.filter("text is not null").withColumns({"mark": F.xxhash64("text"), "n": F.length("text")})
    light = marked.drop("text")
    if told is not None:
        light = light.join(told.select("doc_id", "toxic"), "doc_id")
    chosen: list[tuple[str, int]] = []
    for label in (1, 0):
        rows = light.filter(F.col("toxic") == label)
        by_hash = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("mark")]
        first = rows.filter(F.col("n") <= learnt).select("doc_id", "mark", "n").distinct().orderBy(*by_hash).limit(TEXTS)
        # TEXTS rows at most, in one window and broadcast: a fixed bound.
        order = Window.orderBy(*by_hash)
        ranked = first.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), F.row_number().over(order).alias("rank"), F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
        ranked = ranked.filter(F.col("upto") <= max(learnt, characters // 2))
        part = marked.select("doc_id", "text", "mark").join(F.broadcast(ranked), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")))
        found = sorted((r["rank"], r.text) for r in part.groupBy("rank").agg(F.min("text").alias("text")).toLocalIterator())
        chosen += [(text, label) for _, text in found]
    return Model(chosen)


def predict(docs: DataFrame, model: Model, *carry: Column) -> DataFrame:
    """``(doc_id, *carry, score, predicted)``, one row per row; a null text is an empty one,
    which scores as a text without a word."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carry, "text")
    names = [c for c in rows.columns if c != "text"] + ["score", "predicted"]

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            found = [d for i, j in passes([len(t) for t in texts], 2 << 20) for d in scorer.evidence(texts[i:j])]
            score = shared.value.score(np.array(found, np.float64).reshape(-1, 3))
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"]
    return rows.mapInArrow(each, ", ".join([*fields, "score double", "predicted int"]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``: learns from the labels of rows that are not
    held out and scores every row. An empty table gives no rows; without both labels, or
    without a telling word, every text scores the same, below the threshold. Texts too long
    to learn from (see ``fit``) are scored."""
    out = held_out(F.col("doc_id"))
    told = labels.filter(~out).select("doc_id", "toxic").distinct()
    model = fit(docs.filter(~out).select("doc_id", "text"), told)
    return predict(docs, model, out.alias("held_out"))

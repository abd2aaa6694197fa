"""Spelling variants: words of a corpus at one edit from each other, and the form each is a
variant of.

Two words at one edit agree on all before the edit and all after it, so with L the length
of the shorter they share their first L // 2 characters or their last. Words meet in groups
of such a part, by the length of the shorter; a group of many words is dealt out again by
the halves of what is left between the shared parts, until groups are small, so no key gets
a large share of the rows. A pair is found in one group only: the one of its common prefix,
or else that of its suffix.

Inside a task the words of a group are a sorted list, walked like a tree: words that share
a prefix share one banded row of the edit matrix (three cells) for it, adjacent longest
common prefixes tell where a row can be kept and where it branches, and the whole range of
words below a prefix whose row exceeds one edit is skipped.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipwright.llm.common import RESIDUES, discard, stored, tasks_of

#: Runs of letters that are words, in the corpus's own spelling.
LETTERS = "[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: One run of so many loses a code point, as a stated share of misspellings.
DAMAGE = 31
#: Words counted in a task before they are passed on, and characters searched at a time.
HELD, WINDOW = 200_000, 1 << 20
#: Rows under one residue of group keys beyond which its groups are dealt out again; rows that
#: one walk takes and queries that it follows at a time.
HOT, SLICE, QUERIES = 20_000, 100_000, 20_000


def corpus_words(docs: DataFrame, damage: int = DAMAGE, least_length: int = LEAST_LENGTH) -> DataFrame:
    """``(word, n)``: the words of at least ``least_length`` code points and how often each occurs.

    A run is lower-cased (A-Z only); if ``damage`` divides the CRC-32 of ``doc_id:run``, the
    run loses the code point at crc % length (0: nothing is lost). Null texts have no words,
    a null doc_id reads as an empty one, and repeated rows count each time. Counts are added
    up in tasks before anything is shuffled.
    """

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile(f"{LETTERS}{{{least_length},}}")
        total: Counter = Counter()
        for batch in batches:
            texts = pc.ascii_lower(batch.column(1)).to_pylist()
            for doc_id, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                begun = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for found in _windows(runs, text or ""):
                    for run, n in Counter(found).items():
                        if damage and (h := zlib.crc32(run.encode(), begun)) % damage == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                            if len(run) < least_length:
                                continue
                        total[run] += n
                if len(total) > HELD:
                    yield _counted(total)
                    total = Counter()
        yield _counted(total)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def _windows(runs: re.Pattern, text: str) -> Iterator[list[str]]:
    """The runs of a text, some at a time; a window ends where no run goes on."""
    gap, begin = re.compile(LETTERS.replace("[", "[^", 1)), 0
    while begin < len(text):
        cut = gap.search(text, begin + WINDOW)
        end = cut.start() if cut else len(text)
        yield runs.findall(text, begin, end)
        begin = end


def _counted(total: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])


def _split(rows: DataFrame, words: Column | None = None) -> DataFrame:
    """Deals groups out by the halves of what lies between their shared parts.

    ``rows (word, n, short, pre, suf, cap)``: words of ``short`` or ``short + 1`` code points
    that agree on the first ``pre`` and the last ``suf``; the pairs to find are those whose
    common prefix is shorter than ``cap``.
    """
    half = F.floor((F.col("short") - F.col("pre") - F.col("suf")) / 2).cast("int")
    by_prefix = F.struct((F.col("pre") + half).alias("pre"), F.col("suf"), F.col("cap"))
    by_suffix = F.struct(F.col("pre"), (F.col("suf") + half).alias("suf"), F.least("cap", F.col("pre") + half).alias("cap"))
    return rows.withColumn("to", F.explode(F.array(by_prefix, by_suffix))).select("word", "n", "short", "to.pre", "to.suf", "to.cap")


def _keyed(rows: DataFrame) -> DataFrame:
    shared = F.concat(F.expr("substring(word, 1, pre)"), F.expr("substring(word, length(word) - suf + 1, suf)"))
    return rows.withColumn("shared", shared).withColumn("residue", F.pmod(F.xxhash64("short", "pre", "suf", "shared"), F.lit(RESIDUES)))


def groups(words: DataFrame, hot: int = HOT) -> DataFrame:
    """``(word, n, short, pre, suf, cap, shared)``: each word once for each group it meets others in.

    A residue of the group keys with over ``hot`` rows sends its groups to be dealt out again;
    at most ``RESIDUES`` of them are broadcast, whatever the number of words. Dealing out ends
    when the parts between differ in a character or two, of which there are few.
    """
    length = F.length("word")
    start = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("short")).filter("short >= 0")
    rows = _keyed(_split(start.selectExpr("*", "0 AS pre", "0 AS suf", "short + 1 AS cap")))
    settled, out = None, ["word", "n", "short", "pre", "suf", "cap", "shared"]
    while True:
        full = rows.filter("short - pre - suf > 1").groupBy("residue").count().filter(F.col("count") > hot).select("residue")
        full = stored(full, "hot-groups")
        if full.isEmpty():
            rest = rows.select(*out)
            return rest if settled is None else settled.unionByName(rest)
        again = F.col("short") - F.col("pre") - F.col("suf") > 1
        marked = rows.join(F.broadcast(full.withColumn("hot", F.lit(True))), "residue", "left").withColumn("hot", F.coalesce("hot", F.lit(False)) & again)
        keep = marked.filter(~F.col("hot")).select(*out)
        settled = keep if settled is None else settled.unionByName(keep)
        rows = _keyed(stored(_split(marked.filter("hot")), "groups"))


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64), np.concatenate(([0], np.cumsum(lengths)))


def near_pairs(codes: np.ndarray, offsets: np.ndarray, group: np.ndarray, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, row) at exactly one edit within a group.

    Row i is ``codes[offsets[i] : offsets[i + 1]]``; rows are sorted inside their group, and
    ``group`` numbers the groups in order.
    """
    size = np.diff(offsets)
    shared = _adjacent_prefixes(codes, offsets, group)
    for begin in range(0, len(queries), QUERIES):
        yield from _walk(codes, offsets[:-1], size, shared, group, queries[begin : begin + QUERIES])


def _adjacent_prefixes(codes: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of each row with the one before; -1 across groups."""
    size = np.diff(offsets)
    shared = np.zeros(len(size), np.int64)
    first = np.ones(len(size), bool)
    first[1:] = group[1:] != group[:-1]
    rows, depth = np.flatnonzero(~first), 0
    while len(rows):
        rows = rows[(size[rows] > depth) & (size[rows - 1] > depth)]
        rows = rows[codes[offsets[rows] + depth] == codes[offsets[rows - 1] + depth]]
        depth += 1
        shared[rows] = depth
    shared[first] = -1
    return shared


def _walk(codes: np.ndarray, starts: np.ndarray, size: np.ndarray, shared: np.ndarray, group: np.ndarray, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    # One state a query and prefix of the list: rows low..high share the prefix of ``depth``
    # characters; cells are the edits to the query's first depth - 1, depth, depth + 1.
    # Edits beyond one are all written 2.
    q = queries
    low, high = np.searchsorted(group, group[q]), np.searchsorted(group, group[q], "right")
    less, same = np.full(len(q), 2), np.zeros(len(q), np.int64)
    more = np.ones(len(q), np.int64)
    depth = 0
    branches = np.flatnonzero(shared <= 0)
    while len(q):
        ends = size[low] == depth
        if ends.any():
            gap = size[q] - depth
            edits = np.select([gap == -1, gap == 0, gap == 1], [less, same, more], 2)
            hit = ends & (edits == 1)
            if hit.any():
                yield q[hit], low[hit]
            low = low + ends
            open_ = low < high
            q, low, high, less, same, more = (x[open_] for x in (q, low, high, less, same, more))
            if not len(q):
                return
        # Ranges of rows that go on with one character: a range begins at ``low`` and wherever
        # a row shares no more than ``depth`` characters with the one before.
        a, b = np.searchsorted(branches, low, "right"), np.searchsorted(branches, high, "left")
        count = b - a + 1
        state = np.repeat(np.arange(len(q)), count)
        nth = np.arange(len(state)) - np.repeat(np.cumsum(count) - count, count)
        inner = nth > 0
        begins = low[state]
        begins[inner] = branches[a[state[inner]] + nth[inner] - 1]
        last = nth == count[state] - 1
        stops = np.empty_like(begins)
        stops[:-1] = begins[1:]
        stops[last] = high[state[last]]
        character = codes[starts[begins] + depth]
        q, less, same, more = q[state], less[state], same[state], more[state]
        differs = [_differs(codes, starts, size, q, depth + k, character) for k in (-1, 0, 1)]
        within = [size[q] >= depth + k for k in (0, 1, 2)]
        new_less = np.where(within[0], np.minimum(less + differs[0], same + 1), 2)
        new_same = np.where(within[1], np.minimum(np.minimum(same + differs[1], more + 1), new_less + 1), 2)
        new_more = np.where(within[2], np.minimum(more + differs[2], new_same + 1), 2)
        alive = np.minimum(np.minimum(new_less, new_same), new_more) <= 1
        q, low, high = q[alive], begins[alive], stops[alive]
        less, same, more = (np.minimum(x[alive], 2) for x in (new_less, new_same, new_more))
        depth += 1
        branches = np.flatnonzero(shared <= depth)


def _differs(codes: np.ndarray, starts: np.ndarray, size: np.ndarray, q: np.ndarray, at: int, character: np.ndarray) -> np.ndarray:
    """1 where the query's character at a place is not the given one or is none at all, else 0."""
    if at < 0:
        return np.full(len(q), 2)
    inside = at < size[q]
    places = np.where(inside, starts[q] + at, 0)
    return (~inside | (codes[places] != character)).astype(np.int64)


def _common_prefix_below(codes: np.ndarray, starts: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, cap: np.ndarray) -> np.ndarray:
    """Whether rows i and j share fewer than ``cap`` characters at their beginning."""
    below, open_, depth = np.zeros(len(i), bool), np.arange(len(i)), 0
    while len(open_):
        a, b = i[open_], j[open_]
        reached = cap[open_] <= depth
        over = (size[a] <= depth) | (size[b] <= depth)
        over[~over] = codes[starts[a[~over]] + depth] != codes[starts[b[~over]] + depth]
        below[open_[over & ~reached]] = True
        open_ = open_[~over & ~reached]
        depth += 1
    return below


NEAR = "word string, n_near long, best_n long, best string"


def _near_in_groups(rows: pa.Table, group: np.ndarray) -> pa.RecordBatch:
    """For the words of whole groups: how many near words were found, and the best of them."""
    words = rows.column("word").to_pylist()
    counts, short, cap = (rows.column(c).to_numpy().astype(np.int64) for c in ("n", "short", "cap"))
    codes, offsets = _codes(words)
    size, starts = np.diff(offsets), offsets[:-1]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for q, w in near_pairs(codes, offsets, group, np.flatnonzero(size == short)):
        once = (size[w] > size[q]) | (w > q)
        q, w = q[once], w[once]
        fits = _common_prefix_below(codes, starts, size, q, w, cap[q])
        found.append((q[fits], w[fits]))
    q, w = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    one, other = np.concatenate((q, w)), np.concatenate((w, q))
    place = np.empty(len(words), np.int64)
    place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((place[other], -counts[other], one))
    one, other = one[order], other[order]
    at, first, n_near = np.unique(one, return_index=True, return_counts=True)
    best = other[first]
    arrays = [pa.array([words[i] for i in at.tolist()], pa.string()), pa.array(n_near, pa.int64()), pa.array(counts[best], pa.int64()), pa.array([words[i] for i in best.tolist()], pa.string())]
    return pa.RecordBatch.from_arrays(arrays, ["word", "n_near", "best_n", "best"])


def _whole_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches regrouped into tables of about SLICE rows or more that cut no group."""
    held: list[pa.Table] = []
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        if sum(map(len, held)) < SLICE:
            continue
        rows = pa.concat_tables(held).combine_chunks()
        group = _group_numbers(rows)
        cut = int(np.searchsorted(group, group[-1]))
        held = [rows.slice(cut)]
        if cut:
            yield rows.slice(0, cut), group[:cut]
    if held:
        rows = pa.concat_tables(held).combine_chunks()
        if len(rows):
            yield rows, _group_numbers(rows)


def _group_numbers(rows: pa.Table) -> np.ndarray:
    new = np.zeros(len(rows), bool)
    for name in ("short", "pre", "suf", "shared"):
        key = rows.column(name)
        new[1:] |= pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy()
    return np.cumsum(new)


def near_words(words: DataFrame, hot: int = HOT) -> DataFrame:
    """``(word, n_near, best_n, best)`` for every word of ``words (word, n)`` that has a near one.

    ``words`` is read several times and should be a stored table without repeated words.
    ``best`` is the near word of the largest n, of several the smallest in code-point order.
    """
    key = ["short", "pre", "suf", "shared"]
    dealt = groups(words, hot).repartition(tasks_of(words), *key).sortWithinPartitions(*key, "word")

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in _whole_groups(batches):
            yield _near_in_groups(rows, group)

    first = F.min(F.struct((-F.col("best_n")).alias("minus"), "best")).alias("first")
    near = dealt.mapInArrow(each, NEAR).groupBy("word").agg(F.sum("n_near").alias("n_near"), first)
    return near.select("word", "n_near", (-F.col("first.minus")).alias("best_n"), F.col("first.best").alias("best"))


def variants(words: DataFrame, least_count: int = LEAST_COUNT, ratio: int = RATIO, hot: int = HOT) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` for the words of ``words (word, n)`` with n of at
    least ``least_count``.

    ``form`` is the best near word if its n is at least ``ratio`` (2 or more) times the word's,
    else null; ``root`` follows forms to the last. Forms grow by that ratio each time, so few
    rounds settle the roots, each round doubling the steps taken. No words give no rows.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, or forms could go in circles")
    kept = stored(words.filter((F.col("n") >= least_count) & F.col("word").isNotNull()).select("word", "n"), "words")
    has_form = F.col("best_n") >= F.col("n") * ratio
    joined = kept.join(near_words(kept, hot), "word", "left")
    formed = stored(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has_form, F.col("best")).alias("form"), F.when(has_form, F.col("best_n")).alias("form_n"),
    ), "forms")
    roots = stored(formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not roots.filter("moved").isEmpty():
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = roots.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        before, roots = roots, stored(step, "roots")
        discard(before)
    return formed.join(roots.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def corpus_variants(docs: DataFrame) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` over the words of all texts."""
    return variants(corpus_words(docs)).select("word", "form", "root", "n", "n_near", "form_n")

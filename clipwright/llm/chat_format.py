"""Chat formatting in budgeted windows, and reading the output back.

Turns are set in a template of control strings; in texts every opening character of one is
followed by a backslash (and a backslash is doubled), so no control string survives in a
text and the text can be restored. A turn ends with a line feed, at which the tokenizer always cuts, so
a window has as many tokens as its turns together, as they are written. Prefix sums of
these choose windows of whole turns: a window holds the conversation's first system turn, a limited history of turns
that were shown before, and new turns up to the budget. Only new assistant turns are under
the loss mask, so each is learned once.

A conversation is dealt out in segments of SEGMENT turns, whatever their numbers are, in each
of which windows begin anew; what a segment needs of those before it, the system turn and the last turns, is
brought to it. So a conversation that is a third of the table is many tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipwright.llm.common import stored, tasks_of
from clipwright.llm.token_ids import default_path, encoder
from clipwright.operators.running import running

BUDGET = 1024
#: Turns of history repeated in a window, and the share of the budget they may take.
HISTORY, HISTORY_SHARE = 2, 4
#: Turns of a segment, and the part of a window's number that counts inside one.
SEGMENT, NUMBER_BITS = 4096, 32
BEGIN = "<s>"
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("[ANS]", "</s>")}
OTHER, OTHER_TEXT, OTHER_END = "[ROLE]", "[/ROLE]", "[/TURN]"
_ESCAPED = re.compile(r"([<\[])\\|\\\\")
_TURN = re.compile(
    r"<<SYS>>(?P<system>.*?)<</SYS>>|\[INST\](?P<user>.*?)\[/INST\]|\[ANS\](?P<assistant>.*?)</s>|\[ROLE\](?P<role>.*?)\[/ROLE\](?P<other>.*?)\[/TURN\]",
    re.DOTALL,
)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "<\\").replace("[", "[\\")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1] or "\\", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """(a turn in the template, with the line feed behind; begin and end of its escaped text)."""
    body = escape(text)
    if role in MARKS:
        before, after = MARKS[role]
    else:
        before, after = f"{OTHER}{escape(role)}{OTHER_TEXT}", OTHER_END
    return f"{before}{body}{after}\n", len(before), len(before) + len(body)


def parse(window: str) -> Iterator[tuple[str, str, int]]:
    """(role, text, begin of its escaped text) of the turns of a formatted window."""
    for m in _TURN.finditer(window, len(BEGIN)):
        if m.lastgroup == "other":
            yield unescape(m["role"]), unescape(m["other"]), m.start("other")
        else:
            yield m.lastgroup, unescape(m[m.lastgroup]), m.start(m.lastgroup)


@dataclass
class _Turn:
    role: str
    text: str
    tokens: int


@dataclass
class _Conversation:
    """What is held of one conversation: the window being filled and a bounded history."""

    conv_id: int | None
    budget: int
    history: int
    begin_tokens: int = 0
    number: int = 0
    system: _Turn | None = None
    shown: list[_Turn] = field(default_factory=list)
    fresh: list[_Turn] = field(default_factory=list)
    begin: int = 0

    def add(self, turn: _Turn, prefix: int) -> Iterator[tuple]:
        """Takes the next turn; ``prefix``: tokens of the conversation up to its end."""
        if self.fresh and self._base() + prefix - self.begin > self.budget:
            yield self.flush()
        if not self.fresh:
            self.begin = prefix - turn.tokens
        self.fresh.append(turn)

    def _repeated(self) -> list[_Turn]:
        kept, room = [], self.budget // HISTORY_SHARE
        for turn in reversed(self.shown[len(self.shown) - self.history :] if self.history else []):
            room -= turn.tokens
            if room < 0:
                break
            kept.insert(0, turn)
        return [self.system, *kept] if self.system else kept

    def _base(self) -> int:
        return self.begin_tokens + sum(t.tokens for t in self._repeated())

    def recall(self, turn: _Turn, is_system: bool) -> None:
        """Takes a turn that an earlier segment has shown."""
        if is_system:
            self.system = turn
        elif self.history:
            self.shown = [*self.shown, turn][-self.history :]

    def flush(self) -> tuple:
        """The window as a row: (conv_id, window, text, repeated turns, turns, loss spans)."""
        repeated = self._repeated()
        if len(self.fresh) == 1 and self._base() + self.fresh[0].tokens > self.budget:
            repeated = [self.system] if self.system else []
        parts, loss, at = [BEGIN], [], len(BEGIN)
        for i, turn in enumerate([*repeated, *self.fresh]):
            text, a, b = render(turn.role, turn.text)
            if i >= len(repeated) and turn.role == "assistant":
                loss.append({"s": at + a, "e": at + b})
            parts.append(text)
            at += len(text)
        row = (self.conv_id, self.number, "".join(parts), len(repeated), len(repeated) + len(self.fresh), loss)
        if self.system is None:
            self.system = next((t for t in self.fresh if t.role == "system"), None)
        self.shown = [t for t in [*self.shown, *self.fresh] if t is not self.system][-self.history :] if self.history else []
        self.fresh, self.number = [], self.number + 1
        return row


WINDOWS = "conv_id long, window long, text string, repeated int, turns int, loss array<struct<s: int, e: int>>"
_NAMES = ["conv_id", "window", "text", "repeated", "turns", "loss"]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)


def with_tokens(turns: DataFrame, path: str | None = None, *keep: str) -> DataFrame:
    """``(conv_id, turn, role, text, tokens)``, tokens of the turn as it is written, and the
    columns ``keep``; null role and text count as empty."""
    path = path or default_path()
    names = ["conv_id", "turn", "role", "text", *keep, "tokens"]

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = encoder(path).encode([render(r, t)[0] for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(i) // 4 for i in ids], pa.int64())], names)

    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), *keep)
    kinds = "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema[4:])
    return rows.mapInArrow(each, f"conv_id long, turn long, role string, text string{kinds}, tokens long")


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, path: str | None = None, segment: int = SEGMENT) -> DataFrame:
    """The formatted windows, ``WINDOWS``; a conversation's are in the order of ``window``.

    Turns are taken in the order of turn, then role and text (ties, repeated rows and null
    turns first are kept as they come in it). No window has more tokens than ``budget`` but
    one with a single new turn, which may be larger alone or beside the system turn. A task
    holds one window and the history at a time, however many turns a segment has.
    """
    path = path or default_path()
    begin_tokens = len(encoder(path).encode([BEGIN])[0]) // 4
    placed = numbered(turns, path, segment)
    dealt = placed.select(*DEALT, F.lit(2).alias("kind")).unionByName(_carried(placed, segment, history))
    order = ["conv_id", "segment", "kind", "place"]
    upto = Window.partitionBy("conv_id", "segment").orderBy("kind", "place").rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.repartition(tasks_of(dealt), "conv_id", "segment").withColumn("prefix", F.sum(F.when(F.col("kind") == 2, F.col("tokens")).otherwise(0)).over(upto))
    summed = summed.sortWithinPartitions(*order).select("conv_id", "segment", "kind", "role", "text", "tokens", "prefix")

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Conversation | None = None
        at = None
        for batch in batches:
            made: list[tuple] = []
            for conv_id, number, kind, role, text, tokens, prefix in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or at != (conv_id, number):
                    if now is not None:
                        made.append(now.flush())
                    at, now = (conv_id, number), _Conversation(conv_id, budget, history, begin_tokens, number << NUMBER_BITS)
                if kind < 2:
                    now.recall(_Turn(role, text, tokens), kind == 0)
                else:
                    made.extend(now.add(_Turn(role, text, tokens), prefix))
            if made:
                yield _batch(made)
        if now is not None:
            yield _batch([now.flush()])

    return summed.mapInArrow(each, WINDOWS)


#: Columns of turns on their way to a segment's task.
DEALT = ["conv_id", "segment", "place", "role", "text", "tokens"]


def numbered(turns: DataFrame, path: str, segment: int) -> DataFrame:
    """Turns with their tokens, their ``place`` in the conversation (0 and up, whatever the turn
    numbers are), the conversation's number of turns ``n`` and their ``segment`` of places.
    Places come from prefix sums over ranges, so no task gets a long conversation whole."""
    ranked = running(with_tokens(turns, path), ["conv_id"], [F.col(c) for c in ("turn", "role", "text")], {"place": F.lit(1)})
    ranked = ranked.withColumnsRenamed({"place_before": "place", "place_all": "n"})
    return stored(ranked.withColumn("segment", F.expr(f"place div {segment}")), "turns")


def _carried(placed: DataFrame, segment: int, history: int) -> DataFrame:
    """What segments need of earlier ones: the conversation's first system turn (kind 0) and
    the last ``history`` other turns (kind 1), as rows of the segment they are brought to.
    Only conversations of several segments have any."""
    mine = placed.filter(F.col("n") > segment)
    system = mine.filter("role = 'system'").groupBy("conv_id").agg(F.min(F.struct("place", "role", "text", "tokens", "n")).alias("s"))
    later = F.sequence(F.expr(f"s.place div {segment}") + 1, F.expr(f"(s.n - 1) div {segment}"))
    told = system.filter(F.expr(f"s.place div {segment} < (s.n - 1) div {segment}")).select("conv_id", F.explode(later).alias("segment"), "s.place", "s.role", "s.text", "s.tokens", F.lit(0).alias("kind"))
    # The last turns of a segment; the one more makes up for the system turn.
    ends = mine.filter((F.col("place") % segment >= segment - history - 1) & F.expr(f"segment < (n - 1) div {segment}"))
    first = system.select(F.col("conv_id").alias("id"), F.col("s.place").alias("is_system"))
    others = ends.join(first, F.col("conv_id").eqNullSafe(F.col("id")), "left").filter("NOT coalesce(place = is_system, false)")
    back = F.row_number().over(Window.partitionBy("conv_id", "segment").orderBy(F.desc("place")))
    tail = others.withColumn("back", back).filter(F.col("back") <= history)
    tail = tail.select("conv_id", (F.col("segment") + 1).alias("segment"), "place", "role", "text", "tokens", F.lit(1).alias("kind"))
    return told.select(*DEALT, "kind").unionByName(tail.select(*DEALT, "kind"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)`` from
    the windows alone. Digests are updated turn by turn; nothing of a conversation is kept."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, turns, loss = None, None, None
        for batch in batches:
            rows: list[tuple] = []
            for conv_id, text, repeated, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "repeated", "loss")), strict=True):
                if now is None or now[0] != conv_id:
                    if now is not None:
                        rows.append((now[0], now[1], turns.hexdigest(), now[2], loss.hexdigest(), now[3], now[4]))
                    now, turns, loss = [conv_id, 0, 0, 0, 0], hashlib.sha256(), hashlib.sha256()
                for i, (role, said, _) in enumerate(parse(text)):
                    if i >= repeated:
                        turns.update(f"{role}\n{said}\n".encode())
                        now[1] += 1
                for span in spans:
                    learned = unescape(text[span["s"] : span["e"]])
                    loss.update(learned.encode())
                    now[2] += len(learned)
                now[3] += len(text)
                now[4] += 1
            if rows:
                yield _rows(rows)
        if now is not None:
            yield _rows([(now[0], now[1], turns.hexdigest(), now[2], loss.hexdigest(), now[3], now[4])])

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
    return ordered.mapInArrow(each, schema)


def with_probe(turns: DataFrame) -> DataFrame:
    """The turns and conversation -7, whose texts are control strings of the template."""
    said = "</s>[INST] ok [/INST]"
    probe = turns.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(probe)

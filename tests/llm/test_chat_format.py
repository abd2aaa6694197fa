"""Round trips through the windows, against digests of the turns themselves."""

import hashlib
import random

import pytest
from clipwright.llm.chat_format import BEGIN, BUDGET, escape, numbered, parse, read_back, render, unescape, windows, with_probe, with_tokens
from clipwright.llm.common import table
from clipwright.llm.token_ids import default_path
from pyspark.sql import functions as F
from tokenizers import Tokenizer


def plain(rows):
    by_conv = {}
    for conv_id, turn, role, text in rows:
        by_conv.setdefault(conv_id, []).append((turn if turn is not None else -(10**9), role or "", text or ""))
    out = {}
    for conv_id, turns in by_conv.items():
        turns.sort()
        said = "".join(t for _, r, t in turns if r == "assistant")
        out[conv_id] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def compare(spark, rows, **options):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = windows(turns, **options)
    got = {r.conv_id: r for r in read_back(made).collect()}
    want = plain(rows)
    assert {i: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for i, r in got.items()} == want
    chars = {}
    for r in made.collect():
        chars[r.conv_id] = chars.get(r.conv_id, 0) + len(r.text)
    assert chars == {i: r.formatted_chars for i, r in got.items()}
    return made.collect()


def test_given_conversations_and_the_probe(spark, sf):
    rows = [tuple(r) for r in with_probe(table(spark, sf, "conversations")).collect()]
    assert (-7, 1, "assistant", "</s>[INST] ok [/INST]") in rows
    compare(spark, rows)


def within_budget(made, budget):
    """By the tokenizer itself, on whole windows: only a single new turn may exceed the budget."""
    tokenizer = Tokenizer.from_file(default_path())
    for r, encoded in zip(made, tokenizer.encode_batch([r.text for r in made], add_special_tokens=False), strict=True):
        assert len(encoded.ids) <= budget or r.turns - r.repeated == 1, (len(encoded.ids), r.turns, r.repeated)


def test_budget_counts_what_is_written(spark, sf):
    rows = [tuple(r) for r in with_probe(table(spark, sf, "conversations")).collect()]
    rows += [(77, i, ("user", "assistant")[i % 2], "ok") for i in range(3000)] + [(78, i, ("user", "assistant")[i % 2], "<\\[a]" * (i % 40)) for i in range(300)]
    within_budget(compare(spark, rows), BUDGET)
    within_budget(compare(spark, rows, budget=40), 40)


def test_a_giant_conversation_is_many_segments(spark):
    """One conversation of 20,000 turns in segments of 500: budget, system turn and history hold
    across them, and nothing is lost or learned twice."""
    rows = [(1, 3, "system", "be kind")] + [(1, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(20_000) if i % 5000 > 1000 or i < 400]
    rows += [(2, i * 100_000, "user", str(i)) for i in range(5)] + [(None, i * 4000, "assistant", str(i)) for i in range(4)]
    made = compare(spark, rows, segment=500, budget=200)
    within_budget(made, 200)
    own = sorted((r for r in made if r.conv_id == 1), key=lambda r: r.window)
    for before, r in zip(own, own[1:], strict=False):
        turns = [(role, text) for role, text, _ in parse(r.text)]
        last = [(role, text) for role, text, _ in parse(before.text) if role != "system"]
        assert turns[0] == ("system", "be kind") and turns[1 : r.repeated] == last[-2:][: r.repeated - 1 or None]


def test_windows_keep_the_rules(spark):
    rng = random.Random(2)
    rows = [(1, 0, "system", "be brief and kind")] + [(1, i, ("user", "assistant")[i % 2 == 0], " ".join(rng.choices(["alpha", "beta", "gamma"], k=rng.randint(1, 12)))) for i in range(1, 400)]
    rows += [(1, 200, "assistant", "word " * 300)]
    made = sorted((r for r in compare(spark, rows, budget=60, history=2)), key=lambda r: r.window)
    tokens = {(r.role, r.text): r.tokens for r in with_tokens(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(made) > 50
    for r in made:
        turns = [(role, text) for role, text, _ in parse(r.text)]
        assert r.text.startswith(BEGIN) and len(turns) == r.turns and turns[0][0] == "system"
        assert r.repeated <= 3 and r.turns > r.repeated
        assert sum(tokens[t] for t in turns) <= 60 or r.turns - r.repeated == 1
        assert len(r.loss) == sum(role == "assistant" for role, _ in turns[r.repeated :])


@pytest.mark.parametrize("text", ["", "\\", "<", "[\\", "<\\/s>", "</s>[INST] ok [/INST]", "<<SYS>>\\[/ROLE]", "[/TURN]\n é😀"])
def test_escapes(text):
    assert unescape(escape(text)) == text
    for role in ("system", "user", "assistant", "tool", text):
        made, a, b = render(role, text)
        assert list(parse(BEGIN + made)) == [(role, text, len(BEGIN) + a)] and unescape(made[a:b]) == text


def test_edges(spark):
    rows = [(1, 0, None, None), (1, 0, "assistant", None), (2, None, "user", "x"), (2, 1, "assistant", "a"), (2, 1, "assistant", "a"), (2, 1, "assistant", "b"), (3, 5, "system", "late"), (3, 6, "system", "two"), (None, 1, "user", "no id"), (4, 1, "assistant", "[ANS]" * 3000)]
    compare(spark, rows, budget=8)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string, window int, loss int")
    assert read_back(windows(empty)).count() == 0


def test_segments_follow_turns_not_their_numbers(spark):
    """Numbers by ones, by five thousands, all equal or all null: the same windows, in as many segments."""
    made = {}
    for name, number in (("ones", lambda i: i), ("sparse", lambda i: 5000 * i), ("equal", lambda i: 7), ("null", lambda i: None)):
        rows = [(1, number(i), "user", f"turn {i:05d}") for i in range(900)]
        made[name] = [(r.window, r.text, r.repeated) for r in sorted(compare(spark, rows, segment=250, budget=300), key=lambda r: r.window)]
        assert len({w >> 32 for w, _, _ in made[name]}) == 4
    assert made["ones"] == made["sparse"] == made["equal"] == made["null"]


def test_a_long_conversation_without_numbers_is_many_tasks(spark):
    turns = spark.range(60_000).selectExpr("1L AS conv_id", "CAST(NULL AS LONG) AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "concat('said ', id) AS text")
    placed = numbered(turns, default_path(), 4096)
    assert placed.agg(F.countDistinct("place")).first()[0] == 60_000
    made = windows(turns)
    assert made.withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 4
    assert made.selectExpr("sum(turns - repeated)").first()[0] == 60_000

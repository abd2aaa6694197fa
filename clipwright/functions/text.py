"""Text and cue extraction as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from clipwright.functions.lexicons import EMOTIONS

GENRES = ["moba", "fps", "horror", "casual", "rpg", "mobile"]
#: Marks of the two output formats; letter case counts.
CUES, EMOTION = r"(?s)Cues:\s*(.*?)(?:\.\s*Emotion:)", r"Emotion:\s*([\p{L}\p{N}_]+)"
THINK, ANSWER = r"(?s)<think>(.*?)</think>", r"(?s)<answer>(.*?)</answer>"


def words(text: Column) -> Column:
    """Tokens between ASCII white space; none are empty."""
    return F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def first_contained(text: Column, names: list[str], otherwise: str) -> Column:
    """The first of ``names`` that the lower-cased text contains."""
    low = F.lower(text)
    return reduce(lambda rest, n: F.when(low.contains(n), n).otherwise(rest), names[::-1], F.lit(otherwise))


def binned(value: Column, bins: list[tuple[float, str]], last: str) -> Column:
    """Label of the first bin whose bound exceeds the value."""
    return reduce(lambda rest, b: F.when(value < b[0], b[1]).otherwise(rest), bins[::-1], F.lit(last))


def half_repeated(w: Column) -> Column:
    """Six words or more whose first half equals the next half; ``w`` is an array of words,
    best a column of its own, so that the text is split once."""
    h = (F.size(w) / 2).cast("int")
    return (F.size(w) >= 6) & (F.slice(w, 1, h) == F.slice(w, h + 1, h))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def any_pattern(text: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns is found, in any letter case; one scan for all."""
    return text.rlike("(?iu)" + "|".join(f"(?:{p})" for p in patterns))


def contained_patterns(text: Column, patterns: list[str]) -> Column:
    return F.filter(F.array(*[F.lit(p) for p in patterns]), lambda p: F.instr(F.lower(text), p) > 0)


def tag(text: Column, name: str) -> Column:
    """Content of the first <name>…</name>; null without one."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?s)<{name}>(.*?)</{name}>", 1)), F.lit(""))


def text_counts(text: Column, w: Column, negative: list[str], games: list[str]) -> list[Column]:
    """Runs of exclamation or question marks, negative words, game terms, and words. ``w``:
    the raw words of the lower-cased text, a column of its own."""
    hits = lambda names: F.size(F.filter(w, lambda x: x.isin(*names)))
    return [F.regexp_count(text, F.lit("[!?]+")), hits(negative), hits(games), F.size(w)]


def text_cue(exclaims: Column, negative: Column, games: Column, n_words: Column) -> tuple[Column, Column]:
    """(the cue's text, its four values in [0, 1]) of ``text_counts``; a text without a word
    says ``no_speech`` and has four zeros."""
    told = F.concat_ws(
        ", ", F.when(exclaims > 0, "exclamation"), F.when(negative > 0, "negative_lexicon"), F.when(games > 0, "game_term"),
        F.concat(n_words.cast("string"), F.lit("_words")),
    )
    silent, tops = n_words == 0, ((exclaims, 5), (negative, 5), (games, 5), (n_words, 30))
    values = F.array(*[F.when(silent, 0.0).otherwise(F.least(c, F.lit(top)) / F.lit(float(top))) for c, top in tops])
    return F.when(silent, "no_speech").otherwise(told), values


def output_parts(raw: Column, fallback: Column) -> Column:
    """``struct<reasoning, answer, valid>`` of tagged model output: cues and emotion where
    both are there; else the last <think>, or the raw text without one, and the first
    <answer>, or the fallback without one. Valid: both of a kind are there."""
    thoughts = F.regexp_extract_all(raw, F.lit(THINK), 1)
    cued, thought, answered = raw.rlike(CUES) & raw.rlike(EMOTION), F.size(thoughts) > 0, raw.rlike(ANSWER)
    return F.struct(
        F.when(cued, strip(F.regexp_extract(raw, CUES, 1))).when(thought, strip(F.try_element_at(thoughts, F.lit(-1)))).otherwise(strip(raw)).alias("reasoning"),
        F.when(cued, F.lower(F.regexp_extract(raw, EMOTION, 1))).when(answered, strip(F.regexp_extract(raw, ANSWER, 1))).otherwise(fallback).alias("answer"),
        (cued | (thought & answered)).alias("valid"),
    )


def told_score(raw: Column, name: str, otherwise: Column) -> Column:
    """The number in <name>…</name>, within [0, 10], or ``otherwise``."""
    pattern = rf"<{name}>\s*([0-9]+(?:\.[0-9]+)?)\s*</{name}>"
    return clamp(F.when(raw.rlike(pattern), F.regexp_extract(raw, pattern, 1).try_cast("double")).otherwise(otherwise), 0.0, 10.0)


def normalised_label(label: Column, confidence: Column, alternatives: Column) -> Column:
    """``struct<label, confidence, alternatives, placeholder, valid>`` of a manual label. No
    label is a placeholder: neutral at 0. ``valid``: the label and all alternatives are known."""
    none, conf = label.isNull(), clamp(confidence, 0.0, 1.0)
    some = F.when(none, F.create_map().cast("map<string,double>")).otherwise(alternatives)
    total = F.aggregate(F.map_values(some), conf, lambda a, x: a + x)
    scale = F.when((F.size(some) > 0) & (total > 0), total).otherwise(1.0)
    known = F.coalesce(label, F.lit("neutral")).isin(*EMOTIONS) & F.forall(F.map_keys(some), lambda k: k.isin(*EMOTIONS))
    return F.struct(
        F.coalesce(label, F.lit("neutral")).alias("label"), F.when(none, 0.0).otherwise(conf / scale).alias("confidence"),
        F.transform_values(some, lambda k, v: v / scale).alias("alternatives"), none.alias("placeholder"), known.alias("valid"),
    )


def consolidated(raw: Column, manual: Column) -> Column:
    """``struct<reasoning, label, confidence, distribution>`` of a consolidator's output: the
    last thought, a known answer or the manual label, a confidence within [0, 1] (a half
    without one), and the known labels of a distribution, scaled to a sum of one. A
    distribution with a value that is no number counts as none."""
    thoughts = F.regexp_extract_all(raw, F.lit(THINK), 1)
    answer = F.lower(F.regexp_extract(raw, r"(?i)<answer>\s*([\p{L}\p{N}_]+)\s*</answer>", 1))
    told = F.regexp_extract(raw, r"(?i)<confidence>\s*([0-9.]+)\s*</confidence>", 1).try_cast("double")
    parsed = F.from_json(F.nullif(F.regexp_extract(raw, r"(?is)<distribution>\s*(\{.*?\})\s*</distribution>", 1), F.lit("")), "map<string,string>")
    numbers = F.transform_values(parsed, lambda k, v: v.try_cast("double"))
    sound = F.when(F.forall(F.map_values(numbers), lambda v: v.isNotNull()), numbers)
    known = F.map_filter(sound, lambda k, v: k.isin(*EMOTIONS))
    total = F.aggregate(F.map_values(known), F.lit(0.0), lambda a, x: a + x)
    spread = F.coalesce(F.when(total > 0, F.transform_values(known, lambda k, v: v / total)).otherwise(known), F.create_map().cast("map<string,double>"))
    return F.struct(
        F.coalesce(strip(F.try_element_at(thoughts, F.lit(-1))), F.lit("")).alias("reasoning"), F.when(answer.isin(*EMOTIONS), answer).otherwise(manual).alias("label"),
        clamp(F.coalesce(told, F.lit(0.5)), 0.0, 1.0).alias("confidence"), spread.alias("distribution"),
    )


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))

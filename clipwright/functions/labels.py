"""Label schemas, languages and modalities as column expressions over fixed maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clipwright.functions.lexicons import EMOTIONS

# Class names of each merge mode in the order of their indices, what they fold, and other schemas.
MODALITIES = ["audio", "face", "context", "text"]
MERGE_MODES = ["none", "amused_as_happy", "merge_hype_amused"]
NAMES = {
    "none": EMOTIONS, "amused_as_happy": ["happy" if n == "amused" else n for n in EMOTIONS],
    "merge_hype_amused": ["neutral", "happy", "tilted", "sad", "shocked", "fear", "disgusted"],
}
MERGED = {"hype": "happy", "amused": "happy"}
ZEROED = {"face_only": ["context"], "dual_path": [], "full_frame": []}
EXTERNAL = {"neutral": "neutral", "hype": "happy", "amused": "happy", "tilted": "anger", "sad": "sad", "shocked": "surprise", "fear": "fear", "disgusted": "disgust"}


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def indices(mode: str = "none") -> dict[str, int]:
    """Class index of every raw label under a merge mode."""
    if mode not in MERGE_MODES:
        raise ValueError(f"unknown merge mode {mode!r}; there are {MERGE_MODES}")
    if mode != "merge_hype_amused":
        return {n: i for i, n in enumerate(EMOTIONS)}
    return {n: NAMES[mode].index(MERGED.get(n, n)) for n in EMOTIONS}


def index_of(label: Column, mode: str = "none") -> Column:
    """Class index of a raw label; 0 for an unknown or null one."""
    return F.coalesce(F.try_element_at(_map(indices(mode)), label), F.lit(0))


def display(index: Column, mode: str = "none") -> Column:
    """Name of a class; an index out of range as its digits."""
    names = F.array(*[F.lit(n) for n in NAMES[mode]])
    inside = (index >= 0) & (index < len(NAMES[mode]))
    return F.when(inside, F.get(names, F.when(inside, index).otherwise(0).cast("int"))).otherwise(index.cast("string"))


def index_or_other(label: Column, other: int = 6) -> Column:
    """Index of a label given as digits or as a name in any case; ``other`` for unknown names."""
    name = F.lower(F.trim(label))
    return F.coalesce(name.try_cast("int"), F.try_element_at(_map(indices()), name), F.lit(other))


def external(label: Column) -> Column:
    """The external schema's name of a raw label; null for an unknown one."""
    return F.try_element_at(_map(EXTERNAL), label)


def zeroed_by(strategy: Column) -> Column:
    """Modalities that a visual strategy sets to zero; none for an unknown one."""
    out = F.array().cast("array<string>")
    for name, gone in ZEROED.items():
        if gone:
            out = F.when(strategy == name, F.array(*[F.lit(g) for g in gone])).otherwise(out)
    return out


def restricted_language(probs: Column, candidates: list[str], least: float) -> Column:
    """``struct<top, language, redo>``: the most likely language of all, that of the candidates
    (the first of equal ones), and whether they differ or the top is less likely than ``least``."""
    def best(names: Column) -> Column:
        ranked = F.transform(names, lambda n, i: F.struct(F.coalesce(F.try_element_at(probs, n), F.lit(0.0)).alias("p"), (-i).alias("i"), n.alias("n")))
        return F.array_max(ranked)

    top, chosen = best(F.map_keys(probs)), best(F.array(*[F.lit(c) for c in candidates]))
    return F.struct(top["n"].alias("top"), chosen["n"].alias("language"), ((chosen["n"] != top["n"]) | (top["p"] < least)).alias("redo"))


def routed(language: Column, routing: str, known: tuple[str, ...] = ("vi", "en")) -> Column:
    """The language whose settings are used: the stored one where it is known, or ``vi``."""
    if routing == "force":
        return F.lit(known[0])
    return F.when(language.isin(*known), language).otherwise(known[0])


def mismatch(stored: Column, heard: Column, read: Column) -> Column:
    """Whether the heard or the read language is known and differs from the stored one; once
    told, it stays."""
    return F.coalesce(stored != heard, F.lit(False)) | F.coalesce(stored != read, F.lit(False))

"""Named cues and attribute vectors of face, voice, motion and text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipwright.functions.text import binned

Bins = list[tuple[float, str]]

# Bounds below which a label holds, and the label beyond the last.
PITCH: tuple[Bins, str] = ([(150.0, "low"), (250.0, "mid")], "high")
LOUDNESS: tuple[Bins, str] = ([(0.02, "quiet"), (0.06, "moderate")], "loud")
RATE: tuple[Bins, str] = ([(2.0, "slow"), (4.0, "normal")], "fast")
ENERGY: tuple[Bins, str] = ([(0.02, "low"), (0.08, "moderate")], "high")
IMPACT: tuple[Bins, str] = ([(0.05, "none"), (0.15, "moderate")], "strong")
PERIOD: tuple[Bins, str] = ([(0.2, "none"), (0.5, "weak")], "rhythmic")
# Bins of reconstructed attributes: eyes, mouth, brows, yaw and pitch (of 45 degrees), f0 (of 300), rms (of 0.1), rate (of 5).
GROUNDED: dict[str, tuple[Bins, str]] = {
    "ear": ([(0.18, "mat-he"), (0.25, "mat-binh-thuong")], "mat-mo"),
    "mar": ([(0.15, "mieng-khep"), (0.40, "mieng-he")], "mieng-mo"),
    "brow_h": ([(0.03, "long-may-thap"), (0.06, "long-may-binh-thuong")], "long-may-cau"),
    "yaw": ([(-0.33, "mat-quay-trai"), (0.33, "mat-nhin-thang")], "mat-quay-phai"),
    "pitch": ([(-0.22, "dau-cuoi"), (0.22, "dau-thang")], "dau-ngoc"),
    "f0": ([(0.50, "giong-tram"), (0.83, "giong-trung")], "giong-cao"),
    "rms": ([(0.20, "noi-nho"), (0.60, "noi-vua")], "noi-to"),
    "rate": ([(0.40, "noi-cham"), (0.80, "toc-do-binh-thuong")], "noi-nhanh"),
}
NO_FACE = "khong-phat-hien-khuon-mat"
# Landmarks of the face mesh that the measures below use.
MESH = {
    "left_eye": (159, 145, 158, 153, 33, 133), "right_eye": (386, 374, 385, 380, 362, 263), "mouth": (13, 14, 82, 312, 78, 308),
    "brows": (70, 159, 300, 386), "nose": 1, "cheeks": (234, 454), "forehead": 10, "chin": 152,
}
EMPTY = 1e-6


def zeros(n: int) -> Column:
    return F.array(*[F.lit(0.0)] * n)


def face_cue(seen: Column, ear: Column, mar: Column, brow: Column, yaw: Column, pitch: Column) -> tuple[Column, Column]:
    """(text, five values); without a face ``no_webcam`` and zeros."""
    parts = F.concat_ws(
        ", ",
        F.when(ear > 0.25, "eyes=wide").when(ear < 0.18, "eyes=narrow"), F.when(mar > 0.4, "mouth=open").when(mar < 0.15, "mouth=closed"),
        F.when(brow > 0.06, "brows=raised").when(brow < 0.03, "brows=lowered"),
        F.when(F.abs(yaw) > 15, F.when(yaw > 0, "head_turn=left").otherwise("head_turn=right")),
        F.when(F.abs(pitch) > 10, F.when(pitch > 0, "head_tilt=up").otherwise("head_tilt=down")),
    )
    seen = F.coalesce(seen, F.lit(False))
    told = F.when(~seen, "no_webcam").when(parts == "", "neutral_pose").otherwise(parts)
    return told, F.when(seen, F.array(ear, mar, brow, yaw / 45.0, pitch / 45.0)).otherwise(zeros(5))


def voice_cue(f0: Column, rms: Column, n_words: Column, duration: Column) -> tuple[Column, Column]:
    """(text, three values); null ``f0`` means no audio."""
    rate = n_words / F.greatest(F.coalesce(duration, F.lit(5.0)), F.lit(0.1))
    told = F.concat(F.lit("pitch="), binned(f0, *PITCH), F.lit(", energy="), binned(rms, *LOUDNESS), F.lit(", rate="), binned(rate, *RATE))
    return F.when(f0.isNull(), "no_audio").otherwise(told), F.when(f0.isNull(), zeros(3)).otherwise(F.array(f0 / 300.0, rms / 0.1, rate / 5.0))


def motion_cue(energy: Column, impact: Column, period: Column) -> tuple[Column, Column]:
    """(text, three values): a strong impact comes first, then energy; null means no data."""
    e, i, p = binned(energy, *ENERGY), binned(impact, *IMPACT), binned(period, *PERIOD)
    told = (
        F.when(energy.isNull(), "no_motion_data")
        .when(i == "strong", "motion — sharp downward arm impact")
        .when((e == "high") & (p == "rhythmic"), "motion — high whole-body energy, rhythmic")
        .when(e == "high", "motion — elevated body movement")
        .when((e == "low") & (i == "none"), "motion — minimal movement")
        .otherwise(F.concat(F.lit("motion — energy="), e, F.lit(", impact="), i))
    )
    at_most_one = [F.least(x, F.lit(1.0)) for x in (energy / 0.15, impact / 0.3, period)]
    return told, F.when(energy.isNull(), zeros(3)).otherwise(F.array(*at_most_one))


def composite(face: tuple, voice: tuple, text: tuple, motion: tuple | None = None) -> tuple[Column, Column]:
    """(cue text, attributes): 15 values with motion, 12 without."""
    parts = [("face", face), ("voice", voice), *([("motion", motion)] if motion else []), ("text", text)]
    said = [x for i, (name, (told, _)) in enumerate(parts) for x in (F.lit(("; " if i else "") + f"{name}: "), told)]
    order = [face, voice, *([motion] if motion else []), text]
    return F.concat(*said), F.concat(*[values for _, values in order])


def grounded(name: str, value: Column) -> Column:
    return binned(value, *GROUNDED[name])


def face_geometry(landmarks: DataFrame, key: str, mesh: dict = MESH) -> DataFrame:
    """``(key, ear, mar, brow_h, yaw, pitch)`` of ``landmarks (key, kp, x, y)``: one group-by
    that picks the needed points. A missing point makes the measures that use it null."""
    ids = sorted({i for v in mesh.values() for i in (v if isinstance(v, tuple) else (v,))})
    pick = lambda i, c: F.max(F.when(F.col("kp") == i, F.col(c))).alias(f"{c}{i}")
    wide = landmarks.filter(F.col("kp").isin(ids)).groupBy(key).agg(*[pick(i, c) for i in ids for c in ("x", "y")])
    x, y = (lambda i: F.col(f"x{i}")), (lambda i: F.col(f"y{i}"))
    apart = lambda a, b: F.sqrt((x(a) - x(b)) * (x(a) - x(b)) + (y(a) - y(b)) * (y(a) - y(b)))

    def aspect(a: int, b: int, c: int, d: int, e: int, f: int) -> Column:
        return (apart(a, b) + apart(c, d)) / (2.0 * F.greatest(apart(e, f), F.lit(EMPTY)))

    def lean(one: Column, other: Column, degrees: float) -> Column:
        return F.when(one + other > EMPTY, (one - other) / (one + other) * degrees).when((one + other).isNotNull(), 0.0)

    b, nose, (left, right) = mesh["brows"], mesh["nose"], mesh["cheeks"]
    return wide.select(
        key, ((aspect(*mesh["left_eye"]) + aspect(*mesh["right_eye"])) / 2).alias("ear"), aspect(*mesh["mouth"]).alias("mar"),
        ((F.abs(y(b[0]) - y(b[1])) + F.abs(y(b[2]) - y(b[3]))) / 2).alias("brow_h"),
        lean(F.abs(x(nose) - x(left)), F.abs(x(nose) - x(right)), 45.0).alias("yaw"),
        lean(F.abs(y(nose) - y(mesh["forehead"])), F.abs(y(nose) - y(mesh["chin"])), 30.0).alias("pitch"),
    )


def label_by_rules(shout: Column, positive: Column, loss: Column, trembling_horror: Column, laughing: Column, nose: Column, sad: Column, brows: Column) -> Column:
    """The annotators' decision tree: shouting first, then what a calm clip shows."""
    loud = F.when(positive, "hype").when(loss, "tilted").when(trembling_horror, "fear").otherwise("shocked")
    calm = F.when(laughing, "amused").when(nose, "disgusted").when(sad, "sad").when(brows & loss, "tilted").otherwise("neutral")
    return F.when(shout, loud).otherwise(calm)


def dominant(rows: DataFrame, key: str, label: str, weight: str, share: float = 0.6) -> DataFrame:
    """``(key, label, share)``: the label with at least ``share`` of the weight, or null."""
    sums = rows.groupBy(key, label).agg(F.sum(weight).alias("w"))
    found = sums.groupBy(key).agg(F.sum("w").alias("all"), F.max(F.struct("w", label)).alias("top"))
    part = F.coalesce(F.try_divide("top.w", "all"), F.lit(0.0))
    return found.select(key, F.when(part >= share, F.col(f"top.{label}")).alias(label), part.alias("share"))

"""Word lists and patterns that results depend on, in their natural order."""

#: Class names in the order of their indices.
EMOTIONS = ["neutral", "hype", "amused", "tilted", "sad", "shocked", "fear", "disgusted"]

#: Words of a negative lexicon, compared with raw lower-case words.
NEGATIVE = [
    "chết", "thua", "lỗi", "sai", "hỏng", "mất", "chán", "dở", "tệ",
    "ngu", "nát", "đau", "khó", "lag", "bug", "rip", "gg", "dead",
    "die", "kill", "loss", "fail", "damn", "shit", "fuck", "wtf",
]

#: Game terms, compared likewise.
GAME_TERMS = [
    "ace", "kill", "headshot", "combo", "ulti", "skill", "buff", "nerf",
    "gank", "push", "farm", "tower", "baron", "dragon", "pentakill",
    "clutch", "gg", "wp", "ez", "ff", "carry", "feed", "noob",
    "rank", "match", "round", "team", "player", "camp", "rush",
]

#: What a transcriber makes up over silence; searched in any letter case.
HALLUCINATIONS = [
    r"subscribe", r"đăng\s*ký", r"like\s*(và|and)\s*share", r"kênh\s+[\p{L}\p{N}_]+", r"cảm\s*ơn.*theo\s*dõi", r"đừng\s*quên",
    r"nhấn\s*(nút|chuông)", r"bỏ\s*lỡ", r"video\s*(tiếp|sau|mới)", r"(phụ đề|subtitle).*tự động", r"www\.|\.com|\.vn|http",
]

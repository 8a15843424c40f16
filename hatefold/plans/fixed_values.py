"""Fixed values.

These values must equal the original project's for its results to be
reproduced (label names and ids, the label crosswalk, the insult heuristic's
word lists, the obfuscation alphabets). They are data, stated as text in their
natural order; the operators take them as parameters and the defaults below
are used only when the caller supplies nothing else.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES — label schema
# ---------------------------------------------------------------------------

# Ten-way single-label ids of the multi-hot corpus.
ID2LABEL = {
    0: "clean",
    1: "악플/욕설",
    2: "여성/가족",
    3: "남성",
    4: "성소수자",
    5: "인종/국적",
    6: "연령",
    7: "지역",
    8: "종교",
    9: "기타혐오",
}

# Multi-hot label columns of the combined corpus, in file order.
MULTI_HOT_LABELS = [
    "여성/가족", "남성", "성소수자", "인종/국적",
    "연령", "지역", "종교", "기타혐오",
    "악플/욕설", "clean",
]

# Column alias repaired when a corpus is read.
COLUMN_ALIASES = {"기타 혐오": "기타혐오"}

# Collapse priority of multi-hot columns into one id: targets, then insult, then clean.
COLLAPSE_PRIORITY = [
    ("여성/가족", 2), ("남성", 3), ("성소수자", 4), ("인종/국적", 5),
    ("연령", 6), ("지역", 7), ("종교", 8), ("기타혐오", 9),
    ("악플/욕설", 1), ("clean", 0),
]

# Macro/micro label crosswalk: (macro, micro or None, target column).
# micro None means "any micro value".
CROSSWALK = [
    ("혐오발언", "여성", "여성/가족"),
    ("혐오발언", "여성/가족", "여성/가족"),
    ("혐오발언", "남성", "남성"),
    ("혐오발언", "성소수자", "성소수자"),
    ("혐오발언", "인종/국적", "인종/국적"),
    ("혐오발언", "연령", "연령"),
    ("혐오발언", "지역", "지역"),
    ("혐오발언", "종교", "종교"),
    ("혐오발언", "기타혐오", "기타혐오"),
    ("혐오발언", "기타", "기타혐오"),
    ("혐오발언", "기타 혐오", "기타혐오"),
    ("단순악플", None, "악플/욕설"),
    ("단순 악플", None, "악플/욕설"),
    ("중립", None, "clean"),
    ("일반 댓글", None, "clean"),
    ("일반", None, "clean"),
    ("clean", None, "clean"),
    ("None", None, "clean"),
]

# Two-head schema.
COARSE_CLASSES = ["clean", "offensive", "hate"]
FINE_COLS = ["gender", "LGBT", "age", "region", "race", "religion", "socioeconomic", "etc"]

# Decision thresholds (inclusive >=).
TWO_HEAD_THRESHOLD = 0.5
BASELINE_THRESHOLD = 0.30
EMPTY_SUSPECT_LABEL = "none"

# Early stopping and monitored metrics.
PATIENCE = 3
MONITORS = ["fine_macro_f1", "fine_micro_f1", "coarse_macro_f1", "coarse_micro_f1"]

# ---------------------------------------------------------------------------
# FIXED VALUES — mined-term cleaning heuristic
# ---------------------------------------------------------------------------

MIN_FREQ = 3
YEAR_PATTERN = r"\d{4}년|\b(19[0-9]{2}|20[0-2][0-9])\b"
YEAR_PREFIX_PATTERN = r"\d{4}년"
SAFE_WORDS = [
    "개념", "개인", "개발", "개성", "개방", "개인적", "개최", "개편", "개정",
    "개학", "개강", "개선", "개요",
]
BAN_PREFIX = ["개", "씨", "좆", "병신", "미친", "씹", "년", "새끼", "후장", "틀딱", "맘충", "급식충"]
EXCEPTION_PREFIX = "개"
SAFE_AFTER_EXCEPTION_PREFIX = ["념", "인", "발", "성", "방", "선", "편", "정", "학"]
FRAGMENTS = [
    "ㅅㅂ", "ㅄ", "ㅂㅅ", "좆", "병신", "씨발", "시발",
    "충", "년", "새끼", "게이", "동성애", "홍어", "짱깨",
    "조센징", "조선족", "동남아", "버러지", "정신병", "역겹", "꼬라지",
]
AUTO_TYPE = "auto_profanity"

# ---------------------------------------------------------------------------
# FIXED VALUES — obfuscation
# ---------------------------------------------------------------------------

SPECIAL_CHARS = ["#", "*", "^", "~", "!", "?"]
LAUGH = ["ㅋ", "ㅋㅋ", "ㅋㅋㅋ"]
NUM_MAP = [("이", "2"), ("일", "1"), ("팔", "8")]
JAMO_REWRITES = [("시발", "ㅅㅣㅂㅏㄹ"), ("씨발", "ㅆㅣㅂㅏㄹ")]
AFFIX_PREFIX = "개"
AFFIX_SUFFIX = "새끼"
BASE_RULES = ["insert_special", "spacing", "elongate"]
PROFANITY_RULES = ["to_jamo", "leet"]
SLUR_RULES = ["prefix_suffix"]
MAX_RULES_PER_TOKEN = 3
ATTEMPTS_PER_VARIANT = 3
MAX_NEW_OFFLINE = 3
MAX_NEW_ONLINE = 2
OFFLINE_TARGET_CLASSES = ["hate", "offensive"]
ONLINE_TARGET_CLASSES = ["hate"]

# Split ratios.
THREE_WAY_RATIOS = (80, 10, 10)
TWO_WAY_RATIOS = (90, 10)
SPLIT_NAMES_3 = ["train", "valid", "test"]
SPLIT_NAMES_2 = ["train", "valid"]

# ---------------------------------------------------------------------------
# FIXED VALUES — Hangul syllable decomposition (Unicode standard tables)
# ---------------------------------------------------------------------------

HANGUL_BASE = 0xAC00
HANGUL_LAST = 0xD7A3
HANGUL_VOWELS_X_FINALS = 21 * 28
HANGUL_FINALS = 28
JAMO_INITIALS = ["ㄱ", "ㄲ", "ㄴ", "ㄷ", "ㄸ", "ㄹ", "ㅁ", "ㅂ", "ㅃ", "ㅅ",
                 "ㅆ", "ㅇ", "ㅈ", "ㅉ", "ㅊ", "ㅋ", "ㅌ", "ㅍ", "ㅎ"]
JAMO_VOWELS = ["ㅏ", "ㅐ", "ㅑ", "ㅒ", "ㅓ", "ㅔ", "ㅕ", "ㅖ", "ㅗ", "ㅘ", "ㅙ",
               "ㅚ", "ㅛ", "ㅜ", "ㅝ", "ㅞ", "ㅟ", "ㅠ", "ㅡ", "ㅢ", "ㅣ"]
JAMO_FINALS = ["", "ㄱ", "ㄲ", "ㄳ", "ㄴ", "ㄵ", "ㄶ", "ㄷ", "ㄹ", "ㄺ", "ㄻ", "ㄼ", "ㄽ", "ㄾ",
               "ㄿ", "ㅀ", "ㅁ", "ㅂ", "ㅄ", "ㅅ", "ㅆ", "ㅇ", "ㅈ", "ㅊ", "ㅋ", "ㅌ", "ㅍ", "ㅎ"]

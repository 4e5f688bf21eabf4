"""Text normalisation and query analysis as column functions.

Everything stays in JVM expressions except ``compose``: Spark has no Unicode
normaliser, so NFC runs as an Arrow batch function. Pass ``nfc=False`` where the
text is known to be composed already.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters treated as white space, and the word characters.
WS = r"[\t-\r\x1c-\x20\x85\p{Z}]"
NON_WORD = r"[^\p{L}\p{N}_]+"

# Vietnamese letters and their base letters.
VN_ACCENTED = (
    "àáảãạăằắẳẵặâầấẩẫậ"
    "èéẻẽẹêềếểễệ"
    "ìíỉĩị"
    "òóỏõọôồốổỗộơờớởỡợ"
    "ùúủũụưừứửữự"
    "ỳýỷỹỵ"
    "đ"
)
VN_BASE = (
    "aaaaaaaaaaaaaaaaa"
    "eeeeeeeeeee"
    "iiiii"
    "ooooooooooooooooo"
    "uuuuuuuuuuu"
    "yyyyy"
    "d"
)

# Words that carry no content, written without accents.
STOPWORDS = [
    "va", "cua", "la", "co", "duoc", "trong", "voi", "mot", "nhung", "theo", "tai", "cho", "ve", "tu", "nay",
    "khi", "nhu", "dang", "nguoi", "cai", "chiec", "mau", "ben", "phia", "tren", "duoi", "kia", "day", "do",
    "cac", "moi", "rat", "cung", "hai", "ba", "dia", "phuong", "mien", "vua", "khoang", "the", "a", "an", "is",
    "are", "was", "were", "in", "on", "at", "with", "and", "or", "of", "to", "for", "from", "that", "this",
]


@F.arrow_udf(T.StringType())
def compose(text: pa.Array) -> pa.Array:
    """Unicode NFC; texts that are composed already, as most are, only pass the quick check.

    Arrow's own ``utf8_normalize`` leaves NFC texts decomposed in the installed version.
    """
    done = unicodedata.is_normalized
    return pa.array([s if s is None or done("NFC", s) else unicodedata.normalize("NFC", s) for s in text.to_pylist()], pa.string())


HANGUL = 0xAC00, 0xD7A3


@cache
def _fold_tables(fold: Callable[[str], str]) -> tuple[str, str, dict[str, str]]:
    """What a fold of single characters does: one-to-one pairs (targets may end early, which deletes), longer results.

    Hangul syllables are left out: their parts follow from the code point.
    """
    pairs, gone, longer = [], [], {}
    for code in range(sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF or HANGUL[0] <= code <= HANGUL[1]:
            continue
        c = chr(code)
        to = fold(c)
        if to == c:
            continue
        if len(to) == 1:
            pairs.append((c, to))
        elif to:
            longer[c] = to
        else:
            gone.append(c)
    return "".join(c for c, _ in pairs) + "".join(gone), "".join(to for _, to in pairs), longer


def _jamo(syllable: Column) -> Column:
    """Letters of one Hangul syllable, from its place in the table of all."""
    lead, vowel, tail = ("".join(map(chr, range(first, first + n))) for first, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27)))
    at = F.ascii(syllable) - HANGUL[0]
    last = at % 28

    def part(letters: str, i: Column) -> Column:
        return F.substring(F.lit(letters), i.cast("int") + 1, F.lit(1))

    return F.concat(part(lead, F.floor(at / 588)), part(vowel, F.floor(at % 588 / 28)), F.when(last > 0, part(tail, last - 1)).otherwise(""))


def _folded(text: Column, fold: Callable[[str], str]) -> Column:
    """``text`` with every character replaced by its fold: a literal ``translate``, and pieces where one becomes several."""
    source, target, longer = _fold_tables(fold)
    several = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in longer) + "]"
    hangul = r"[\x{AC00}-\x{D7A3}]"
    many = F.create_map(*[F.lit(x) for pair in longer.items() for x in pair])
    special = f"{several}|{hangul}"
    pieces = F.regexp_extract_all(text, F.lit(f"{special}|(?:(?!{special})(?s:.))+"), F.lit(0))
    spread = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(f"^{several}$"), F.element_at(many, p)).when(p.rlike(f"^{hangul}$"), _jamo(p)).otherwise(p)), "")
    return F.translate(F.when(text.rlike(special), spread).otherwise(text), source, target)


def _without_marks(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFD", c.casefold()) if unicodedata.category(x) != "Mn").replace("đ", "d")


def _compatible(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


def fold_marks(text: Column) -> Column:
    """Case-folded NFD without non-spacing marks, d with stroke as d."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _folded(text, _without_marks)).otherwise(F.lower(text))


def fold_compat(text: Column) -> Column:
    """Lower-cased NFKD without combining marks, punctuation as blanks, ends trimmed.

    Letters are what the JVM's Unicode version calls so.
    """
    bare = F.when(text.rlike(r"[^\x00-\x7F]"), _folded(text, _compatible)).otherwise(text)
    words = F.regexp_replace(F.translate(F.lower(bare), "đ", "d"), r"[^\p{L}\p{N}_\t-\r\x1c-\x20\x85\p{Z}]", " ")
    return F.regexp_replace(words, f"^{WS}+|{WS}+$", "")


def squeeze(text: Column) -> Column:
    """White space runs as one blank, ends trimmed."""
    return F.trim(F.regexp_replace(text, WS + "+", " "))


def not_ascii(text: Column) -> Column:
    return F.octet_length(text) > F.length(text)


def composed(text: Column) -> Column:
    """Unicode NFC; ASCII texts, which have nothing to compose, do not go to Python."""
    return F.coalesce(compose(F.when(not_ascii(text), text)), text)


def normalize_text(text: Column, nfc: bool = True) -> Column:
    """NFC, white space squeezed, lower case."""
    return F.lower(squeeze(composed(text) if nfc else text))


def strip_accents(text: Column) -> Column:
    """Vietnamese letters without their marks; other letters unchanged."""
    return F.translate(text, VN_ACCENTED, VN_BASE)


def normalize_for_search(text: Column, nfc: bool = True) -> Column:
    """Normalised, accents stripped, punctuation as blanks.

    White space goes with the punctuation; it is squeezed before only where there is a sigma,
    whose lower case depends on what follows it.
    """
    text = composed(text) if nfc else text
    lower = F.lower(F.when(F.contains(text, F.lit("Σ")), squeeze(text)).otherwise(text))
    plain = F.when(not_ascii(lower), strip_accents(lower)).otherwise(lower)
    return F.trim(F.regexp_replace(plain, NON_WORD, " "))


def tokens(normalized: Column) -> Column:
    """Blank-separated tokens of a normalised text, without empty ones."""
    return F.filter(F.split(normalized, " "), lambda t: t != "")


def keywords(normalized: Column) -> Column:
    """Tokens of two or more characters that are not stop words, in order."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(tokens(normalized), lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(squeeze(text), " "), lambda t: t != ""))


def quoted_spans(text: Column) -> Column:
    """Contents of straight, curly or angle quoted spans, joined in order."""
    spans = F.regexp_extract_all(text, F.lit(r'("[^"\r\n]+"|“[^”\r\n]+”|«[^»\r\n]+»)'), F.lit(1))
    inner = F.transform(spans, lambda s: squeeze(F.substring(s, F.lit(2), F.length(s) - 2)))
    return F.array_join(F.filter(inner, lambda s: s != ""), " ")


def quoted_parts(text: Column) -> Column:
    """Distinct contents of double-quoted, then of single-quoted spans."""
    double = F.regexp_extract_all(text, F.lit(r'["“]([^"”]+)["”]'), F.lit(1))
    single = F.regexp_extract_all(text, F.lit(r"'([^']+)'"), F.lit(1))
    parts = F.transform(F.concat(double, single), lambda s: F.regexp_replace(s, f"^{WS}+|{WS}+$", ""))
    return F.trim(F.array_join(F.array_distinct(F.filter(parts, lambda s: s != "")), " "))


def detect_language(text: Column) -> Column:
    """``vi`` when non-ASCII characters exceed 0.3 of the ASCII letters, else ``en``."""
    lower = F.lower(text)
    other = F.length(F.regexp_replace(lower, r"[\x00-\x7f]", ""))
    latin = F.length(F.regexp_replace(lower, "[^a-z]", ""))
    return F.when(other > latin * 0.3, "vi").otherwise("en")


# Time patterns in order of precedence with their unit in seconds.
TIME_PATTERNS = (
    (r"(\d+)\s*giây", 1.0),
    (r"(\d+)\s*phút", 60.0),
    (r"(\d+)\s*tiếng", 3600.0),
    (r"phút\s*thứ\s*(\d+)", 60.0),
    (r"giây\s*thứ\s*(\d+)", 1.0),
    (r"(\d+)\s*seconds?", 1.0),
    (r"(\d+)\s*minutes?", 60.0),
    (r"at\s*(\d+)\s*min", 60.0),
    (r"at\s*(\d+)\s*sec", 1.0),
)
CLOCK_PATTERN = r"(\d{1,2}):(\d{2})(?::(\d{2}))?"
TIME_SPAN_SECONDS = 10.0


def time_reference(text: Column) -> Column:
    """Struct(start, end) in seconds of the first time mentioned, null when none.

    The third group of a clock time counts as thousandths of a second.
    """
    lower = F.lower(text)
    found = [
        F.when(lower.rlike(p), F.regexp_extract(lower, p, 1).cast("double") * unit) for p, unit in TIME_PATTERNS
    ]
    minutes = F.regexp_extract(lower, CLOCK_PATTERN, 1).cast("double")
    seconds = F.regexp_extract(lower, CLOCK_PATTERN, 2).cast("double")
    third = F.regexp_extract(lower, CLOCK_PATTERN, 3)
    millis = F.when(third == "", 0.0).otherwise(third.try_cast("double"))
    clock = F.when(lower.rlike(CLOCK_PATTERN), minutes * 60 + seconds + millis / 1000)
    start = F.coalesce(*found, clock)
    return F.when(start.isNotNull(), F.struct(start.alias("start"), (start + TIME_SPAN_SECONDS).alias("end")))


# Words that mark a question about screen text or about speech.
OCR_MARKERS = (
    "chu", "dong chu", "bang hieu", "bien hieu", "van ban", "tieu de", "man hinh",
    "hien thi", "bien bao", "phu de", "ky tu", "text", "word", "words", "sign",
    "caption", "subtitle", "written", "label", "logo",
)
ASR_MARKERS = (
    "noi", "loi noi", "giong noi", "phat bieu", "hat", "phat am", "loi thoai",
    "hoi thoai", "am thanh", "nghe thay", "bai hat", "ca si", "speech", "say",
    "saying", "said", "voice", "spoken",
)
# Words that mark layout and order in a description.
LAYOUT_MARKERS = (
    "slide", "slideshow", "presentation", "powerpoint", "diagram", "chart", "graph",
    "infographic", "illustration", "cartoon", "animation", "animated", "comic",
    "poster", "screen", "man hinh", "hoat hinh", "nhan vat 3d", "3d",
    "three dimensional", "keo co",
)
ORDER_MARKERS = (
    "bat dau", "sau do", "tiep den", "tiep theo", "ket thuc", "truoc do",
    "truoc khi", "chuyen canh", "chuyen sang", "chuyen tiep", "tiep tuc", "then",
    "followed by", "next", "afterwards", "before", "after", "finally",
    "transition", "scene change", "moving from", "pan from",
)
TEMPORAL_MARKERS = (
    "bat dau", "sau do", "tiep den", "tiep theo", "ket thuc", "truoc do", "then",
    "followed by",
)


def has_marker(normalized: Column, markers: tuple[str, ...]) -> Column:
    """Whole-token match of any marker in a normalised text."""
    return F.concat(F.lit(" "), normalized, F.lit(" ")).rlike(" (" + "|".join(markers) + ") ")


def query_intent(normalized: Column) -> Column:
    return F.when(has_marker(normalized, OCR_MARKERS), "ocr").when(has_marker(normalized, ASR_MARKERS), "asr").otherwise("default")


def visual_features(normalized: Column, folded: Column | None = None) -> Column:
    """Layout and temporal features of a description (both foldings may match)."""
    both = normalized if folded is None else F.concat(normalized, F.lit(" "), folded)
    from_to = r"\bfrom\b.+\bto\b"
    temporal = has_marker(both, ORDER_MARKERS) | normalized.rlike(from_to)
    if folded is not None:
        temporal = temporal | folded.rlike(from_to)
    return F.array_compact(F.array(F.when(has_marker(both, LAYOUT_MARKERS), "layout"), F.when(temporal, "temporal")))


def is_temporal(normalized: Column) -> Column:
    return normalized.rlike("|".join(TEMPORAL_MARKERS))


def _strip(text: Column, chars: str) -> Column:
    return F.regexp_replace(text, f"^[{chars}]+|[{chars}]+$", "")


def _mark_split(text: Column, pattern: str) -> Column:
    """Split on a pattern by marking the cuts first."""
    return F.split(F.regexp_replace(text, pattern, "\u0001"), "\u0001")


def _clauses(text: Column, cuts: list[tuple[str, str]], opening: str, limit: int) -> Column:
    marked = squeeze(text)
    whole = marked
    for pattern, replacement in cuts:
        marked = F.regexp_replace(marked, pattern, replacement)
    parts = F.transform(F.split(marked, "\u0001"), lambda p: _strip(F.regexp_replace(p, opening, ""), " ,.;:-"))
    kept = F.array_distinct(F.filter(parts, lambda p: F.size(F.filter(F.split(p, " "), lambda t: t != "")) >= 4))
    picked = F.slice(kept, 1, limit)
    return F.when(whole == "", F.array().cast("array<string>")).when(F.size(picked) > 0, picked).otherwise(F.array(whole))


# Clause boundaries and opening phrases of English and Vietnamese descriptions.
EN_CUTS = [
    (r"([.!?])\s+", "$1\u0001"),
    (r"(?i),\s*(?:then|followed by|next|afterwards)\s+", "\u0001"),
    (r"(?i)(Tier\s+\d+\s*:)", "\u0001$1"),
]
EN_OPENING = (
    r"(?i)^(?:the\s+)?(?:clip|video|scene|shot)\s+(?:begins?|starts?|ends?)\s+(?:with|by)\s+"
    r"|^then\s+(?:there\s+is\s+)?(?:a\s+shot\s+of\s+)?|^followed\s+by\s+"
)
VI_CUTS = [
    (r"([.!?])\s+", "$1\u0001"),
    (r"(?iu),?\s*(?:sau\s+đó|tiếp\s+đến|tiếp\s+theo)\s+", "\u0001"),
    (r"(?iu)(Tầng\s+\d+\s*:)", "\u0001$1"),
]
VI_OPENING = (
    r"(?iu)^(?:đoạn\s+)?(?:clip|phim|video)\s+(?:bắt\s+đầu|kết\s+thúc)\s+(?:bằng\s+)?(?:cảnh\s+|hình\s+ảnh\s+)?"
    r"|^cảnh\s+quay\s+bắt\s+đầu\s+(?:bằng\s+)?(?:cảnh\s+)?|^sau\s+đó\s+(?:là\s+)?(?:cảnh\s+quay\s+)?"
)


def visual_clauses(text: Column, limit: int = 5) -> Column:
    """Searchable clauses of an English description: at most ``limit`` distinct ones of
    four or more words, else the whole text."""
    return _clauses(text, EN_CUTS, EN_OPENING, limit)


def caption_clauses(text: Column, limit: int = 5) -> Column:
    """The same for Vietnamese descriptions."""
    return _clauses(text, VI_CUTS, VI_OPENING, limit)


# Separators of the lock clauses.
LOCK_CUT = (
    r"(?iu)[ \t]*(?:[.!?;]+|\n+)[ \t]*"
    r"|[ \t]+(?:sau\s+đó|sau\s+do|tiếp\s+theo|tiep\s+theo|rồi|roi|then|followed\s+by)\s+"
)


def lock_clauses(text: Column, split_and: bool = False, limit: int = 5) -> Column:
    """Clauses cut at punctuation, lines, bullets and order words; ``and`` only
    between two sides of five or more words."""
    raw = F.regexp_replace(F.regexp_replace(text, "\r\n|\r", "\n"), "[ \t]+", " ")
    raw = F.regexp_replace(raw, f"^{WS}+|{WS}+$", "")
    raw = F.regexp_replace(raw, "\n[ \t]*[-•*][ \t]*", "\n")
    parts = _mark_split(raw, LOCK_CUT)

    def words(c: Column) -> Column:
        return F.size(F.filter(F.split(squeeze(c), " "), lambda t: t != ""))

    if split_and:

        def expand(p: Column) -> Column:
            sides = _mark_split(p, r"(?iu)\s+(?:and|và|va)\s+")
            two = (F.size(sides) == 2) & F.forall(sides, lambda s: words(s) >= 5)
            return F.when(two, sides).otherwise(F.array(p))

        parts = F.flatten(F.transform(parts, expand))
    clean = F.filter(F.transform(parts, lambda p: _strip(p, " ,:-")), lambda p: words(p) >= 4)
    first = F.filter(
        F.transform(clean, lambda p, i: F.when(F.array_position(F.transform(clean, lambda q: F.lower(q)), F.lower(p)) == i + 1, p)),
        lambda p: p.isNotNull(),
    )
    picked = F.slice(first, 1, limit)
    return F.when(raw == "", F.array().cast("array<string>")).when(F.size(picked) > 0, picked).otherwise(F.array(squeeze(raw)))


# Words after which a description moves to a later scene.
LATER_SCENE = r"(?iuU)\b(?:sau đó|sau vài giây|tiếp đến|tiếp theo|kết thúc|trước đó|trước khi)\b"


def primary_clause(text: Column) -> Column:
    """Text before the first temporal boundary when it has five or more words."""
    whole = squeeze(text)
    head = _strip(F.element_at(_mark_split(whole, LATER_SCENE), 1), " ,.;:")
    cut = whole.rlike(LATER_SCENE) & (word_count(head) >= 5)
    return F.when(cut, head).otherwise(whole)


# Wrappers that name the speaker instead of the speech.
SPEAKER = r"(?:người\s+phụ\s+nữ|người\s+đàn\s+ông|người\s+nam|cô\s+gái|cậu\s+bé|một\s+người)"
SPEAKER_WRAPPERS = (
    rf"(?iuU)\b{SPEAKER}\s+(?:đang\s+)?(?:nói|nói\s+chuyện|trình\s+bày|giảng(?:\s+giải)?|thuyết\s+trình)\s+(?:về|rằng)\s+",
    rf"(?iuU)\b{SPEAKER}\s+đang\s+",
)


def speech_content(text: Column) -> Column:
    """Speech query without its speaker wrapper (first match of each only)."""
    value = squeeze(text)
    for pattern in SPEAKER_WRAPPERS:
        value = F.regexp_replace(value, f"^(?s)(.*?){pattern}", "$1")
    return squeeze(value)


def speech_variants(text: Column, limit: int = 3) -> Column:
    """Array of struct(text, role): the content query first, the original as fallback."""
    original = squeeze(text)
    content = speech_content(text)
    changed = (content != original) & (content != "")
    none = F.lit(None).cast("struct<text:string,role:string>")
    first = F.when(changed, F.struct(content.alias("text"), F.lit("content").alias("role"))).otherwise(none)
    fallback = F.when(
        changed & (F.lower(content) != F.lower(original)),
        F.struct(original.alias("text"), F.lit("original_fallback").alias("role")),
    ).otherwise(none)
    only = F.when(~changed & (original != ""), F.struct(original.alias("text"), F.lit("original").alias("role"))).otherwise(none)
    return F.slice(F.array_compact(F.array(first, fallback, only)), 1, limit)


# Context words and the caption probes they add.
LECTURE_WORDS = ("bài giảng", "bai giang", "lecture", "lesson", "class")
SLIDE_WORDS = ("slide", "trình chiếu", "trinh chieu", "screen")
CONTEST_WORDS = ("thi đấu", "thi dau", "đối đầu", "doi dau", "competition", "kéo co", "keo co", "tug-of-war")
MAP_WORDS = ("bản đồ", "ban do", "map", "bản vẽ", "ban ve")
DIAGRAM_WORDS = ("sơ đồ", "so do", "diagram", "biểu đồ", "bieu do")
TRANSITION_WORDS = ("chuyển cảnh", "chuyen canh", "transition")


def caption_probes(text: Column, translated: Column | None = None, limit: int = 5) -> Column:
    """Caption queries: the text, its translation, and generic concepts it names."""
    original = squeeze(text)
    other = F.lit("") if translated is None else F.coalesce(translated, F.lit(""))
    source = F.concat(F.lower(original), F.lit(" "), F.lower(other))

    def has(words: tuple[str, ...]) -> Column:
        return source.rlike("|".join(words))

    lecture, contest = has(LECTURE_WORDS), has(CONTEST_WORDS)
    probes = F.array_compact(
        F.array(
            original,
            F.when((other != "") & (F.lower(other) != F.lower(original)), other),
            F.when(lecture & contest, "teacher explains competition")
            .when(lecture, "teacher explains lecture")
            .when(contest, "competition"),
            F.when(has(SLIDE_WORDS) & contest, "competition slide"),
            F.when(has(MAP_WORDS), "map"),
            F.when(has(DIAGRAM_WORDS), "diagram"),
            F.when(has(TRANSITION_WORDS), "transition"),
        )
    )
    lowered = F.transform(probes, lambda p: F.lower(p))
    distinct = F.filter(
        F.transform(probes, lambda p, i: F.when(F.array_position(lowered, F.lower(p)) == i + 1, p)), lambda p: p.isNotNull()
    )
    return F.when(original == "", F.array().cast("array<string>")).otherwise(F.slice(distinct, 1, limit))


# Frame regions, corners before edges, on accent-free text.
REGION_PATTERNS = (
    ("top_left", r"\b(?:goc\s*(?:tren|top|upper)\s*(?:ben\s*)?(?:trai|left)|(?:top|upper)[\s-]*(?:left|trai)|(?:left|trai)[\s-]*(?:top|upper|tren))\b"),
    ("top_right", r"\b(?:goc\s*(?:tren|top|upper)\s*(?:ben\s*)?(?:phai|right)|(?:top|upper)[\s-]*(?:right|phai)|(?:right|phai)[\s-]*(?:top|upper|tren))\b"),
    ("bottom_left", r"\b(?:goc\s*(?:duoi|bottom|lower)\s*(?:ben\s*)?(?:trai|left)|(?:bottom|lower)[\s-]*(?:left|trai)|(?:left|trai)[\s-]*(?:bottom|lower|duoi))\b"),
    ("bottom_right", r"\b(?:goc\s*(?:duoi|bottom|lower)\s*(?:ben\s*)?(?:phai|right)|(?:bottom|lower)[\s-]*(?:right|phai)|(?:right|phai)[\s-]*(?:bottom|lower|duoi))\b"),
    ("left", r"\b(?:(?:ben|phia)\s+(?:trai|left)|(?:on|at|to)\s+(?:the\s+)?left|left\s+(?:side|corner|of\s+(?:the\s+)?(?:frame|screen|image)))\b"),
    ("right", r"\b(?:(?:ben|phia)\s+(?:phai|right)|(?:on|at|to)\s+(?:the\s+)?right|right\s+(?:side|corner|of\s+(?:the\s+)?(?:frame|screen|image)))\b"),
    ("top", r"\b(?:(?:phia\s+)?(?:tren|top|upper)\s+(?:khung\s*hinh|man\s*hinh|frame|screen|image)|(?:at|on)\s+(?:the\s+)?top)\b"),
    ("bottom", r"\b(?:(?:phia\s+)?(?:duoi|bottom|lower)\s+(?:khung\s*hinh|man\s*hinh|frame|screen|image)|(?:at|on)\s+(?:the\s+)?bottom)\b"),
)
REGION_OWNER = r"(?:cua\s+(?:khung\s*hinh|man\s*hinh|frame|screen|image)\b|of\s+(?:the\s+)?(?:frame|screen|image)\b)"
REGION_AXES = {
    "left": ["left"],
    "right": ["right"],
    "top": ["top"],
    "bottom": ["bottom"],
    "top_left": ["left", "top"],
    "top_right": ["right", "top"],
    "bottom_left": ["left", "bottom"],
    "bottom_right": ["right", "bottom"],
}


def spatial_query(text: Column, folded: Column, requested: Column | None = None) -> Column:
    """Struct(region, confidence, semantic_text, source) of a frame-relative phrase.

    A known ``requested`` region wins with confidence 1 and leaves the text as it is
    (source ``explicit``); without one, with ``auto``, ``full`` or an unknown name the phrase
    decides (``rule``), else the whole frame is meant (``none``).

    ``folded`` is the accent-free form with the same length as ``text`` (both
    white space squeezed). ``of`` or ``cua`` after the phrase means another object
    and rejects it, unless the frame itself follows.
    """
    none = F.lit(None).cast("struct<region:string,confidence:double,semantic_text:string,source:string>")
    options = []
    if requested is not None:
        asked = F.lower(F.trim(requested))
        named = F.struct(asked.alias("region"), F.lit(1.0).alias("confidence"), text.alias("semantic_text"), F.lit("explicit").alias("source"))
        options.append(F.when(asked.isin(*REGION_AXES) & (text != ""), named).otherwise(none))
    for region, pattern in REGION_PATTERNS:
        before = F.regexp_extract(folded, f"^(?s)(.*?){pattern}", 1)
        phrase = F.regexp_extract(folded, pattern, 0)
        start = F.length(before)
        tail = F.substring(folded, start + F.length(phrase) + 1, F.length(folded))
        follow = F.regexp_replace(tail, r"^[ ,.;:\-]+", "")
        owner = F.regexp_extract(follow, f"^{REGION_OWNER}", 0)
        skipped = F.when(owner != "", F.length(tail) - F.length(follow) + F.length(owner)).otherwise(0)
        rejected = follow.rlike(r"^(?:cua|of)\b") & (owner == "")
        rest = squeeze(
            F.concat(
                F.substring(text, F.lit(1), start),
                F.lit(" "),
                F.substring(text, start + F.length(phrase) + skipped + 1, F.length(text)),
            )
        )
        hit = F.struct(
            F.lit(region).alias("region"),
            F.lit(0.96 if len(REGION_AXES[region]) == 2 else 0.92).alias("confidence"),
            F.when(rest == "", text).otherwise(rest).alias("semantic_text"),
            F.lit("rule").alias("source"),
        )
        options.append(F.when(folded.rlike(pattern) & ~rejected, hit).otherwise(none))
    full = F.struct(F.lit("full").alias("region"), F.lit(0.0).alias("confidence"), text.alias("semantic_text"), F.lit("none").alias("source"))
    return F.coalesce(*options, full)


def split_events(text: Column) -> Column:
    """Event lines of a script: lines, arrows and semicolons, numbering removed."""
    parts = _mark_split(text, "\n+|->|→|;")
    clean = F.transform(
        parts,
        lambda p: F.regexp_replace(
            F.regexp_replace(p, r"(?i)^\s*(e\d+|event\s*\d+|\d+)\s*[:.)-]\s*", ""), f"^{WS}+|{WS}+$", ""
        ),
    )
    return F.filter(clean, lambda p: p != "")


def lane_text(mode: Column, query: Column, ocr_query: Column, asr_query: Column) -> Column:
    """Struct(ocr_text, asr_text): an explicit override, a quoted span in the
    visual_ocr mode, else the whole query."""
    quoted = F.when(mode == "visual_ocr", quoted_spans(query)).otherwise(F.lit(""))
    given_ocr = F.when(F.trim(ocr_query) != "", F.trim(ocr_query))
    given_asr = F.when(F.trim(asr_query) != "", asr_query)
    return F.struct(
        F.coalesce(given_ocr, F.when(quoted != "", quoted), F.trim(query)).alias("ocr_text"),
        squeeze(F.coalesce(given_asr, query)).alias("asr_text"),
    )


def char_bigrams(token: Column) -> Column:
    """Distinct character pairs of a token padded with ``#``."""
    padded = F.concat(F.lit("#"), token, F.lit("#"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(token) + 1), lambda i: F.substring(padded, i, F.lit(2))))


def bigram_dice(a: Column, b: Column) -> Column:
    """Dice coefficient over padded character bigrams."""
    x, y = char_bigrams(a), char_bigrams(b)
    dice = F.lit(2.0) * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(dice)


def ngrams(toks: Column, low: int = 2, high: int = 6) -> Column:
    """Ordered n-grams of ``low`` to ``high`` tokens."""
    n = F.size(toks)
    sizes = F.filter(F.array(*[F.lit(s) for s in range(low, high + 1)]), lambda s: s <= n)
    return F.flatten(
        F.transform(
            sizes,
            lambda s: F.transform(F.sequence(F.lit(1), n - s + 1), lambda i: F.array_join(F.slice(toks, i, s), " ")),
        )
    )


def pack_evidence(task: Column, candidate: Column, texts: dict[str, Column], clip: int = 240) -> Column:
    """Candidate as a compact JSON line with squeezed, clipped texts."""
    fields = [F.substring(squeeze(c), 1, clip).alias(name) for name, c in texts.items()]
    return F.to_json(F.struct(task.alias("task"), candidate.alias("id"), *fields))


# Phrases and the variants they expand to, in order.
SYNONYMS = (
    ("áo đỏ", ("áo đỏ", "áo màu đỏ", "diễn giả mặc áo đỏ", "người mặc áo đỏ")),
    ("áo xanh", ("áo xanh", "áo màu xanh", "người mặc áo xanh")),
    ("áo trắng", ("áo trắng", "áo màu trắng", "người mặc áo trắng")),
    ("vest", ("vest", "áo vest", "bộ vest", "suit")),
    ("áo dài", ("áo dài", "áo truyền thống", "áo nón dìa")),
    ("chạy", ("chạy", "running", "sprint", "giậm chân")),
    ("nhảy", ("nhảy", "jump", "leap", "giậm nhảy", "nhảy cao")),
    ("đi bộ", ("đi bộ", "walking", "walk")),
    ("ngồi", ("ngồi", "sitting", "sit", "ngồi xuống")),
    ("đứng", ("đứng", "standing", "stand", "đứng lên")),
    ("diễn giả", ("diễn giả", "người nói", "speaker", "người thuyết trình")),
    ("giám khảo", ("giám khảo", "judge", "ban giám khảo", "jury")),
    ("mc", ("mc", "host", "người dẫn chương trình", "người dẫn")),
    ("vận động viên", ("vận động viên", "athlete", "vđv")),
    ("micro", ("micro", "microphone", "mic", "vi mô", "microphone cầm tay")),
    ("bảng", ("bảng", "board", "blackboard", "whiteboard", "bảng trắng", "bảng đen")),
    ("máy tính", ("máy tính", "computer", "laptop", "pc")),
    ("điện thoại", ("điện thoại", "phone", "smartphone", "điện thoại di động")),
    ("sân khấu", ("sân khấu", "stage", "đài", "stage area")),
    ("phòng gym", ("phòng gym", "gym", "phòng tập gym", "fitness center")),
    ("bãi biển", ("bãi biển", "beach", "cánh đồng", "field")),
    ("phòng họp", ("phòng họp", "meeting room", "conference room")),
)


def expand_query(text: Column, normalized: Column, limit: int = 5) -> Column:
    """The query followed by up to ``limit`` distinct variants of the phrases it contains."""
    lower = F.lower(text)
    groups = [
        F.when(F.contains(normalized, F.lit(p)) | F.contains(lower, F.lit(p)), F.array(*[F.lit(v) for v in variants])).otherwise(
            F.array().cast("array<string>")
        )
        for p, variants in SYNONYMS
    ]
    return F.slice(F.array_distinct(F.concat(F.array(text), *groups)), 1, limit + 1)


def user_context(turns: DataFrame, last: int = 3) -> DataFrame:
    """Per user turn the last ``last`` user messages of the conversation, itself included.

    Each message is copied to the next turns it belongs to and regrouped, so no
    window has to hold a conversation.
    """
    from reelweave.operators.timeline import positions

    said = positions(turns.filter("role = 'user'"), ["conv_id"], "turn", name="_n")
    copies = said.select("conv_id", F.explode(F.sequence("_n", F.col("_n") + (last - 1))).alias("_n"), F.struct("turn", "text").alias("_m"))
    joined = copies.groupBy("conv_id", "_n").agg(F.sort_array(F.collect_list("_m")).alias("_ms"))
    return said.select("conv_id", "turn", "_n").join(joined, ["conv_id", "_n"]).select(
        "conv_id", "turn", F.array_join(F.transform("_ms", lambda m: m["text"]), " ").alias("context")
    )

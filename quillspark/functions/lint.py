"""Warnings about a translation, from patterns and densities, and from forms of address that a source has."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import style as S
from quillspark.functions import text as X
from quillspark.functions.repair import lost_address

# Patterns of the language pair, by name; (?U) makes \b and \s know its letters.
PATTERNS = (
    ("one_of_action", r"(?iU)(?:cười|nhìn|liếc|gật đầu|thở dài|vỗ|đá|đấm|lắc đầu|hôn|ôm|cắn|nhảy|hét|quét)\s+một cái"),
    ("carry_out", r"(?iU)\b(?:tiến hành|thực hiện)\s+(?:tấn công|phòng ngự|tu luyện|điều tra|chữa trị|luyện chế|thăm dò|so sánh)"),
    ("as_for_x", r"(?iU)đối với\s+[^,.;!?]{1,30}\s+(?:tới|mà)\s+nói"),
    ("in_reality", r"(?iU)\btrên thực tế\b"),
    ("markdown", r"(?mU)\*\*|^#{1,3}\s|```"),
    ("hyphened_name", r"(?U)\b[A-ZĐ][a-zà-ỹ]+(?:-[a-zà-ỹ]+){2,}\b"),
    ("old_master", r"(?U)\bLão Chủ\b"),
    ("addressed_in_narration", r"(?U)(?:^|\. )[^\"“\n]{0,80}\bkỳ vọng (?:cậu|bạn)\b"),
    ("bare_address", r"(?U)(?:^|[.!?…]\s+)(?:Anh|Cô)\s+(?!ta\b|ấy\b|trai\b|hùng\b|nương\b|gái\b|em\b)[a-zà-ỹ]+"),
    ("cannot_help", r"(?iU)\bkhông khỏi\b"),
    ("basically", r"(?iU)\bcăn bản là\b"),
    ("after_all", r"(?iU)\brốt cuộc là\b"),
    ("directly", r"(?iU)\btrực tiếp\s+(?:đi|đến|nói|hỏi|ra tay|đánh|giết|ném|đẩy|mở|đóng)\b"),
    ("head_counter", r"(?iU)\bmột đầu\b(?!\s+tiên)"),
    ("pinyin", r"[āēīōūǖǎěǐǒǔǘǚǜ]"),
    ("clan_prefix", r"(?U)\b[Gg]ia tộc\s+[A-ZĐ][a-zà-ỹ]*\b"),
    ("english_sound", r"(?iU)\b(?:cough|sigh|ahem|gasp|hmph|tsk)\b"),
    ("always_feel", r"(?iU)\btổng cảm thấy\b"),
    ("script_left", r"[一-鿿㐀-䶿]+"),
    ("glued_words", r"[a-zà-ỹ][A-ZĐ][a-zà-ỹ]"),
)
HE, NEGATION = r"(?iU)\bhắn\b", r"(?iU)\bchẳng\b"
SELF_IN_SPEECH = r"(?U)(?:^|[\"“,.!?…:]\s*)[Mm]ình\s+(?:đã|chắc|sẽ|không|chẳng|phải|cũng|còn|vừa|mới|chết|bị|đang)"
SENTENCE_BREAK = r"(?U)[.!?…][\"”’]*\s+|\n+"


def lint_warnings(target: Column, most: int = 3, source: Column | None = None) -> Column:
    """array<string> of warnings: with a source, each form of address of which the target keeps no trace; a pattern's name once; sentences that repeat a pronoun and speech in the first person up to
    `most` times each; loud paragraphs, many negations and mixed narrator pronouns once. Null for a null text."""
    named = [F.when(target.rlike(p), F.lit(name)) for name, p in PATTERNS]
    repeats = F.filter(F.split(target, SENTENCE_BREAK), lambda s: X.count_matches(s, HE) >= 3)
    loud = F.exists(F.split(target, "\n"), lambda p: X.str_count(p, "!") > 2)
    speech = F.filter(F.regexp_extract_all(target, F.lit(S.DIALOGUE), F.lit(0)), lambda s: s.rlike(SELF_IN_SPEECH))
    told = S.narrator_terms(target)
    mixed = (F.size(F.filter(told, lambda w: w == "hắn")) >= 3) & (F.size(F.filter(told, lambda w: w == "y")) >= 3)
    flags = F.array_compact(F.array(*named, F.when(loud, F.lit("loud")), F.when(X.count_matches(target, NEGATION) >= 4, F.lit("negations")), F.when(mixed, F.lit("mixed_narrator"))))
    several = lambda hits, name: F.array_repeat(F.lit(name), F.least(F.size(hits), F.lit(most)))
    lost = F.transform(lost_address(F.lit("") if source is None else F.coalesce(source, F.lit("")), target), lambda x: F.concat(F.lit("address_lost "), x))
    return F.when(target.isNotNull(), F.concat(lost, flags, several(repeats, "repeated_pronoun"), several(speech, "self_in_speech")))


def lint_score(target: Column, source: Column | None = None) -> Column:
    """Number of warnings; 0 is clean, null for a null text."""
    return F.when(target.isNotNull(), F.size(lint_warnings(target, source=source)))

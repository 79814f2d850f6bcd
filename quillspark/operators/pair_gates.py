"""Gates of translated pairs: rule tables for gates.first_reason and gates.all_reasons, and tests that are one column.

Texts are stripped first and a null text counts as empty, so no gate gives null. Sources are to be cleaned beforehand.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import style as S
from quillspark.functions import text as X
from quillspark.operators.gates import Rules, first_reason

# Characters and patterns of the corpora, by what they find and in which gate.
SCRIPT = "[㐀-鿿]"
QUOTES_FOUR = (("“", "”"), ("‘", "’"), ("「", "」"), ("『", "』"))
NUMBER, NUMBER_PERCENT, NUMBER_JOINED = r"(?U)\d+", r"(?U)\d+(?:\.\d+)?%?", r"(?U)\d+(?:[.:/]\d+)*"
BROKEN_TEACHER = "�|Ã.|Â.|â€"
BROKEN_INTERNAL = "�|Ãƒ|Ã‚(?=\\s|[\"'.,;:!?])|Ã¢(?:â‚¬|â„¢|Å“|Å¾)|Ã„(?:â€˜|â€™)"
BROKEN_CANDIDATE = r"[\x00�]|\?{2,}|Ã.|Â."
BROKEN_PACK = r"Ã.|Â.|â€|�|\\u00[a-f0-9]{2}"
BROKEN_EXTERNAL = r"(?i)[\x00�]|https?://|www\."
BROKEN_LITERATURE = r"[\x00�]"
SLOT_TEACHER = r"<[^>]{1,40}>|\{\{[^}]{1,40}\}\}|\[\[.*?\]\]"
SLOT_INTERNAL = r"ZX\d{3}Q|⟦\d{3}⟧|(?<![A-Za-z])[JWZF]{2,4}(?![A-Za-z])"
SLOT_CANDIDATE = r"(?i)\[/?(?:ZH|VI|UNK|MASK)\]|<[^>]+>|\{\{.+?\}\}"
SLOT_PACK = r"(?i)\*{2,}|\[/?(?:ZH|VI|UNK|MASK)\]|<[^>]+>|\{\{.+?\}\}"
SLOT_EXTERNAL = r"(?i)(?:^|\s)(?:\*{2,}|\[\s*ads?\s*\])(?:\s|$)"
AUTHOR = "(?iu)tác giả có lời|lời tác giả|bản chương chưa hết|xin hãy chờ|作者有话说|本章未完|求票|求收藏|求推荐|求月票|感谢支持"
ADVERTISEMENT = r"(?i)求票|求收藏|求推荐|求月票|作者的话|感谢支持|请投票|PS：|P\.S\."
GARBAGE = r"(?i)作者|本章完|求收藏|求推荐|求月票|QQ群|公众号|微信|http|www\.|不jing"
PINYIN = r"(?iu)(?<![a-z])[a-z]{1,8}[āáǎàēéěèīíǐìōóǒòūúǔùǖǘǚǜ][a-z]{0,8}(?![a-z])"
PLAIN_PINYIN = r"(?i)(?<=[㐀-鿿])(?:jing|xing|se|she|rou|jiao)(?=[㐀-鿿])"
MODERN_LITERATURE = r"(?iU)\b(?:tôi|anh|em|cậu|bạn|mình|anh ấy|cô ấy|cậu ấy)\b"
OLD_AND_NEW = (("conflict_female", "nàng", "cô (?:ta|ấy)"), ("conflict_male", "hắn", "anh (?:ta|ấy)"))
ENDEARMENT = r"(?iU)(?<!\w)(?:anh|em)(?!\w)(?!\s*(?:trai|gái|ấy|họ|ta\b))"
MISREAD = (("棒梗", r"(?iU)\bXoạ\s+Trụ\b", "wrong_person"), ("傻柱", r"(?iU)\bXoạ\s+Trụ\b", "mixed_reading"), ("一大爷|二大爷|三大爷", r"(?iU)\bdượng\b", "wrong_kinship"))
QUOTED_LINE = r'"[^"\n]*"|“[^”\n]*”|「[^」\n]*」'
CLAUSE_HEAD = r"(?:^|[,;]\s*|\b(?:thì|nhưng|và|rồi|nên|mà|vì|khi|nếu|còn)\s+)"
VERBS_REPLAY = "đã|sẽ|đang|vẫn|cũng|bị|được|phải|không|chẳng|liền|lại|có|là|cảm|thấy|nghĩ|biết|muốn|nhìn|nói|tưởng|hiểu|định|nhớ|quyết|thầm|vừa|mới|chỉ|hơi|quả|còn|rất"
VERBS_MINED = "đã|sẽ|đang|vẫn|cũng|bị|được|phải|không|chẳng|liền|lại|có|là|cảm|nghĩ|biết|muốn|thấy|nhìn|nói|ngồi|đứng|đi|quay"
THIRD_REPLAY, THIRD_MINED = "anh ta|cô ta|cô ấy|cậu ta|ông ta", "anh ta|anh ấy|cô ta|cô ấy|cậu ta|ông ta|bà ta"
KEY_DROPS = "(?U)[\\s\"“”‘’'，。！？、：；,.!?…]"


def stripped(*texts: Column) -> tuple[Column, ...]:
    return tuple(X.trim_unicode(F.coalesce(c, F.lit(""))) for c in texts)


def _either(s: Column, t: Column, *patterns: str) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | s.rlike(p) | t.rlike(p)
    return found


def _uneven(s: Column, t: Column, pairs: Sequence[tuple[str, str]] = X.QUOTE_PAIRS) -> Column:
    return ~X.quotes_balanced(s, pairs) | ~X.quotes_balanced(t, pairs)


def _numbers_differ(s: Column, t: Column, pattern: str) -> Column:
    of = lambda c: F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    return of(s) != of(t)


def _ratio(s: Column, t: Column, length=F.length) -> Column:
    return length(t) / F.greatest(length(s), F.lit(1))


def teacher_line_rules(s: Column, t: Column) -> Rules:
    """A teacher's line, first reason."""
    s, t = stripped(s, t)
    return [
        ("empty_or_other_script", (t == "") | ~s.rlike(SCRIPT)), ("script_leak", t.rlike(SCRIPT)), ("mojibake", _either(s, t, BROKEN_TEACHER)), ("unbalanced_quotes", _uneven(s, t, QUOTES_FOUR)),
        ("modern_register", t.rlike(S.any_of(S.MODERN))), ("author_note", _either(s, t, AUTHOR)), ("placeholder", _either(s, t, SLOT_TEACHER)), ("pinyin_in_source", s.rlike(PINYIN) | s.rlike(PLAIN_PINYIN)),
        ("numbers", _numbers_differ(s, t, NUMBER)), ("length_ratio", ~_ratio(s, t, X.dense_length).between(0.25, 4.0)),
    ]


def teacher_row_rules(s: Column, t: Column, meta: Column, model_prefix: str) -> Rules:
    """A teacher's chapter, first reason. meta: teacher_tier, model, finish_reason, quality_bucket, source_line_count, target_line_count."""
    brk = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
    n = lambda c: F.when(c == "", 0).otherwise(F.size(F.split(F.regexp_replace(c, rf"(?:{brk})\z", ""), brk)))
    s, t, known = F.coalesce(s, F.lit("")), F.coalesce(t, F.lit("")), lambda test: F.coalesce(test, F.lit(False))
    return [
        ("missing_metadata", meta.isNull()), ("tier_or_model", ~known(F.lower(meta["teacher_tier"]).isin("pro", "flash") & F.startswith(meta["model"], F.lit(model_prefix)))),
        ("unfinished", ~known((meta["finish_reason"] == "stop") & (meta["quality_bucket"] == "strict_clean"))), ("missing_pair", (s == "") | (t == "")),
        ("line_alignment", n(s) != n(t)), ("declared_counts", ~known((meta["source_line_count"] == n(s)) & (meta["target_line_count"] == n(t)))),
    ]


def structure_ok(t: Column) -> Column:
    """Target without source script, mojibake and uneven quotes."""
    return ~(t.rlike(SCRIPT) | t.rlike(X.MOJIBAKE)) & X.quotes_balanced(t)


def replay_ok(s: Column, t: Column) -> Column:
    """Whether a replay pair passes: sound source and target, old register, equal digits, length."""
    s, t = stripped(s, t)
    sound = s.rlike(SCRIPT) & ~s.rlike(X.MOJIBAKE) & X.quotes_balanced(s) & structure_ok(t) & ~t.rlike(S.any_of(S.MODERN))
    return sound & ~_numbers_differ(s, t, NUMBER) & _ratio(s, t, X.dense_length).between(0.25, 4.0)


def gold_reasons(df: DataFrame, order: str, source: str = "source", target: str = "target", status: str = "status", wanted: str = "approved", reason: str = "reason") -> DataFrame:
    """df with the first reason of each row against rows before it: status, missing pair, structure, exact duplicate, conflict.

    Rows before it are those with no fault of their own; order is unique. First places are aggregates that are joined back
    by hash, so a frequent source fills no window partition.
    """
    s, t = stripped(F.col(source), F.col(target))
    own = first_reason([("status", ~F.col(status).eqNullSafe(F.lit(wanted))), ("missing_pair", (s == "") | (t == "")), ("structure", ~structure_ok(t))])
    rows = df.withColumns({"_own": own, "_s": F.sha2(s, 256), "_t": F.sha2(t, 256)})
    sound = rows.where("_own is null")
    pairs = sound.groupBy(F.col("_s").alias("_ps"), F.col("_t").alias("_pt")).agg(F.min(order).alias("_first"))
    firsts = pairs.groupBy(F.col("_ps").alias("_fs")).agg(F.min_by("_pt", "_first").alias("_ft"))
    out = rows.join(pairs, (F.col("_s") == F.col("_ps")) & (F.col("_t") == F.col("_pt")), "left").join(firsts, F.col("_s") == F.col("_fs"), "left")
    rules = [("duplicate", F.col("_first") < F.col(order)), ("conflict", F.col("_ft") != F.col("_t"))]
    return out.withColumn(reason, F.coalesce("_own", first_reason(rules))).drop("_own", "_s", "_t", "_ps", "_pt", "_first", "_fs", "_ft")


def checked_gold(df: DataFrame, order: str, **names: str) -> DataFrame:
    """df if it has rows and none of them a reason of gold_reasons; else ValueError with the first."""
    rows = gold_reasons(df, order, **names)
    bad = rows.where("reason is not null").orderBy(order).select(order, "reason").first()
    if bad or rows.isEmpty():
        raise ValueError(f"row {bad[0]}: {bad[1]}" if bad else "no approved rows")
    return df


def internal_rules(s: Column, t: Column, core: bool = False) -> Rules:
    """All reasons of a prepared row; core keeps only those that break its structure. A missing pair has no other reason."""
    s, t = stripped(s, t)
    missing = (s == "") | (t == "")
    rules = [
        ("source_without_script", ~s.rlike(SCRIPT)), ("script_in_target", t.rlike(SCRIPT)), ("source_quotes", ~X.quotes_balanced(s, QUOTES_FOUR)), ("target_quotes", ~X.quotes_balanced(t, QUOTES_FOUR)),
        ("numbers", _numbers_differ(s, t, NUMBER_PERCENT)), ("length_ratio", ~_ratio(s, t, X.dense_length).between(0.25, 4.0)), ("mojibake", _either(s, t, BROKEN_INTERNAL)), ("placeholder", _either(s, t, SLOT_INTERNAL)),
    ]
    kept = {"script_in_target", "mojibake", "placeholder"} if core else {name for name, _ in rules}
    return [("missing_pair", missing), *((name, ~missing & test) for name, test in rules if name in kept)]


def _lengths(s: Column, t: Column, size: tuple[int, int], ratio: tuple[float, float]) -> Rules:
    return [("source_length", ~F.length(s).between(*size)), ("length_ratio", ~_ratio(s, t).between(*ratio))]


def _scripts(s: Column, t: Column) -> Rules:
    return [("source_without_script", ~s.rlike(SCRIPT)), ("script_leak", t.rlike(SCRIPT))]


def candidate_rules(s: Column, t: Column, blocked: Column) -> Rules:
    """All reasons of a candidate; blocked: whether its source is in a locked set."""
    s, t = stripped(s, t)
    bare = lambda c: F.regexp_replace(F.lower(c), r"(?U)\W", "")
    return [
        *_scripts(s, t), ("mojibake", _either(s, t, BROKEN_CANDIDATE)), ("placeholder", _either(s, t, SLOT_CANDIDATE)), *_lengths(s, t, (8, 500), (0.8, 6.0)),
        ("unbalanced_quotes", _uneven(s, t)), ("numbers", _numbers_differ(s, t, NUMBER_JOINED)), ("source_copy", bare(s) == bare(t)), ("leakage", blocked),
    ]


def pack_rules(s: Column, t: Column, blocked: Column) -> Rules:
    """All reasons of a row of a candidate pack."""
    s, t = stripped(s, t)
    bare = lambda c: F.regexp_replace(c, "[^一-鿿A-Za-z0-9]", "")
    return [
        *_scripts(s, t), ("mojibake", _either(s, t, BROKEN_PACK)), ("placeholder", _either(s, t, SLOT_PACK)), ("advertisement", _either(s, t, ADVERTISEMENT)), *_lengths(s, t, (4, 700), (0.35, 8.0)),
        ("unbalanced_quotes", _uneven(s, t)), ("numbers", _numbers_differ(s, t, NUMBER_JOINED)), ("leakage", blocked), ("source_copy", bare(s) == bare(t)),
    ]


def external_rules(s: Column, t: Column) -> Rules:
    """All flags of a pair from outside."""
    s, t = stripped(s, t)
    share = X.count_matches(s, SCRIPT) / F.greatest(X.dense_length(s), F.lit(1))
    return [
        ("source_length", ~F.length(s).between(8, 500)), ("target_length", ~F.length(t).between(8, 900)), ("source_language", share < 0.35), ("target_language", t.rlike(SCRIPT) | (X.count_matches(t, "[A-Za-zÀ-ỹ]") < 4)),
        ("artifact", _either(s, t, BROKEN_EXTERNAL, SLOT_EXTERNAL)), ("length_ratio", ~_ratio(s, t).between(0.35, 6.0)), ("quotes", _uneven(s, t)), ("numbers", _numbers_differ(s, t, NUMBER_JOINED)),
    ]


def literature_rules(s: Column, t: Column, conflict: Column, tokens: Column | None = None, most: int = 448) -> Rules:
    """A literary pair, first reason. conflict: whether its source has several targets; tokens: length of the source in
    tokens, in characters where none is given."""
    s, t = stripped(s, t)
    size, ratio = _lengths(s, t, (8, 500), (0.8, 6.0))
    return [
        ("conflict", conflict), *_scripts(s, t), ("replacement_or_null", _either(s, t, BROKEN_LITERATURE)), size, ratio, ("too_many_tokens", (F.length(s) if tokens is None else tokens) > most),
        ("unbalanced_quotes", _uneven(s, t)), ("numbers", _numbers_differ(s, t, NUMBER_JOINED)), ("modern_register", t.rlike(MODERN_LITERATURE)),
    ]


def usable(s: Column, t: Column) -> Column:
    """Whether a stored pair is worth a reader's time."""
    s, t = F.coalesce(s, F.lit("")), F.coalesce(t, F.lit(""))
    return F.length(s).between(12, 220) & F.length(t).between(12, 560) & ~_either(s, t, GARBAGE) & X.quotes_balanced(s, QUOTES_FOUR) & _ratio(s, t).between(1.1, 5.2)


def _commas(s: Column) -> Column:
    return X.str_count(s, "，") + X.str_count(s, "、")


def rhythm_wanted(s: Column, t: Column) -> Column:
    """Whether a line is worth a rewrite: a long chain of commas that the target keeps in few sentences."""
    s, t = F.coalesce(s, F.lit("")), F.coalesce(t, F.lit(""))
    scripts = s.rlike(f"[{X.HAN}]") & ~t.rlike(f"[{X.HAN}]")
    return scripts & F.length(s).between(80, 400) & (_commas(s) >= 3) & _ratio(s, t).between(1.5, 4.5) & (X.sentence_ratio(s, t) < 1.4)


def teaches_bad_rhythm(s: Column, t: Column) -> Column:
    s, t = F.coalesce(s, F.lit("")), F.coalesce(t, F.lit(""))
    return (_commas(s) >= 3) & (X.sentence_ratio(s, t) < 1.4)


def chapter_reason(t: Column, most: int = 3) -> Column:
    """First reason against a chapter's whole target, dialogue left out: two ways to name one gender, too many endearments."""
    told = F.regexp_replace(F.coalesce(t, F.lit("")), r"(?s)[“「『\"].*?[”」』\"]", "")
    word = lambda w: rf"(?iU)(?<!\w){w}(?!\w)"
    mixed = [(name, told.rlike(word(old)) & told.rlike(word(new))) for name, old, new in OLD_AND_NEW]
    return first_reason([*mixed, ("endearments", X.count_matches(told, ENDEARMENT) > most)])


def misreadings(s: Column, t: Column) -> Column:
    """Names of known wrong readings in a pair."""
    return F.array_compact(F.array(*(F.when(s.rlike(a) & t.rlike(b), F.lit(name)) for a, b, name in MISREAD)))


def _leak(t: Column, quoted: str, verbs: str, third: str, first: Sequence[str]) -> Column:
    told = F.regexp_replace(F.coalesce(t, F.lit("")), quoted, " ")
    patterns = [rf"(?iU)(?<!của )(?<!cho )\btôi\s+(?:{verbs})\b", rf"(?iU){CLAUSE_HEAD}mình\s+(?:{verbs})\b", rf"(?iU)\b(?:{third})\b", *(rf"(?iU)\b{w}\s+(?:{verbs})\b" for w in first)]
    return told.rlike("|".join(f"(?:{p})" for p in patterns))


def register_leak(t: Column) -> Column:
    """Whether the narration has a modern pronoun as a subject, by the replay's rule."""
    return _leak(t, QUOTED_LINE, VERBS_REPLAY, THIRD_REPLAY, ())


def mined_leak(t: Column) -> Column:
    """The same by the rule that cases are mined with: other verbs and one pronoun more."""
    return _leak(t, S.DIALOGUE, VERBS_MINED, THIRD_MINED, ("cậu",))


def source_key(s: Column) -> Column:
    """A source without white space and marks, for matching."""
    return F.regexp_replace(s, KEY_DROPS, "")


def occurrences(text: Column, value: Column) -> Column:
    """How often a value stands in a text: between other digits it doesn't count; words are case-blind. 0 for an empty value."""
    digits = F.regexp_count(text, F.concat(F.lit(r"(?<!\d)\Q"), value, F.lit(r"\E(?!\d)")))
    low = F.lower(value)
    words = ((F.length(text) - F.length(F.replace(F.lower(text), low, F.lit("")))) / F.length(value)).cast("int")
    return F.when(value == "", 0).when(value.rlike(r"(?U)\d"), digits).otherwise(words)


def looks_western(c: Column, sounds: str, surnames: str) -> Column:
    """Whether a name in source script is a foreign one by sound. sounds: characters that write sounds; surnames: characters
    that open native names. A dotted name needs one of the sounds; others three, three quarters of all, and no surname."""
    c = X.trim_unicode(F.coalesce(c, F.lit("")))
    hits = X.count_matches(c, f"[{sounds}]")
    return F.when(c.rlike("[·•‧・]"), hits >= 1).otherwise((F.length(c) >= 3) & ~c.rlike(f"^[{surnames}]") & (hits >= 3) & (hits / F.greatest(F.length(c), F.lit(1)) >= 0.75))

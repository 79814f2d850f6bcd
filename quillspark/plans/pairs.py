"""Gates of pairs over conversations: a turn is the target of the turn before it, whose vowels become source script; every
twelfth pair or so gets a fault, so that each rule meets rows that break it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import corpus as C
from quillspark.operators import gates as G
from quillspark.operators import pair_gates as P
from quillspark.operators import recipes
from quillspark.plans.registry import Tables, query

TARGETS = {0: " tôi đi", 1: "“", 2: " <x>", 3: " 12.5%", 4: "我", 5: "�", 7: " www.x", 10: " trên thực tế là bản chương chưa hết"}
SOURCES = {10: "求票", 8: " 1:20 ZX123Q", 2: "[UNK]"}
FROM, TO = "aeiou,.", "我他的了是，。"

_t = " ".join(f"when {k} then t || '{v}'" for k, v in TARGETS.items())
_s = " ".join(f"when {k} then z || '{v}'" for k, v in SOURCES.items())
PAIRS = rf"""with raw as (select conv_id, turn, (conv_id * 7 + turn) % 12 as k, text as t, translate(lag(text) over (partition by conv_id order by turn), '{FROM}', '{TO}') as z from conversations),
planted as (select conv_id, turn, case k when 9 then 'abc 12' {_s} else z end as s, case k {_t} when 6 then z when 11 then substr(t, 1, 6) else t end as t from raw where z is not null),
p as (select conv_id, turn, regexp_replace(s, '^\s+|\s+$', '', 'g') as s, regexp_replace(t, '^\s+|\s+$', '', 'g') as t from planted) """


def pairs(t: Tables) -> DataFrame:
    c, k = t.conversations, (F.col("conv_id") * 7 + F.col("turn")) % 12
    raw = c.select("conv_id", "turn", k.alias("k"), F.col("text").alias("t"), F.translate(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), FROM, TO).alias("z")).where("z is not null")
    s = F.when(F.col("k") == 9, "abc 12")
    for n, x in SOURCES.items():
        s = s.when(F.col("k") == n, F.concat("z", F.lit(x)))
    target = F.when(F.col("k") == 6, F.col("z")).when(F.col("k") == 11, F.substring("t", 1, 6))
    for n, x in TARGETS.items():
        target = target.when(F.col("k") == n, F.concat("t", F.lit(x)))
    return raw.select("conv_id", "turn", X.trim_unicode(s.otherwise(F.col("z"))).alias("s"), X.trim_unicode(target.otherwise(F.col("t"))).alias("t"))


def _count(c: str, part: str) -> str:
    return f"(length({c}) - length(replace({c}, '{part}', '')))"


def _uneven(c: str, marks: str) -> str:
    return " or ".join([f"{_count(c, a)} <> {_count(c, b)}" for a, b in zip(marks[::2], marks[1::2], strict=True)] + [f"{_count(c, chr(34))} % 2 = 1"])


def _has(pattern: str, *columns: str) -> str:
    return "(" + " or ".join(f"regexp_matches({c}, '{pattern}')" for c in columns or ("s", "t")) + ")"


def _word(words: str) -> str:
    return rf"(?i)(^|[^\p{{L}}\p{{N}}_])({words})([^\p{{L}}\p{{N}}_]|$)"


def _differ(number: str) -> str:
    return f"regexp_extract_all(s, '{number}') <> regexp_extract_all(t, '{number}')"


def _first(rules: dict[str, str]) -> str:
    return "case " + " ".join(f"when {test} then '{name}'" for name, test in rules.items()) + " end"


def _all(rules: dict[str, str]) -> str:
    return "list_sort(list_filter([" + ", ".join(f"case when {test} then '{name}' end" for name, test in rules.items()) + "], lambda x: x is not null))"


HAN, THREE, FOUR = "[㐀-鿿]", "“”「」『』", "“”‘’「」『』"
NO_SCRIPT, LEAK = f"not {_has(HAN, 's')}", _has(HAN, "t")
DENSE = r"(length(regexp_replace(t, '\s+', '', 'g')) / greatest(length(regexp_replace(s, '\s+', '', 'g')), 1))"
RATIO = "(length(t) / greatest(length(s), 1))"
JOINED = r"\d+(?:[.:/]\d+)*"
MODERN = "tôi|mình|bạn|cậu|cháu|anh ta|cô ta|cô ấy|cậu ta|ông ta|bà ta"
SLOTS = r"(?i)\[/?(?:ZH|VI|UNK|MASK)\]|<[^>]+>|\{\{.+?\}\}"
BLOCKED = "s in (select s from p where conv_id % 10 = 0)"


def gate(rules: str, name: str):
    return query(f"{PAIRS} select conv_id, turn, {rules} as verdict from p", name=name)


@gate(_first({
    "empty_or_other_script": f"t = '' or {NO_SCRIPT}", "script_leak": LEAK, "mojibake": _has("�|Ã.|Â.|â€"), "unbalanced_quotes": f"{_uneven('s', FOUR)} or {_uneven('t', FOUR)}", "modern_register": _has(_word(MODERN), "t"),
    "author_note": _has("(?i)tác giả có lời|lời tác giả|bản chương chưa hết|xin hãy chờ|作者有话说|本章未完|求票|求收藏|求推荐|求月票|感谢支持"), "placeholder": _has(r"<[^>]{1,40}>|\{\{[^}]{1,40}\}\}|\[\[.*?\]\]"),
    "pinyin_in_source": _has("(?i)(^|[^a-z])[a-z]{1,8}[āáǎàēéěèīíǐìōóǒòūúǔùǖǘǚǜ][a-z]{0,8}([^a-z]|$)", "s") + " or " + _has("(?i)[㐀-鿿](?:jing|xing|se|she|rou|jiao)[㐀-鿿]", "s"),
    "numbers": _differ(r"\d+"), "length_ratio": f"{DENSE} not between 0.25 and 4",
}), "gate_teacher_line")
def gate_teacher_line(t: Tables) -> DataFrame:
    """First reason against each pair by the rules of teacher lines."""
    return pairs(t).select("conv_id", "turn", G.first_reason(P.teacher_line_rules(F.col("s"), F.col("t"))).alias("verdict"))


REPLAY_SQL = f"""{_has(HAN, "s")} and not {_has("�|Ã|Â[[:space:]\"''.,;:!?]|â(?:€|™|œ|ž)|Ä(?:‘|’)")} and not ({_uneven("s", THREE)} or {_uneven("t", THREE)}) and not {LEAK} and not {_has(_word(MODERN), "t")} and not {_differ("[0-9]+")} and {DENSE} between 0.25 and 4"""


@gate(REPLAY_SQL, "gate_replay")
def gate_replay(t: Tables) -> DataFrame:
    """Whether each pair may be replayed."""
    return pairs(t).select("conv_id", "turn", P.replay_ok(F.col("s"), F.col("t")).alias("verdict"))


INTERNAL = {
    "source_without_script": NO_SCRIPT, "script_in_target": LEAK, "source_quotes": _uneven("s", FOUR), "target_quotes": _uneven("t", FOUR), "numbers": _differ(r"\d+(?:\.\d+)?%?"), "length_ratio": f"{DENSE} not between 0.25 and 4",
    "mojibake": _has("�|Ãƒ"), "placeholder": _has(r"ZX\d{3}Q|⟦\d{3}⟧|(^|[^A-Za-z])[JWZF]{2,4}([^A-Za-z]|$)"),
}


@query(f"""{PAIRS} select conv_id, turn, case when s = '' or t = '' then ['missing_pair'] else {_all(INTERNAL)} end as verdict,
case when s = '' or t = '' then ['missing_pair'] else {_all({k: v for k, v in INTERNAL.items() if k in ("script_in_target", "mojibake", "placeholder")})} end as core from p""")
def gate_internal(t: Tables) -> DataFrame:
    """All reasons, and those that break a row's structure."""
    s, x = F.col("s"), F.col("t")
    return pairs(t).select("conv_id", "turn", G.all_reasons(P.internal_rules(s, x)).alias("verdict"), G.all_reasons(P.internal_rules(s, x, core=True)).alias("core"))


def _with_blocked(p: DataFrame) -> DataFrame:
    h = F.sha2("s", 256)
    locked = p.where("conv_id % 10 = 0").select(h.alias("h")).distinct().withColumn("blocked", F.lit(True))
    return p.join(locked, h == F.col("h"), "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))


@gate(_all({
    "source_without_script": NO_SCRIPT, "script_leak": LEAK, "mojibake": _has(r"�|\?{2,}|Ã.|Â."), "placeholder": _has(SLOTS), "source_length": "length(s) not between 8 and 500", "length_ratio": f"{RATIO} not between 0.8 and 6",
    "unbalanced_quotes": f"{_uneven('s', THREE)} or {_uneven('t', THREE)}", "numbers": _differ(JOINED), "source_copy": r"regexp_replace(lower(s), '[^\p{L}\p{N}_]', '', 'g') = regexp_replace(lower(t), '[^\p{L}\p{N}_]', '', 'g')", "leakage": BLOCKED,
}), "gate_candidate_v0")
def gate_candidate_v0(t: Tables) -> DataFrame:
    """All reasons against candidates; sources of every tenth conversation are locked."""
    return _with_blocked(pairs(t)).select("conv_id", "turn", G.all_reasons(P.candidate_rules(F.col("s"), F.col("t"), F.col("blocked"))).alias("verdict"))


@gate(_all({
    "source_without_script": NO_SCRIPT, "script_leak": LEAK, "mojibake": _has("Ã.|Â.|â€|�"), "placeholder": _has(r"\*{2,}") + " or " + _has(SLOTS), "advertisement": _has(r"(?i)求票|求收藏|求推荐|求月票|作者的话|感谢支持|请投票|PS：|P\.S\."),
    "source_length": "length(s) not between 4 and 700", "length_ratio": f"{RATIO} not between 0.35 and 8", "unbalanced_quotes": f"{_uneven('s', THREE)} or {_uneven('t', THREE)}", "numbers": _differ(JOINED), "leakage": BLOCKED,
    "source_copy": "regexp_replace(s, '[^一-鿿A-Za-z0-9]', '', 'g') = regexp_replace(t, '[^一-鿿A-Za-z0-9]', '', 'g')",
}), "gate_candidate_pack")
def gate_candidate_pack(t: Tables) -> DataFrame:
    """All reasons against rows of a pack."""
    return _with_blocked(pairs(t)).select("conv_id", "turn", G.all_reasons(P.pack_rules(F.col("s"), F.col("t"), F.col("blocked"))).alias("verdict"))


@gate(_all({
    "source_length": "length(s) not between 8 and 500", "target_length": "length(t) not between 8 and 900", "source_language": rf"len(regexp_extract_all(s, '{HAN}')) / greatest(length(regexp_replace(s, '\s', '', 'g')), 1) < 0.35",
    "target_language": f"{LEAK} or len(regexp_extract_all(t, '[A-Za-zÀ-ỹ]')) < 4", "artifact": _has(r"(?i)�|https?://|www\.") + " or " + _has(r"(?i)(?:^|\s)(?:\*{2,}|\[\s*ads?\s*\])(?:\s|$)"), "length_ratio": f"{RATIO} not between 0.35 and 6",
    "quotes": f"{_uneven('s', THREE)} or {_uneven('t', THREE)}", "numbers": _differ(JOINED),
}), "gate_external")
def gate_external(t: Tables) -> DataFrame:
    """All flags of pairs from outside."""
    return pairs(t).select("conv_id", "turn", G.all_reasons(P.external_rules(F.col("s"), F.col("t"))).alias("verdict"))


@gate(_first({
    "conflict": "s in (select s from p group by s having count(distinct t) > 1)", "source_without_script": NO_SCRIPT, "script_leak": LEAK, "replacement_or_null": _has("�"), "source_length": "length(s) not between 8 and 500",
    "length_ratio": f"{RATIO} not between 0.8 and 6", "too_many_tokens": "length(s) > 448", "unbalanced_quotes": f"{_uneven('s', THREE)} or {_uneven('t', THREE)}", "numbers": _differ(JOINED),
    "modern_register": _has(_word("tôi|anh|em|cậu|bạn|mình|anh ấy|cô ấy|cậu ấy"), "t"),
}), "gate_literature")
def gate_literature(t: Tables) -> DataFrame:
    """First reason against literary pairs."""
    p, h = pairs(t), F.sha2("s", 256)
    several = p.groupBy(h.alias("h")).agg(F.countDistinct(F.sha2("t", 256)).alias("n")).where("n > 1").select("h")
    marked = p.join(several, h == F.col("h"), "left")
    return marked.select("conv_id", "turn", G.first_reason(P.literature_rules(F.col("s"), F.col("t"), F.col("h").isNotNull())).alias("verdict"))


SENTENCES = r"(case when t = '' then 0 else 1 + len(regexp_extract_all(t, '[.!?…]\s+')) end / greatest(" + " + ".join(_count("s", c) for c in "。！？") + ", 1))"
CHAIN = f"({_count('s', '，')} + {_count('s', '、')} >= 3)"


@query(f"""{PAIRS} select conv_id, turn, length(s) between 12 and 220 and length(t) between 12 and 560 and not {_has("(?i)作者|本章完|求收藏|求推荐|求月票|QQ群|公众号|微信|http|www[.]|不jing")} and not ({_uneven("s", FOUR)}) and {RATIO} between 1.1 and 5.2 as worth,
{_has("[一-鿿]", "s")} and not {_has("[一-鿿]", "t")} and length(s) between 80 and 400 and {CHAIN} and {RATIO} between 1.5 and 4.5 and {SENTENCES} < 1.4 as wanted, {CHAIN} and {SENTENCES} < 1.4 as bad from p""")
def gate_rhythm_pool(t: Tables) -> DataFrame:
    """Pairs worth reading, worth a rewrite, and those that teach a bad rhythm."""
    s, x = F.col("s"), F.col("t")
    return pairs(t).select("conv_id", "turn", P.usable(s, x).alias("worth"), P.rhythm_wanted(s, x).alias("wanted"), P.teaches_bad_rhythm(s, x).alias("bad"))


GOLD = f"""{PAIRS}, twice as (select conv_id * 1000 + turn as ord, s, t, case when turn % 5 = 4 then 'draft' else 'approved' end as status from p union all select 1000000000 + conv_id * 1000 + turn, s, t, 'approved' from p where conv_id % 9 = 0),
own as (select *, case when status <> 'approved' then 'status' when s = '' or t = '' then 'missing_pair' when {LEAK} or {_has("�|Ã|Â[[:space:]\"''.,;:!?]", "t")} or {_uneven("t", THREE)} then 'structure' end as o from twice),
firsts as (select s as fs, arg_min(t, ord) as ft from own where o is null group by 1), seen as (select s as ps, t as pt, min(ord) as first from own where o is null group by 1, 2)
select ord, coalesce(o, case when first < ord then 'duplicate' when ft <> t then 'conflict' end) as reason from own left join seen on s = ps and t = pt left join firsts on s = fs"""


@query(GOLD)
def gate_gold(t: Tables) -> DataFrame:
    """First reason against approved rows, duplicates and conflicts included."""
    p = pairs(t)
    ord_ = (F.col("conv_id") * 1000 + F.col("turn")).alias("ord")
    first = p.select(ord_, "s", "t", F.when(F.col("turn") % 5 == 4, "draft").otherwise("approved").alias("status"))
    again = p.where("conv_id % 9 = 0").select((F.lit(1000000000) + ord_).alias("ord"), "s", "t", F.lit("approved").alias("status"))
    return P.gold_reasons(first.unionByName(again), "ord", "s", "t").select("ord", "reason")


CHAPTERS = r"""with c as (select conv_id, regexp_replace(string_agg(text, chr(10) order by turn) || (['', ' nàng nói cô ấy', ' hắn và anh ta', ' anh em anh em', ' “nàng” cô ta', ' anh trai em gái anh em'])[conv_id % 6 + 1], '[“「『"][^”」』"]*[”」』"]', '', 'g') as t from conversations group by conv_id),
x as (select *, regexp_replace(t, '[À-ỹ]', 'x', 'g') as a from c) """


@query(f"""{CHAPTERS} select conv_id, case when {_has(_word("nàng"), "t")} and {_has(_word("cô (?:ta|ấy)"), "t")} then 'conflict_female' when {_has(_word("hắn"), "t")} and {_has(_word("anh (?:ta|ấy)"), "t")} then 'conflict_male'
when len(regexp_extract_all(a, '(?i)\\b(?:anh|em)\\b')) - len(regexp_extract_all(a, '(?i)\\b(?:anh|em)\\s+(?:trai|gxi|xy|hx|ta\\b)')) > 3 then 'endearments' end as reason from x""")
def gate_chapter_anchor(t: Tables) -> DataFrame:
    """First reason against whole chapters."""
    extra = F.element_at(F.array(*map(F.lit, ("", " nàng nói cô ấy", " hắn và anh ta", " anh em anh em", " “nàng” cô ta", " anh trai em gái anh em"))), (F.col("conv_id") % 6 + 1).cast("int"))
    text = F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]))
    return t.conversations.groupBy("conv_id").agg(text.alias("t")).select("conv_id", P.chapter_reason(F.concat("t", extra)).alias("reason"))


@query(f"""{PAIRS}, kept as (select *, row_number() over (partition by s order by conv_id, turn) as rn from p where conv_id in (select conv_id from ({CHAPTERS.replace("with c as", "with c as")} select conv_id from x where not ({_has(_word("nàng"), "t")} and {_has(_word("cô (?:ta|ấy)"), "t")})
and not ({_has(_word("hắn"), "t")} and {_has(_word("anh (?:ta|ấy)"), "t")}) and len(regexp_extract_all(a, '(?i)\\b(?:anh|em)\\b')) - len(regexp_extract_all(a, '(?i)\\b(?:anh|em)\\s+(?:trai|gxi|xy|hx|ta\\b)')) <= 3)) and {REPLAY_SQL})
select conv_id, turn, length(s) as n from kept where rn = 1""")
def anchor_build(t: Tables) -> DataFrame:
    """Lines of sound chapters that may be replayed, one a source."""
    lines = pairs(t).withColumn("ord", F.struct("conv_id", "turn"))
    return recipes.anchor_lines(lines, gate_chapter_anchor(t).where("reason is null").select("conv_id"), ["conv_id"], "ord", "s", "t").select("conv_id", "turn", F.length("s").alias("n"))


@query(r"""select doc_id, md5(regexp_replace(text, '[\s"“”‘’''，。！？、：；,.!?…]', '', 'g')) as key_md5 from documents where text is not null""")
def source_key(t: Tables) -> DataFrame:
    """Keys of texts without white space and marks."""
    return t.documents.where("text is not null").select("doc_id", F.md5(P.source_key(F.col("text"))).alias("key_md5"))


@query(r"""select p_partkey, p_size, ((length(lower(c)) - length(replace(lower(c), 'st', ''))) / 2)::int as words, len(regexp_extract_all(c, '(^|[^0-9])' || p_size || '([^0-9]|$)'))::int as numbers from (select p_partkey, p_size, p_type || ' ' || p_brand || ' ' || p_name || ' /' || p_size || ' //' || p_size || '0 ' as c from part)""")
def count_correct(t: Tables) -> DataFrame:
    """Occurrences of a word and of a number that stands alone."""
    c = F.concat_ws("", "p_type", F.lit(" "), "p_brand", F.lit(" "), "p_name", F.lit(" /"), "p_size", F.lit(" //"), "p_size", F.lit("0 "))
    return t.part.select("p_partkey", "p_size", P.occurrences(c, F.lit("ST")).alias("words"), P.occurrences(c, F.col("p_size").cast("string")).alias("numbers"))


@query("""with s as (select conv_id, turn, length(text) / 2000.0 as score from conversations where text is not null) select conv_id, turn from s where score >= 0.6 order by score desc, conv_id, turn limit 50""")
def screen_by_model(t: Tables) -> DataFrame:
    """The best 50 rows by a score of 0.6 or more."""
    s = t.conversations.where("text is not null").select("conv_id", "turn", (F.length("text") / 2000.0).alias("score"))
    return recipes.best_scored(s, "score", 0.6, 50, ["conv_id", "turn"])[0].select("conv_id", "turn")


@query("""with b as (select distinct l_partkey from lineitem where l_quantity > 48), k as (select p_partkey, row_number() over (order by sha256('anchor' || chr(0) || p_partkey), p_partkey) as rn from part where p_partkey not in (select l_partkey from b)) select p_partkey from k where rn <= 40""")
def anchor_sample(t: Tables) -> DataFrame:
    """40 rows by hash of those that no other shard holds."""
    taken = t.lineitem.where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    return recipes.sample_free(t.part, taken, "p_partkey", 40, "anchor").select("p_partkey")


@query("""with j as (select o_orderkey as id, o_custkey as chapter_id, case o_orderstatus when 'O' then 'pending' when 'F' then 'done' else 'running' end as status from orders), c as (select c_custkey as chapter_id, c_nationkey as novel_id, c_acctbal > 5000 as has from customer)
select id, case when status = 'pending' and not has and n_regionkey = 1 then 'failed' else status end as status from j join c using (chapter_id) join nation on n_nationkey = novel_id""")
def fail_unfetchable(t: Tables) -> DataFrame:
    """Pending jobs fail where neither the chapter's text nor its source is there."""
    from quillspark.operators import queue as Q

    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "done").otherwise("running")
    jobs = t.orders.select(F.col("o_orderkey").alias("id"), F.lit("chapter").alias("type"), F.col("o_custkey").alias("chapter_id"), status.alias("status"), F.lit(None).cast("string").alias("error"))
    chapters = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("novel_id"), F.when(F.col("c_acctbal") > 5000, "x").alias("content"))
    novels = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("source_id"))
    return Q.unfetchable_failed(jobs, chapters, novels, t.region.select(F.col("r_regionkey").alias("id"), (F.col("r_regionkey") != 1).alias("enabled"))).select("id", "status")


@query("""with j as (select o_orderkey as id, o_custkey as chapter_id, o_orderstatus as status, o_orderpriority as worker from orders), r as (select l_orderkey as id, min(l_suppkey) as chapter_id from lineitem where l_linenumber = 1 group by 1),
ok as (select distinct j.chapter_id from j join r using (id) where status = 'P' and worker like '1%') select c_nationkey as novel_id, count(*) as first_translations from ok join customer on c_custkey = chapter_id where c_acctbal > 0 group by 1""")
def finalize_job(t: Tables) -> DataFrame:
    """Chapters that a finished job translates for the first time, by novel; results of jobs that another worker holds don't count."""
    from quillspark.operators import queue as Q

    jobs = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("chapter_id"), F.when(F.col("o_orderstatus") == "P", "running").otherwise("done").alias("status"), F.substring("o_orderpriority", 1, 1).alias("locked_by"))
    chapters = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("novel_id"), F.when(F.col("c_acctbal") <= 0, "old").alias("content_out"))
    has_line = t.lineitem.where("l_linenumber = 1").select(F.col("l_orderkey").alias("job_id")).distinct()
    results = has_line.join(jobs.select(F.col("id").alias("job_id"), "chapter_id"), "job_id").select("job_id", F.lit("1").alias("worker"), "chapter_id", F.lit("new").alias("content_out"))
    return Q.finalized(jobs, chapters, results)["novels"]


@query()
def greedy_cover_spaced(t: Tables) -> DataFrame:
    """Lines of each source that add most kinds of text, no two near each other in one document."""
    lines = C.line_table(t.documents, "doc_id", "text", "source").where("line <> ''")
    line = F.col("line")
    tags = F.array_compact(F.array(F.when(line.rlike("[0-9]"), "number"), F.when(line.rlike("[#$%&|]"), "symbol"), F.when(F.length(line) > 200, "long"), F.when(X.str_count(line, ",") >= 3, "chain"), F.when(line.rlike("http|@"), "link")))
    return C.greedy_cover_spaced(lines.select("source", "doc_id", "pos", tags.alias("tags")).where("size(tags) > 0"), "source", "doc_id", "pos", "tags", 6)

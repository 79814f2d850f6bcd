"""Corpus gates, dedup, leakage, sampling and mixing over documents, their lines, labels, the benchmark and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import corpus as C
from quillspark.operators import frames as R
from quillspark.operators import gates as G
from quillspark.plans.registry import Tables, query

LINES = "lines as (select doc_id, source, lang, u.pos - 1 as pos, u.line as line from (select doc_id, source, lang, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'pos': i, 'line': x})) as u from documents))"
INTRINSIC = "case when regexp_matches(line, '[#$%&|]') then 'junk' when length(line) < 20 then 'too_short' when length(line) >= 40 and not (length(line) * 1.0 / (1 + length(line) - length(replace(line, ' ', ''))) between 3.0 and 9.0) then 'length_ratio' end"
GATED = f"""with {LINES}, g as (select *, doc_id::hugeint * 10000000000 + pos as ord, trim(line) = '' as missing, {INTRINSIC} as intrinsic from lines),
f as (select line as k, min(ord) as first_ok from g where intrinsic is null and not missing group by 1),
r as (select g.*, case when missing then 'missing' when first_ok < ord then 'duplicate' else intrinsic end as reason from g left join f on line = k)"""


def gated(t: Tables) -> DataFrame:
    """Lines with their first reason; a line is a duplicate once it was accepted."""
    rows = C.line_table(t.documents, "doc_id", "text", "source", "lang").withColumn("ord", F.col("doc_id").cast("decimal(20,0)") * F.lit(10_000_000_000).cast("decimal(12,0)") + F.col("pos"))
    line = F.col("line")
    words = 1 + F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))
    rules = [("junk", line.rlike("[#$%&|]")), ("too_short", F.length(line) < 20), ("length_ratio", (F.length(line) >= 40) & ~(F.length(line) * 1.0 / words).between(3.0, 9.0))]
    return G.with_seen(rows, "line", "ord", F.trim("line") == "", G.first_reason(rules))


@query(GATED + " select reason, count(*) as n from r where reason is not null group by 1")
def corpus_gate_reasons(t: Tables) -> DataFrame:
    """Histogram of the reasons lines are rejected for."""
    return G.reason_counts(gated(t))


@query(GATED + " select doc_id, pos, length(line) as n_chars from r where reason is null")
def corpus_gate_approved(t: Tables) -> DataFrame:
    """Lines that pass."""
    return G.split(gated(t))[0].select("doc_id", "pos", F.length("line").alias("n_chars"))


@query("""select doc_id, list_sort(list_filter([case when n_chars < 200 then 'short' end, case when regexp_matches(text, '[#$%&|]') then 'symbols' end, case when upper(text) = text then 'shouting' end,
case when contains(text, 'http') then 'link' end, case when lang is distinct from 'en' then 'foreign' end], lambda x: x is not null)) as reasons from documents""")
def gate_multi_reasons(t: Tables) -> DataFrame:
    """All reasons of every document."""
    x = F.col("text")
    rules = [("short", F.col("n_chars") < 200), ("symbols", x.rlike("[#$%&|]")), ("shouting", F.upper(x) == x), ("link", F.contains(x, F.lit("http"))), ("foreign", ~F.col("lang").eqNullSafe(F.lit("en")))]
    return t.documents.select("doc_id", G.all_reasons(rules).alias("reasons"))


TAGS_SQL = """list_filter([case when contains(text, '"') then 'dialogue' else 'narration' end, case when length(text) - length(replace(text, ',', '')) >= 3 then 'comma_chain' end,
case when regexp_matches(text, '[0-9]') then 'number' end, case when length(text) > 1200 then 'long' end, case when regexp_matches(text, '^(The|In|Of|La|Le|Die|Der|El)[ ,.]') then 'pronoun' end], lambda x: x is not null)"""


def _tags():
    x = F.col("text")
    return F.array_compact(F.array(F.when(F.contains(x, F.lit('"')), "dialogue").otherwise("narration"), F.when(X.str_count(x, ",") >= 3, "comma_chain"), F.when(x.rlike("[0-9]"), "number"), F.when(F.length(x) > 1200, "long"), F.when(x.rlike(r"^(The|In|Of|La|Le|Die|Der|El)[ ,.]"), "pronoun")))


@query(f"""select tag, count(*) as n, round(count(*) * 1.0 / (select count(*) from documents), 9) as share, count(*) * 1.0 / (select count(*) from documents) < 0.05 as too_rare from (select unnest({TAGS_SQL}) as tag from documents) group by 1""")
def sentence_type_share(t: Tables) -> DataFrame:
    """Share of each type of text, the rare ones flagged."""
    return G.tag_shares(t.documents, _tags()).withColumn("share", F.round("share", 9))


@query("""select round(avg((quality = 1)::int), 9) as human_share, avg((quality = 1)::int) >= 0.2 as human_ok, (select count(*) from (select source from documents join labels using (doc_id) group by 1 having sum(toxic) > 0 and sum(1 - toxic) > 0 and least(sum(toxic), sum(1 - toxic)) * 1.0 / greatest(sum(toxic), sum(1 - toxic)) >= 0.2)) as n_conflict_groups from labels""")
def batch_gate_shares(t: Tables) -> DataFrame:
    """Batch gates: share of approved rows, and groups in conflict."""
    d = t.documents.join(t.labels, "doc_id").select("source", F.col("toxic").cast("long").alias("a"), (1 - F.col("toxic")).cast("long").alias("b"))
    n = G.conflict_groups(d, ["source"], ("a", "b")).where("conflict").agg(F.count(F.lit(1))).scalar()
    share = F.avg((F.col("quality") == 1).cast("int"))
    return t.labels.agg(F.round(share, 9).alias("human_share"), (share >= 0.2).alias("human_ok")).select("*", n.alias("n_conflict_groups"))


@query("with s as (select lang, list_sort(list(n_chars)) as v, count(*) as n from documents group by 1) select lang, v[least(n - 1, floor(0.01 * n)::bigint) + 1] as p01, v[least(n - 1, floor(0.5 * n)::bigint) + 1] as p50, v[least(n - 1, floor(0.99 * n)::bigint) + 1] as p99 from s")
def percentile_idx(t: Tables) -> DataFrame:
    """Percentiles by index."""
    return R.index_percentiles(t.documents, ["lang"], "n_chars", {"p01": 0.01, "p50": 0.5, "p99": 0.99})


@query("""select a.vec_id as a, b.vec_id as b, round(list_inner_product(a.embedding::double[], b.embedding::double[]) / sqrt(list_inner_product(a.embedding::double[], a.embedding::double[]) * list_inner_product(b.embedding::double[], b.embedding::double[])), 6) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def labse_cosine_pairs(t: Tables) -> DataFrame:
    """Cosine of aligned pairs: each vector and its neighbour."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    a = t.embeddings.select(F.col("vec_id").alias("a"), v.alias("x"), (F.col("vec_id") + 1).alias("b"))
    b = t.embeddings.select(F.col("vec_id").alias("b"), v.alias("y"))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda i, j: i * j), F.lit(0.0), lambda s, i: s + i)
    return a.join(b, "b").select("a", "b", F.round(dot("x", "y") / F.sqrt(dot("x", "x") * dot("y", "y")), 6).alias("cosine"))


@query("with s as (select vec_id, round(embedding[1]::double, 6) as score from embeddings) select vec_id, score from s where score >= 0.05")
def labse_filter(t: Tables) -> DataFrame:
    """Pairs at or above the least score."""
    return t.embeddings.select("vec_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("score")).where("score >= 0.05")


@query("select vec_id, round(embedding[1]::double, 6) as score from embeddings order by embedding[1], vec_id limit 15")
def win_bottom_k(t: Tables) -> DataFrame:
    """The 15 lowest scores, for reading."""
    first = F.get("embedding", F.lit(0))
    return t.embeddings.select("vec_id", first.alias("raw")).orderBy("raw", "vec_id").limit(15).select("vec_id", F.round(F.col("raw").cast("double"), 6).alias("score"))


@query("select doc_id, sha256(trim(text)) as source_hash, sha256(trim(text) || chr(1) || lang) as pair_hash, substr(sha256(doc_id || chr(1) || source || chr(1) || lang || chr(1) || n_chars), 1, 20) as stable_id from documents", name="source_hash")
def source_hash(t: Tables) -> DataFrame:
    """Hashes of texts, of pairs and of row identities."""
    s, sep = F.trim("text"), F.lit("\1")
    return t.documents.select("doc_id", F.sha2(s, 256).alias("source_hash"), F.sha2(F.concat(s, sep, "lang"), 256).alias("pair_hash"), F.substring(F.sha2(F.concat_ws("\1", F.col("doc_id").cast("string"), "source", "lang", F.col("n_chars").cast("string")), 256), 1, 20).alias("stable_id"))


@query("select doc_id, case when source is null then 'unassigned' when ('0x' || substr(sha256(source), 1, 8))::bigint % 10 = 0 then 'holdout' else 'pilot' end as split, ('0x' || substr(sha256(text), 1, 4))::bigint % 7 = 0 as sampled from documents")
def group_split(t: Tables) -> DataFrame:
    """Split by group hash and sample by text hash, both reproducible."""
    split = F.when(F.col("source").isNull(), "unassigned").when(R.bucket_of_hash(F.sha2("source", 256), 8, 10) == 0, "holdout").otherwise("pilot")
    return t.documents.select("doc_id", split.alias("split"), (R.bucket_of_hash(F.sha2("text", 256), 4, 7) == 0).alias("sampled"))


@query("select doc_id, sha256('pool' || chr(1) || text) as h from documents order by h, doc_id limit 100")
def hash_sample_topn(t: Tables) -> DataFrame:
    """A reproducible sample of 100: the first by salted hash."""
    return t.documents.select("doc_id", F.sha2(F.concat(F.lit("pool\1"), "text"), 256).alias("h")).orderBy("h", "doc_id").limit(100)


@query("select doc_id, lang, case when quality = 1 then 0 else 1 end as tier, sha256(text) as h from documents join labels using (doc_id) order by tier, h, doc_id limit 150")
def sort_tier_hash(t: Tables) -> DataFrame:
    """The best tier first, then by hash; 150 rows."""
    tier = F.when(F.col("quality") == 1, 0).otherwise(1)
    return t.documents.join(t.labels, "doc_id").select("doc_id", "lang", tier.alias("tier"), F.sha2("text", 256).alias("h")).orderBy("tier", "h", "doc_id").limit(150)


@query(f"with {LINES}, b as (select distinct sha256(trim(u)) as h from (select unnest(string_split(text, chr(10))) as u from benchmark) where trim(u) <> '') select doc_id, pos from lines where sha256(trim(line)) in (select h from b)")
def leak_semi_lines(t: Tables) -> DataFrame:
    """Lines that occur in the locked evaluation set."""
    locked = C.line_table(t.benchmark, "item_id").where(F.trim("line") != "").select(F.sha2(F.trim("line"), 256).alias("h"))
    rows = C.line_table(t.documents).withColumn("h", F.sha2(F.trim("line"), 256))
    return C.leaking(rows, locked).select("doc_id", "pos")


@query("select distinct sha256(trim(u)) as h from (select unnest(list_concat([text], list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))) as u from benchmark)")
def leak_blocked_set(t: Tables) -> DataFrame:
    """Hashes of locked texts and of each of their lines."""
    return C.blocked_hashes(t.benchmark)


@query("with r as (select doc_id, text, row_number() over (partition by md5(text) order by doc_id) as rn from documents) select doc_id, length(text) as n from r where rn = 1")
def dedup_first(t: Tables) -> DataFrame:
    """First of equal texts."""
    return R.first_by(t.documents.withColumn("k", F.md5("text")), ["k"], [F.col("doc_id")]).select("doc_id", F.length("text").alias("n"))


@query(f"with {LINES}, m as (select doc_id, line, max(pos) as last_pos from lines group by 1, 2) select doc_id, last_pos, row_number() over (partition by doc_id order by last_pos) as nth, length(line) as n from m where trim(line) <> ''")
def dedup_keep_last(t: Tables) -> DataFrame:
    """Lines of a text once each, at their last place, renumbered."""
    m = C.line_table(t.documents).where(F.trim("line") != "").groupBy("doc_id", "line").agg(F.max("pos").alias("last_pos"))
    return R.numbered(m, ["doc_id"], [F.col("last_pos")], "nth").select("doc_id", "last_pos", "nth", F.length("line").alias("n"))


@query("with k as (select text as k, * from documents), s as (select k from k group by 1 having count(distinct lang || source) = 1) select doc_id from k where k in (select k from s)")
def conflict_drop(t: Tables) -> DataFrame:
    """Rows whose key has one value only."""
    d = t.documents.select("doc_id", F.col("text").alias("k"), F.concat("lang", "source").alias("v"))
    return R.drop_conflicts(d, "k", "v").select("doc_id")


@query("select text as k, count(distinct lang || source) as n_values from documents group by 1 having count(distinct lang || source) > 1")
def agg_conflicts(t: Tables) -> DataFrame:
    """Keys with several values."""
    return R.conflicts(t.documents.select(F.col("text").alias("k"), F.concat("lang", "source").alias("v")), "k", "v")


@query(f"with {LINES}, c as (select line, count(*) as n from lines group by 1) select sum(n)::bigint as n_rows, count(*) as n_unique, sum(n - 1)::bigint as n_extra from c")
def dup_counts(t: Tables) -> DataFrame:
    """Rows, unique lines and extra copies."""
    return R.dup_counts(C.line_table(t.documents), ["line"])


@query(f"with {LINES}, a as (select distinct line from lines where source = 'src0'), b as (select line, count(*) as n from lines where source = 'src1' group by 1) select count(*) as n_shared, coalesce(sum(n), 0)::bigint as weight from b where line in (select line from a)")
def agg_overlap_weight(t: Tables) -> DataFrame:
    """Unique lines of one source found in another, and how often."""
    rows = C.line_table(t.documents, "doc_id", "text", "source")
    b = rows.where("source = 'src1'").groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    return b.join(rows.where("source = 'src0'"), "line", "left_semi").agg(F.count(F.lit(1)).alias("n_shared"), F.coalesce(F.sum("n"), F.lit(0)).alias("weight"))


@query("select w, n_forms from (select lower(x) as w, count(distinct x) as n_forms from (select unnest(string_split_regex(text, '[^A-Za-z]+')) as x from documents) where x <> '' group by 1) where n_forms > 1")
def agg_case_variants(t: Tables) -> DataFrame:
    """Words written in several ways."""
    w = t.documents.select(F.explode(F.split("text", "[^A-Za-z]+")).alias("x")).where("x <> ''").distinct()
    return w.groupBy(F.lower("x").alias("w")).agg(F.count(F.lit(1)).alias("n_forms")).where("n_forms > 1")


@query("select source, coalesce(quality::varchar, 'unknown') as status, count(*) as n from documents left join labels using (doc_id) group by 1, 2")
def agg_source_status(t: Tables) -> DataFrame:
    """Rows by source and status."""
    return t.documents.join(t.labels, "doc_id", "left").groupBy("source", F.coalesce(F.col("quality").cast("string"), F.lit("unknown")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("""with w as (select conv_id, turn, text, list(case when trim(text) <> '' then text end) over (partition by conv_id order by turn rows between 2 preceding and 1 preceding) as c from conversations)
select conv_id, turn, md5(coalesce(array_to_string(list_filter(c, lambda x: x is not null), chr(10)), '')) as context_md5, coalesce(len(list_filter(c, lambda x: x is not null)), 0)::int as context_len from w where trim(text) <> ''""")
def context_prev_k(t: Tables) -> DataFrame:
    """Each turn with the texts of the two before."""
    return R.context_before(t.conversations, ["conv_id"], "turn", "text", 2).select("conv_id", "turn", F.md5("context").alias("context_md5"), "context_len")


@query(f"with {LINES} select doc_id, pos, md5(array_to_string(list(line) over (partition by doc_id order by pos rows between 1 preceding and 1 following), chr(10))) as excerpt_md5 from lines where trim(line) <> ''")
def context_pm1(t: Tables) -> DataFrame:
    """Each line with its neighbours."""
    rows = C.line_table(t.documents).where(F.trim("line") != "")
    around = F.collect_list("line").over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(-1, 1))
    return rows.select("doc_id", "pos", F.md5(F.array_join(around, "\n")).alias("excerpt_md5"))


@query("with r as (select doc_id, source, row_number() over (partition by source order by sha256(text), doc_id) as rn from documents) select doc_id, source from r where rn <= 30")
def per_group_cap(t: Tables) -> DataFrame:
    """At most 30 of each source."""
    return R.top_per_group(t.documents.select("doc_id", "source", F.sha2("text", 256).alias("h")), ["source"], [F.col("h"), F.col("doc_id")], 30).select("doc_id", "source")


@query("with r as (select doc_id, source, row_number() over (partition by source order by n_chars desc, doc_id) as turn from documents) select doc_id, source, turn from r order by turn, source limit 500")
def round_robin(t: Tables) -> DataFrame:
    """Sources in turns, the first 500 rows."""
    d = t.documents.select("doc_id", "source", "n_chars")
    return R.round_robin(d, "source", [F.desc("n_chars"), F.col("doc_id")], [F.col("source")]).limit(500).select("doc_id", "source", "turn")


@query("with r as (select doc_id, source, row_number() over (partition by source order by doc_id) as rn, greatest(1, count(*) over (partition by source) // 10) as step from documents) select doc_id, source from r where (rn - 1) % step = 0 and (rn - 1) / step < 10")
def stride_sample(t: Tables) -> DataFrame:
    """Ten evenly spaced rows of each source."""
    return R.stride(t.documents.select("doc_id", "source"), [F.col("doc_id")], 10, ["source"]).select("doc_id", "source")


@query("""with c as (select *, case when lang = 'de' then 'north' when lang in ('es', 'fr') then 'south' else 'other' end as domain from documents), r as (select doc_id, domain, row_number() over (partition by domain order by abs(n_chars - 1000), doc_id) as rn from c) select doc_id, domain from r where rn <= 25""")
def quota_topk(t: Tables) -> DataFrame:
    """Twenty-five of each domain, nearest to the wanted length."""
    domain = F.when(F.col("lang") == "de", "north").when(F.col("lang").isin("es", "fr"), "south").otherwise("other")
    return R.top_per_group(t.documents.select("doc_id", domain.alias("domain"), F.abs(F.col("n_chars") - 1000).alias("off")), ["domain"], [F.col("off"), F.col("doc_id")], 25).select("doc_id", "domain")


@query("""with h as (select doc_id from documents join labels using (doc_id) where quality = 1), m as (select doc_id, text from documents where doc_id not in (select doc_id from labels where quality = 1)),
k as (select least((select count(*) from m), floor((select count(*) from h) * 0.5 / 0.5)::bigint) as n), r as (select doc_id, row_number() over (order by sha256(text), doc_id) as rn from m)
select doc_id, 'human' as kind from h union all select doc_id, 'machine' from r, k where rn <= n""")
def mix_ratio(t: Tables) -> DataFrame:
    """Approved rows and as many others as an even share takes."""
    good = t.labels.where("quality = 1").select("doc_id")
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("h"))
    human, machine = d.join(good, "doc_id", "left_semi").withColumn("kind", F.lit("human")), d.join(good, "doc_id", "left_anti").withColumn("kind", F.lit("machine"))
    _, m = R.mix_ratio(human.count(), machine.count(), 0.5)
    return human.union(C.first_rows(machine, F.struct("h", "doc_id"), m)).select("doc_id", "kind")


@query("""with d as (select doc_id, md5(text) as k, case when quality = 1 and toxic = 0 then 0 when quality = 1 then 1 else 2 end as tier from documents left join labels using (doc_id)),
f as (select *, min(tier) over (partition by k) as best from d) select doc_id, tier, case when tier = 0 then 'core' when best < tier then 'quarantine' when tier = 1 then 'review' else 'pool' end as route from f""")
def tier_merge(t: Tables) -> DataFrame:
    """Routes: core is canonical, lower tiers of a core text are quarantined, the rest is reviewed or pooled."""
    tier = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 0).when(F.col("quality") == 1, 1).otherwise(2)
    d = t.documents.join(t.labels, "doc_id", "left").select("doc_id", F.md5("text").alias("k"), tier.alias("tier"))
    best = d.groupBy("k").agg(F.min("tier").alias("best"))
    route = F.when(F.col("tier") == 0, "core").when(F.col("best") < F.col("tier"), "quarantine").when(F.col("tier") == 1, "review").otherwise("pool")
    return d.join(best, "k").select("doc_id", "tier", route.alias("route"))


@query("""with g as (select md5(text) as k, min(lang) as v from documents where source in ('src0', 'src1') group by 1), p as (select md5(text) as k, min(lang) as v from documents where source not in ('src0', 'src1') group by 1)
select k, v, 'gold' as shard from g union all select k, v, 'replay' from p where k not in (select k from g)""")
def combine_shards(t: Tables) -> DataFrame:
    """Gold and what replay adds to it."""
    d = t.documents.withColumn("k", F.md5("text"))
    gold = d.where(F.col("source").isin("src0", "src1")).groupBy("k").agg(F.min("lang").alias("v")).withColumn("shard", F.lit("gold"))
    replay = d.where(~F.col("source").isin("src0", "src1")).groupBy("k").agg(F.min("lang").alias("v")).withColumn("shard", F.lit("replay"))
    return C.combine_shards(gold, replay, "k", "v")[0]


@query("select doc_id, (case when quality = 1 then 6 else 1 end)::bigint as copies from documents join labels using (doc_id)", name="union_mix")
def union_mix(t: Tables) -> DataFrame:
    """Shards with weights: approved rows six times, others once, counted."""
    d = t.documents.join(t.labels, "doc_id").select("doc_id", "quality")
    rows = R.weighted_union([(d.where("quality = 1"), 6), (d.where("quality <> 1"), 1)])
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("copies"))


@query("select count(*) as n_rows, count(distinct text) as n_unique, min(n_chars) as shortest, max(n_chars) as longest from documents")
def sink_manifest(t: Tables) -> DataFrame:
    """Counts of a corpus for its manifest."""
    return t.documents.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("text").alias("n_unique"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"))


@query("with r as (select doc_id, row_number() over (order by doc_id) as rn from documents) select doc_id, 'candidate_' || lpad(((rn - 1) // 100)::varchar, 3, '0') as shard from r", name="sink_shards")
def sink_shards(t: Tables) -> DataFrame:
    """Shards of 100 rows; numbers come from a range partitioning's counts, not from one sorted task."""
    from quillspark.sources.sinks import shard_numbers

    return shard_numbers(t.documents.select("doc_id"), "doc_id", 100).select("doc_id", F.concat(F.lit("candidate_"), F.lpad(F.col("shard").cast("string"), 3, "0")).alias("shard"))


TERMS = (("the", "the", None), ("der", "die", "das"), ("les", "les", "des"), ("que", "que", None))
TERMS_SQL = "(values ('the', 'the', null), ('der', 'die', 'das'), ('les', 'les', 'des'), ('que', 'que', null)) as terms(term, good, wrong)"


@query(f"select doc_id, term from documents join {TERMS_SQL} on contains(text, term)")
def join_substring_terms(t: Tables) -> DataFrame:
    """Terms contained in each text."""
    return t.documents.select("doc_id", F.explode(F.filter(F.array(*(F.lit(x[0]) for x in TERMS)), lambda w: F.contains(F.col("text"), w))).alias("term"))


@query(f"select doc_id, sum((contains(text, term) and contains(lower(text), good) and not coalesce(contains(lower(text), wrong), false))::int)::int as ok, sum(contains(text, term)::int)::int as applicable from documents, {TERMS_SQL} group by 1")
def adherence(t: Tables) -> DataFrame:
    """Terms that apply to a text and those it keeps."""
    from quillspark.functions.glossary import adherence as measure

    ok, applicable = measure(F.col("text"), F.col("text"), TERMS)
    return t.documents.select("doc_id", ok.alias("ok"), applicable.alias("applicable"))


@query("""with d as (select doc_id, text, length(text) as n, (length(text) - length(replace(text, '!', ''))) as exclaims, len(regexp_extract_all(text, '[#$%&|*]')) as junk, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) as n_lines,
len(list_filter(string_split(text, chr(10)), lambda x: length(x) - length(replace(x, '!', '')) > 2)) as loud from documents)
select doc_id, ((exclaims > 0)::int + (junk > 0)::int + (loud > 0)::int + (contains(text, '**'))::int + (n_lines > 40)::int)::int as lint from d""")
def lint_score(t: Tables) -> DataFrame:
    """Number of warnings a text gets."""
    x = F.col("text")
    loud = F.size(F.filter(F.split(x, "\n"), lambda p: X.str_count(p, "!") > 2)) > 0
    rules = [X.str_count(x, "!") > 0, x.rlike("[#$%&|*]"), loud, F.contains(x, F.lit("**")), F.size(X.lines(x)) > 40]
    return t.documents.select("doc_id", sum((r.cast("int") for r in rules), F.lit(0)).alias("lint"))


@query("""with p as (select conv_id, turn, text as s, lead(text) over (partition by conv_id order by turn) as o from conversations), q as (select conv_id, turn, length(o) * 1.0 / greatest(1, length(s)) as r, len(list_filter(string_split(s, chr(10)), lambda x: trim(x) <> '')) as a, len(list_filter(string_split(o, chr(10)), lambda x: trim(x) <> '')) as b from p where o is not null)
select conv_id, turn, greatest(0, least(100, 100 - case when r < 0.55 then 18 when r < 0.75 then 8 when r > 4.5 then 15 when r > 3.8 then 7 else 0 end - case when a >= 8 and b < 0.55 * a then 12 else 0 end))::int as score from q""")
def soft_score(t: Tables) -> DataFrame:
    """Soft score of a pair: penalties for length and lost lines."""
    o = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    p = t.conversations.select("conv_id", "turn", F.col("text").alias("s"), o.alias("o")).where("o is not null")
    r, a, b = F.length("o") * 1.0 / F.greatest(F.lit(1), F.length("s")), F.size(X.lines(F.col("s"))), F.size(X.lines(F.col("o")))
    off = F.when(r < 0.55, 18).when(r < 0.75, 8).when(r > 4.5, 15).when(r > 3.8, 7).otherwise(0) + F.when((a >= 8) & (b < 0.55 * a), 12).otherwise(0)
    return p.select("conv_id", "turn", F.greatest(F.lit(0), F.least(F.lit(100), 100 - off)).alias("score"))


@query("""with d as (select doc_id, len(regexp_extract_all(text, '[#$%&|*]')) * 1.0 / greatest(1, length(text)) as junk, n_chars * 1.0 / 1000 as r, (length(text) - length(replace(text, chr(10), ''))) as breaks from documents)
select doc_id, round(junk * 100 + greatest(0, 1.5 - r) * 20 + (r > 5)::int * 20 + (breaks = 0)::int * 30, 6) as badness from d where round(junk * 100 + greatest(0, 1.5 - r) * 20 + (r > 5)::int * 20 + (breaks = 0)::int * 30, 6) >= 10""")
def badness_score(t: Tables) -> DataFrame:
    """Texts with a badness of 10 or more."""
    x, r = F.col("text"), F.col("n_chars") / 1000.0
    bad = X.count_matches(x, "[#$%&|*]") / F.greatest(F.lit(1), F.length(x)) * 100 + F.greatest(F.lit(0.0), 1.5 - r) * 20 + (r > 5).cast("int") * 20 + (X.str_count(x, "\n") == 0).cast("int") * 30
    return t.documents.select("doc_id", F.round(bad, 6).alias("badness")).where("badness >= 10")


@query("""with h as (select conv_id, turn, text, 10 * len(regexp_extract_all(text, '[#$%&|*]')) + 4 * (length(text) - length(replace(text, '!', ''))) + abs((length(text) - length(replace(text, '.', ''))) - 2) as penalty from conversations where role = 'assistant'),
r as (select *, row_number() over (partition by conv_id order by penalty, turn) as rn from h) select conv_id, turn, penalty::int as penalty from r where rn = 1""")
def nbest_argmin(t: Tables) -> DataFrame:
    """The answer of least penalty; the first wins ties."""
    x = F.col("text")
    penalty = 10 * X.count_matches(x, "[#$%&|*]") + 4 * X.str_count(x, "!") + F.abs(X.str_count(x, ".") - 2)
    h = t.conversations.where("role = 'assistant'").groupBy("conv_id").agg(F.min(F.struct(penalty.alias("penalty"), "turn")).alias("m"))
    return h.select("conv_id", "m.turn", "m.penalty")


@query("""select lang, count(*) as n, round(avg(n_chars), 4) as mean_chars, sum(length(text) - length(replace(text, chr(10), '')))::bigint as n_breaks, sum(len(regexp_extract_all(text, '[0-9]')))::bigint as n_digits, count(*) filter (n_chars > 5000) as n_outliers from documents group by 1""")
def agg_eval_summary(t: Tables) -> DataFrame:
    """Counts and means of measures by group."""
    x = F.col("text")
    return t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.sum(X.str_count(x, "\n")).cast("long").alias("n_breaks"), F.sum(X.count_matches(x, "[0-9]")).cast("long").alias("n_digits"), F.count_if(F.col("n_chars") > 5000).alias("n_outliers"))


@query("""with p as (select a.doc_id as a, b.doc_id as b, a.text as s, b.text as o from documents a join documents b on b.doc_id = a.doc_id + 1) select a, b from p where s <> o""")
def changed_outputs(t: Tables) -> DataFrame:
    """Rows in which two variants differ."""
    b = t.documents.select((F.col("doc_id") - 1).alias("a"), F.col("doc_id").alias("b"), F.col("text").alias("o"))
    return t.documents.select(F.col("doc_id").alias("a"), "text").join(b, "a").where("text <> o").select("a", "b")


@query("""select doc_id, count(*) filter (regexp_matches(p, '"') and (length(p) - length(replace(p, '"', ''))) % 2 = 1) as bad_paragraphs, count(*) as n_paragraphs from (select doc_id, unnest(string_split(text, chr(10))) as p from documents) group by 1""")
def bad_quote_paragraphs(t: Tables) -> DataFrame:
    """Paragraphs with unbalanced quotes."""
    parts = F.split("text", "\n")
    return t.documents.select("doc_id", F.size(F.filter(parts, lambda p: ~X.quotes_balanced(p, ()))).cast("long").alias("bad_paragraphs"), F.size(parts).cast("long").alias("n_paragraphs"))


@query("select conv_id, max(turn) - min(turn) + 1 = count(*) as contiguous, max(text) filter (turn = 0) is not null as has_first from conversations group by 1")
def toc_contiguous(t: Tables) -> DataFrame:
    """Whether a group's numbers have no gap and begin at the first."""
    return t.conversations.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 == F.count(F.lit(1))).alias("contiguous"), F.max(F.when(F.col("turn") == 0, F.col("text"))).isNotNull().alias("has_first"))


@query()
def near_dup(t: Tables) -> DataFrame:
    """Pairs of texts with a shared 4-gram and a matching-block ratio of 0.92."""
    return C.near_duplicate_pairs(C.line_table(t.documents).select(F.concat_ws("-", "doc_id", "pos").alias("k"), "line"), "k", "line")


@query()
def chunk_pack(t: Tables) -> DataFrame:
    """Paragraphs packed into chunks of at most 2,000 characters."""
    return t.documents.select("doc_id", F.posexplode(X.chunk_pack(F.split("text", "\n"), 2000)).alias("chunk", "body")).select("doc_id", "chunk", F.length("body").alias("n_chars"))


@query()
def sentence_split(t: Tables) -> DataFrame:
    """Sentences and clauses of at most 120 characters."""
    return t.documents.select("doc_id", F.posexplode(X.split_sentences("text")).alias("nth", "part")).select("doc_id", "nth", F.length("part").alias("n_chars"))


@query()
def similarity_pairs(t: Tables) -> DataFrame:
    """Matching-block ratio of an assistant's answer and the question before."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    p = t.conversations.select("conv_id", "turn", "role", "text", before.alias("asked")).where("role = 'assistant' and asked is not null")
    return p.select("conv_id", "turn", F.round(X.similarity("asked", "text"), 6).alias("ratio"))


@query()
def json_repair(t: Tables) -> DataFrame:
    """Objects cut behind their first value, closed again."""
    cut = F.expr("substring(props, 1, length(props) - 1)")
    return t.events.select("event_id", X.repair_json(cut).alias("props"))


@query()
def greedy_cover(t: Tables) -> DataFrame:
    """Documents of each source that together cover most types of text."""
    return C.greedy_cover(t.documents.select("source", "doc_id", _tags().alias("tags")), "source", "tags", "doc_id", 5, ("number",))

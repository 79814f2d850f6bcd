"""Further shapes: gates on attributes, terms, priorities, quotas, templates, states and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import lint as L
from quillspark.functions import style as S
from quillspark.functions import text as X
from quillspark.functions.glossary import contained
from quillspark.operators import corpus as C
from quillspark.operators import frames as R
from quillspark.operators import gates as G
from quillspark.plans.registry import Tables, query


@query("""select p_partkey, case when list_contains(['PROMO', 'ECONOMY'], p_type) and not (contains(p_name, 'red') or contains(p_name, 'blue')) then 'blocked_category' when contains(p_name, 'bolt') then 'blocked_text' end as verdict from part""")
def genre_gate(t: Tables) -> DataFrame:
    """Blocked categories unless a strong keyword allows them, then blocked words."""
    allowed = F.exists(F.array(F.lit("red"), F.lit("blue")), lambda k: F.contains(F.col("p_name"), k))
    return t.part.select("p_partkey", G.first_reason([("blocked_category", F.col("p_type").isin("PROMO", "ECONOMY") & ~allowed), ("blocked_text", F.contains("p_name", F.lit("bolt")))]).alias("verdict"))


@query("""with c as (select l_partkey, count(*) as n from lineitem group by 1) select p_partkey, coalesce(n, 0) as n, p_brand <> 'Brand#1' or coalesce(n, 0) > 25 as admitted, p_size < 40 and coalesce(n, 0) < 25 as hidden from part left join c on l_partkey = p_partkey""")
def source_policy_thin(t: Tables) -> DataFrame:
    """A source that needs more chapters than others, and thin entries hidden until they grow."""
    c = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return t.part.join(c, "p_partkey", "left").select("p_partkey", n.alias("n"), ((F.col("p_brand") != "Brand#1") | (n > 25)).alias("admitted"), ((F.col("p_size") < 40) & (n < 25)).alias("hidden"))


@query("""select code, case when code in (408, 425, 429) or code >= 500 then 'transient' when code >= 400 then 'permanent' else 'ok' end as kind, count(*) as n from (select (200 + (floor(value)::bigint % 4) * 100 + event_id % 30)::bigint as code from events) group by 1, 2""")
def transient_error_class(t: Tables) -> DataFrame:
    """Status codes by whether a retry can help."""
    code = (200 + (F.expr("cast(floor(value) as bigint)") % 4) * 100 + F.col("event_id") % 30).alias("code")
    kind = F.when(F.col("code").isin(408, 425, 429) | (F.col("code") >= 500), "transient").when(F.col("code") >= 400, "permanent").otherwise("ok")
    return t.events.select(code).groupBy("code", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""select a.o_orderkey, b.l_partkey from orders a join lineitem b on a.o_orderkey = b.l_orderkey and b.l_linenumber = 1 where a.o_orderstatus = 'F' and a.o_custkey <> b.l_suppkey""")
def join_failed_to_toc(t: Tables) -> DataFrame:
    """Failed rows whose id differs from the listed one at their place."""
    b = t.lineitem.where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_suppkey")
    return t.orders.where("o_orderstatus = 'F'").join(b, "o_orderkey").where("o_custkey <> l_suppkey").select("o_orderkey", "l_partkey")


@query("""select distinct a.w as base, b.w as term from (select distinct unnest(string_split(p_name, ' ')) as w from part) a join (select distinct p_name as w from part) b on contains(b.w, a.w) and a.w <> b.w""")
def join_term_in_term(t: Tables) -> DataFrame:
    """Terms inside longer terms, by bigrams."""
    names = t.part.select(F.col("p_name").alias("term")).distinct()
    words = names.select(F.explode(F.split("term", " ")).alias("base")).distinct()
    return contained(words, "base", names, "term").where("base <> term").select("base", "term")


@query("""with w as (select event_type, ts::date as day, count(*) as n, list_sort(list(value)) as v, max(value) as worst from events group by 1, 2),
d as (select event_type, day, n, v[least(n - 1, floor(0.5 * n)::bigint) + 1] as p50, v[least(n - 1, floor(0.95 * n)::bigint) + 1] as p95 from w) select event_type, round(avg(p50), 6) as avg_p50, max(p95) as worst_p95, sum(n)::bigint as n from d group by 1""")
def agg_latency_day(t: Tables) -> DataFrame:
    """Days rolled up: mean median, worst 95th percentile, calls."""
    calls = t.events.select("event_type", F.to_date("ts").alias("day"), "value")
    d = calls.groupBy("event_type", "day").agg(F.count(F.lit(1)).alias("n"))
    d = d.join(R.index_percentiles(calls, ["event_type", "day"], "value", {"p50": 0.5, "p95": 0.95}), ["event_type", "day"])
    return d.groupBy("event_type").agg(F.round(F.avg("p50"), 6).alias("avg_p50"), F.max("p95").alias("worst_p95"), F.sum("n").alias("n"))


@query("""select source, count(*) as n, round(avg(n_chars / 1000.0), 6) as mean_ratio, sum((len(regexp_extract_all(text, '[#$%&|]')) > 0)::int)::bigint as n_junk, sum(((length(text) - length(replace(text, chr(10), ''))) = 0)::int)::bigint as n_flat from documents group by 1""")
def agg_quality_by_model(t: Tables) -> DataFrame:
    """Quality measures by group."""
    x = F.col("text")
    return t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("n_chars") / 1000.0), 6).alias("mean_ratio"), F.count_if(x.rlike("[#$%&|]")).alias("n_junk"), F.count_if(X.str_count(x, "\n") == 0).alias("n_flat"))


@query("""with s as (select o_custkey, unnest([l_partkey, l_suppkey]) as item from orders join lineitem on o_orderkey = l_orderkey where o_orderstatus = 'P') select o_custkey, coalesce(sum(p_size), 0)::bigint as bonus from s left join part on item = p_partkey group by 1""")
def agg_slot_sum(t: Tables) -> DataFrame:
    """Sum of the values of what fills an owner's slots."""
    s = t.orders.where("o_orderstatus = 'P'").join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", F.explode(F.array("l_partkey", "l_suppkey")).alias("p_partkey"))
    return s.join(t.part.select("p_partkey", "p_size"), "p_partkey", "left").groupBy("o_custkey").agg(F.coalesce(F.sum("p_size"), F.lit(0)).alias("bonus"))


@query("""select lang, w as term, count(*) as n from (select lang, unnest(string_split_regex(lower(regexp_replace(text, '"[^"\\n]*"', ' ', 'g')), '[^a-zà-ÿ]+')) as w from documents) where w in ('he', 'she', 'il', 'elle', 'er', 'sie', 'el') group by 1, 2""")
def agg_narrator_by_novel(t: Tables) -> DataFrame:
    """Pronouns outside dialogue by group."""
    words = F.split(F.lower(F.regexp_replace("text", r'"[^"\n]*"', " ")), "[^a-zà-ÿ]+")
    return t.documents.select("lang", F.explode(words).alias("term")).where(F.col("term").isin("he", "she", "il", "elle", "er", "sie", "el")).groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n"))


@query("""select scheme, sum(n)::bigint as expected, sum(least(n, m))::bigint as restorable, sum(greatest(n - m, 0))::bigint as lost, sum(greatest(m - n, 0))::bigint as overgenerated from
(select s.scheme, len(regexp_extract_all(text, s.a)) as n, len(regexp_extract_all(text, s.b)) as m from documents, (values ('upper', '[A-Z]', '[.]'), ('mark', '[,]', '[;]')) s(scheme, a, b)) group by 1""")
def agg_scheme_survival(t: Tables) -> DataFrame:
    """Marker schemes: expected, restorable, lost and surplus occurrences."""
    x = F.col("text")
    n, m = F.col("s.n"), F.col("s.m")
    rows = t.documents.select(F.explode(F.array(*(F.struct(F.lit(k).alias("scheme"), X.count_matches(x, a).alias("n"), X.count_matches(x, b).alias("m")) for k, a, b in (("upper", "[A-Z]", "[.]"), ("mark", "[,]", "[;]"))))).alias("s"))
    return rows.groupBy("s.scheme").agg(F.sum(n).alias("expected"), F.sum(F.least(n, m)).alias("restorable"), F.sum(F.greatest(n - m, F.lit(0))).alias("lost"), F.sum(F.greatest(m - n, F.lit(0))).alias("overgenerated"))


@query("""with l as (select conv_id, turn, text, row_number() over (partition by conv_id order by turn desc) as rn from conversations) select conv_id, bool_or(regexp_matches(text, '[.]$')) as complete from l where rn <= 5 group by 1""")
def win_last_k_complete(t: Tables) -> DataFrame:
    """Whether one of a group's last five rows matches an ending."""
    last = R.top_per_group(t.conversations, ["conv_id"], [F.desc("turn")], 5)
    return last.groupBy("conv_id").agg(F.max(F.col("text").rlike(r"[.]\z")).alias("complete"))


@query("select doc_id, md5(right(text, 350)) as tail_md5, length(right(text, 350)) as n from documents")
def win_tail(t: Tables) -> DataFrame:
    """The last 350 characters."""
    tail = F.right(F.col("text"), F.lit(350))
    return t.documents.select("doc_id", F.md5(tail).alias("tail_md5"), F.length(tail).alias("n"))


@query("""with k as (select user_id, event_id, -ln((('0x' || substr(md5(event_id::varchar), 1, 8))::bigint + 1) / 4294967297.0) / (value + 1) as key from events) select user_id, arg_min(event_id, key) as picked from k group by 1""")
def sample_weighted(t: Tables) -> DataFrame:
    """One row a group with a chance in proportion to its weight; the uniform draw is a hash."""
    u = (F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 8), 16, 10).cast("double") + 1) / 4294967297.0
    return t.events.select("user_id", "event_id", (-F.log(u) / (F.col("value") + 1)).alias("key")).groupBy("user_id").agg(F.min_by("event_id", "key").alias("picked"))


@query("""with r as (select doc_id, source, row_number() over (partition by source order by (contains(text, '"'))::int desc, n_chars desc, doc_id) as rn from documents) select source, doc_id from r where rn = 1""")
def best_per_chapter(t: Tables) -> DataFrame:
    """The best row a group by flags, then length."""
    order = [F.desc(F.contains("text", F.lit('"')).cast("int")), F.desc("n_chars"), F.col("doc_id")]
    return R.first_by(t.documents, ["source"], order).select("source", "doc_id")


@query("""with d as (select md5(text) as k, doc_id, source, row_number() over (partition by md5(text) order by (source = 'src3') desc, doc_id) as rn from documents) select k, doc_id, source from d where rn = 1""")
def dedup_prefer(t: Tables) -> DataFrame:
    """One row a text, of the preferred source if there is one."""
    return R.first_by(t.documents.withColumn("k", F.md5("text")), ["k"], [F.desc(F.col("source") == "src3"), F.col("doc_id")]).select("k", "doc_id", "source")


@query("""with c as (select doc_id, md5(text) as k, source, n_chars from documents), e as (select distinct md5(text) as k from benchmark), r as (select *, count(distinct source) over (partition by k) as ns, row_number() over (partition by k order by doc_id) as rn from c)
select doc_id, case when k in (select k from e) then 'evaluation' when ns > 1 then 'conflict' when rn > 1 then 'duplicate' when n_chars < 100 then 'short' else 'kept' end as route from r""".replace("count(distinct source) over (partition by k)", "(select count(distinct source) from c c2 where c2.k = c.k)"))
def candidate_merge(t: Tables) -> DataFrame:
    """Inputs merged: evaluation texts, conflicts and duplicates told apart from what is kept."""
    c = t.documents.withColumn("k", F.md5("text"))
    per = c.groupBy("k").agg(F.countDistinct("source").alias("ns"), F.min("doc_id").alias("first"))
    e = t.benchmark.select(F.md5("text").alias("k")).distinct().withColumn("locked", F.lit(True))
    route = F.when(F.col("locked"), "evaluation").when(F.col("ns") > 1, "conflict").when(F.col("doc_id") > F.col("first"), "duplicate").when(F.col("n_chars") < 100, "short").otherwise("kept")
    return c.join(per, "k").join(e, "k", "left").select("doc_id", route.alias("route"))


@query("select r_name || ' / ' || n_name || ' / ' || s as pair from region, nation, (values ('rises'), ('falls')) v(s)")
def cartesian_templates(t: Tables) -> DataFrame:
    """Products of small slot tables; both are dimensions of a few rows."""
    slots = t.spark.createDataFrame([("rises",), ("falls",)], "s string")
    return t.region.crossJoin(t.nation).crossJoin(slots).select(F.concat_ws(" / ", "r_name", "n_name", "s").alias("pair"))


@query("""select user_id, event_id, n_tries, case when event_type = 'purchase' then 'done' when event_type = 'error' and n_tries >= 3 then 'failed' when event_type = 'error' then 'retry' when value < 1 then 'too_short' else 'pending' end as state from
(select user_id, event_id, event_type, value, count(*) filter (event_type = 'error') over (partition by user_id order by ts, event_id) as n_tries from events)""")
def candidate_fsm(t: Tables) -> DataFrame:
    """State of each candidate after its event."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    tries = F.count(F.when(F.col("event_type") == "error", 1)).over(w)
    state = F.when(F.col("event_type") == "purchase", "done").when((F.col("event_type") == "error") & (F.col("n_tries") >= 3), "failed").when(F.col("event_type") == "error", "retry").when(F.col("value") < 1, "too_short").otherwise("pending")
    return t.events.withColumn("n_tries", tries).select("user_id", "event_id", "n_tries", state.alias("state"))


@query("""with r as (select p_partkey, p_size, row_number() over (order by p_retailprice desc, p_partkey) as rank from part where p_size > 20) select p_partkey, rank from r where rank <= 100 and rank <> p_size""")
def ranking_refresh(t: Tables) -> DataFrame:
    """New ranks of the first hundred that differ from the stored ones."""
    top = t.part.where("p_size > 20").orderBy(F.desc("p_retailprice"), "p_partkey").limit(100)
    r = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("p_retailprice"), "p_partkey")))
    return r.where("rank <> p_size").select("p_partkey", "rank")


@query("""(select o_orderkey, 'ongoing' as kind from orders where o_orderstatus = 'O' order by o_orderdate, o_orderkey limit 90) union all (select o_orderkey, 'completed' from orders where o_orderstatus = 'F' order by o_orderdate, o_orderkey limit 10)""")
def refresh_budget(t: Tables) -> DataFrame:
    """Ninety ongoing and ten completed, longest unchecked first."""
    take = lambda s, kind, n: t.orders.where(F.col("o_orderstatus") == s).orderBy("o_orderdate", "o_orderkey").limit(n).select("o_orderkey", F.lit(kind).alias("kind"))
    return take("O", "ongoing", 90).union(take("F", "completed", 10))


@query("select event_id, user_id, value from events where ts > (select min(ts) + interval 20 day from events) and value > 50")
def audit_incremental(t: Tables) -> DataFrame:
    """Rows since a watermark that fail a gate."""
    mark = t.events.agg(F.min("ts").alias("m")).scalar() + F.expr("interval 20 days")
    return t.events.where((F.col("ts") > mark) & (F.col("value") > 50)).select("event_id", "user_id", "value")


@query("select l_partkey as novel, count(*) filter (l_returnflag = 'R') as version, max(l_shipdate) filter (l_returnflag = 'R') as changed_at from lineitem group by 1")
def glossary_version(t: Tables) -> DataFrame:
    """Counters that writes bump, from the changes."""
    hit = F.col("l_returnflag") == "R"
    return t.lineitem.groupBy(F.col("l_partkey").alias("novel")).agg(F.count_if(hit).alias("version"), F.max(F.when(hit, F.col("l_shipdate"))).alias("changed_at"))


@query("select doc_id, md5(replace(text, ' the ', ' THE ')) as new_md5 from documents where replace(text, ' the ', ' THE ') <> text")
def edit_audit(t: Tables) -> DataFrame:
    """History rows of a replacement: only texts it changes."""
    new = X.replace_all(F.col("text"), [(" the ", " THE ")])
    return t.documents.where(new != F.col("text")).select("doc_id", F.md5(new).alias("new_md5"))


@query("""with g as (select l_partkey as novel, l_suppkey as term, l_orderkey, (l_returnflag = 'A') as approved, l_quantity as hits from lineitem), r as (select *, row_number() over (partition by novel, term order by approved desc, hits desc, l_orderkey) as rn from g where approved or hits >= 10)
select novel, term, approved, hits from r where rn = 1""")
def resolve_glossary(t: Tables) -> DataFrame:
    """Terms of a novel: approved ones first, then safe pending ones by hits; one row a term."""
    g = t.lineitem.select(F.col("l_partkey").alias("novel"), F.col("l_suppkey").alias("term"), "l_orderkey", (F.col("l_returnflag") == "A").alias("approved"), F.col("l_quantity").alias("hits")).where("approved or hits >= 10")
    return R.first_by(g, ["novel", "term"], [F.desc("approved"), F.desc("hits"), F.col("l_orderkey")]).select("novel", "term", "approved", "hits")


@query("""select l_orderkey, l_linenumber, l_returnflag, case when l_returnflag = 'A' then 'keep' when l_tax > 0.06 then 'drop' when l_discount > 0.05 then 'fix' when l_quantity < 10 then 'flag' else 'clear' end as action, count(*)::bigint as n from lineitem where l_shipdate >= timestamp '1997-01-01' group by 1, 2, 3, 4""")
def sweep_glossary(t: Tables) -> DataFrame:
    """Action for each unapproved term since a watermark."""
    action = F.when(F.col("l_returnflag") == "A", "keep").when(F.col("l_tax") > 0.06, "drop").when(F.col("l_discount") > 0.05, "fix").when(F.col("l_quantity") < 10, "flag").otherwise("clear")
    rows = t.lineitem.where(F.col("l_shipdate") >= F.expr("timestamp '1997-01-01'")).withColumn("action", action)
    return rows.groupBy("l_orderkey", "l_linenumber", "l_returnflag", "action").agg(F.count(F.lit(1)).alias("n"))


@query("""select doc_id, case when len(regexp_extract_all(substr(text, 1, n_chars // 2), '[aeiou]')) < len(regexp_extract_all(substr(text, n_chars // 2 + 1), '[aeiou]')) then 'swapped' else 'kept' end as orientation from documents""")
def orient_pair(t: Tables) -> DataFrame:
    """Which half has more of a class: sides are swapped accordingly."""
    half = F.expr("cast(n_chars div 2 as int)")
    left, right = F.substr("text", F.lit(1), half), F.substr("text", half + 1)
    return t.documents.select("doc_id", F.when(X.count_matches(left, "[aeiou]") < X.count_matches(right, "[aeiou]"), "swapped").otherwise("kept").alias("orientation"))


@query("""with x as (select doc_id, lang, sha256(text) as h, row_number() over (partition by sha256(text) order by doc_id) as rn from documents), k as (select * from x where rn = 1 and h not in (select sha256(text) from benchmark)), r as (select doc_id, lang, row_number() over (order by h) as n, count(*) over () as total from k)
select doc_id, case when n <= least(60, total // 20) then 'holdout' else 'train' end as split from r""")
def holdout_tail(t: Tables) -> DataFrame:
    """Training and held-out texts: unique, not locked, the first by hash held out."""
    d = R.first_by(t.documents.select("doc_id", F.sha2("text", 256).alias("h")), ["h"], [F.col("doc_id")]).join(t.benchmark.select(F.sha2("text", 256).alias("h")), "h", "left_anti")
    train, held = C.holdout(d, "h", F.col("h"), 60)
    return train.select("doc_id", F.lit("train").alias("split")).union(held.select("doc_id", F.lit("holdout")))


@query("""with q as (select doc_id, source, quality from documents join labels using (doc_id)), a as (select source, count(*) as n, count(*) filter (quality = 1) as ok from q group by 1) select source, n, ok, round(ok * 1.0 / n, 6) as share, ok * 1.0 / n >= 0.8 as passed from a""")
def name_accuracy(t: Tables) -> DataFrame:
    """Right answers of all expected ones by model."""
    a = t.documents.join(t.labels, "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("ok"))
    return a.select("source", "n", "ok", F.round(F.col("ok") / F.col("n"), 6).alias("share"), (F.col("ok") / F.col("n") >= 0.8).alias("passed"))


@query("""select count(*) as n_items, count(*) = 40 or count(*) = 200 as size_ok, count(distinct text) = count(*) as unique_ok, min(length(text)) > 0 as filled_ok from benchmark""")
def eval_suite_validate(t: Tables) -> DataFrame:
    """Invariants of the locked evaluation set."""
    n = F.count(F.lit(1))
    return t.benchmark.agg(n.alias("n_items"), ((n == 40) | (n == 200)).alias("size_ok"), (F.countDistinct("text") == n).alias("unique_ok"), (F.min(F.length("text")) > 0).alias("filled_ok"))


@query()
def style_best_of(t: Tables) -> DataFrame:
    """The least penalised of a conversation's answers, against its first question."""
    q = t.conversations.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("q"))
    a = t.conversations.where("role = 'assistant'").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("a"))
    return q.join(a, "conv_id").select("conv_id", F.md5(S.best_of(F.col("q"), F.transform("a", lambda x: x["text"]))).alias("best_md5"))


@query()
def style_scores(t: Tables) -> DataFrame:
    """Quality score and badness of each text against the text before it."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    p = t.conversations.select("conv_id", "turn", "text", before.alias("s")).where("s is not null")
    return p.select("conv_id", "turn", S.quality_score(F.col("s"), F.col("text")).alias("score"), F.round(S.badness(F.col("s"), F.col("text"), F.lit(1.0)), 6).alias("badness"))


@query("""select conv_id, turn, (regexp_matches(text, '(?m)\\*\\*|^#{1,3}\\s|```')::int + regexp_matches(text, '(?i)\\b(cough|sigh|ahem|gasp|hmph|tsk)\\b')::int + regexp_matches(text, '[a-zà-ỹ][A-ZĐ][a-zà-ỹ]')::int + regexp_matches(text, '\\b[A-ZĐ][a-zà-ỹ]+(-[a-zà-ỹ]+){2,}\\b')::int
+ regexp_matches(text, '[āēīōūǖǎěǐǒǔǘǚǜ]')::int + (len(list_filter(string_split(text, chr(10)), lambda x: length(x) - length(replace(x, '!', '')) > 2)) > 0)::int)::int as n_warnings from conversations where text is not null""")
def lint_warnings(t: Tables) -> DataFrame:
    """Warnings of each turn; the SQL has the rules that texts without the target language can break."""
    return t.conversations.where("text is not null").select("conv_id", "turn", F.size(L.lint_warnings(F.col("text"))).alias("n_warnings"))

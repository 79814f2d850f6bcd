"""Queries of the candidate queue over all events: a user is a source, users' events of one remainder are a candidate's outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import repair as P
from quillspark.operators import candidates as C
from quillspark.plans.registry import Tables, query

KINDS = {"error": "failed", "purchase": "done", "signup": "rejected", "click": "too_short"}
OUTCOME_SQL = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in KINDS.items()) + " else case when value < 2 then 'blocked' else 'failed' end end"
EVENTS_SQL = f"with e as (select user_id as source, event_id % 7 as candidate, ts, event_id as nth, {OUTCOME_SQL} as outcome from events where user_id is not null), t as (select * from e where outcome <> 'blocked')"
STATES_SQL = f"""{EVENTS_SQL}, l as (select *, row_number() over (partition by source, candidate order by ts desc, nth desc) as back, count(*) filter (outcome in ('done', 'too_short', 'failed')) over (partition by source, candidate) as attempts from t),
c as (select source, candidate, min(ts) as created_at, (candidate * 3 + source) % 4 as priority from e group by 1, 2),
s as (select c.*, coalesce(l.outcome, 'pending') as status, coalesce(l.attempts, 0)::bigint as attempts, case l.outcome when 'failed' then l.ts + interval 1 hour when 'too_short' then l.ts + interval 168 hour end as retry_after from c left join (select * from l where back = 1) l on c.source = l.source and c.candidate = l.candidate)"""


def outcomes(t: Tables) -> DataFrame:
    kind = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in KINDS.items()), F.when(F.col("value") < 2, "blocked").otherwise("failed"))
    return t.events.where("user_id is not null").select(F.col("user_id").alias("source"), (F.col("event_id") % 7).alias("candidate"), "ts", F.col("event_id").alias("nth"), kind.alias("outcome"))


def candidates(t: Tables) -> DataFrame:
    rows = outcomes(t).groupBy("source", "candidate").agg(F.min("ts").alias("created_at"))
    return rows.withColumn("priority", (F.col("candidate") * 3 + F.col("source")) % 4)


@query(f"{STATES_SQL} select source, candidate, status, attempts, epoch_us(retry_after) as retry_us from s")
def candidate_states(t: Tables) -> DataFrame:
    """Status, attempts and time of the next try of every candidate."""
    done = C.states(candidates(t), outcomes(t), ["source", "candidate"])
    return done.select("source", "candidate", "status", "attempts", F.unix_micros("retry_after").alias("retry_us"))


@query(f"""{STATES_SQL}, d as (select *, case when status = 'pending' then 0 when status in ('failed', 'too_short') and retry_after <= timestamp '2024-01-27' then 1 end as p from s),
r as (select *, row_number() over (partition by source order by p, priority, case p when 0 then created_at else retry_after end, candidate) as nth from d where p is not null) select source, candidate, nth::int as nth, status from r where nth <= 4""")
def candidate_batches(t: Tables) -> DataFrame:
    """The four candidates that each source tries next."""
    done = C.states(candidates(t), outcomes(t), ["source", "candidate"])
    return C.next_batch(done, "source", F.lit("2024-01-27 00:00:00").cast("timestamp"), 4).select("source", "candidate", "nth", "status")


@query(f"""{EVENTS_SQL}, r as (select *, ts::date as day, sum(case when outcome = 'failed' then 0 else 1 end) over (partition by source, ts::date order by nth) as run from e),
n as (select *, count(*) filter (outcome = 'failed') over (partition by source, day, run order by nth) as length from r),
f as (select *, coalesce(max((length >= 3 or outcome = 'blocked')::int) over w, 0) as ended, count(*) filter (outcome = 'done') over w as added from n window w as (partition by source, day order by nth rows between unbounded preceding and 1 preceding))
select source, nth, outcome, ended = 0 and added < 2 and outcome <> 'blocked' as counts from f""")
def candidate_cycles(t: Tables) -> DataFrame:
    """Outcomes that count in a day's cycle: it ends behind three failures in a row, at a block, or with two done."""
    rows = outcomes(t).withColumn("day", F.to_date("ts"))
    return C.cycle_end(rows, ["source", "day"], "nth", most_new=2, failures=3).select("source", "nth", "outcome", "counts")


@query(f"""{EVENTS_SQL}, n as (select *, lead(ts) over w as next, count(*) filter (outcome in ('done', 'too_short', 'failed')) over (partition by source, candidate order by ts, nth rows between unbounded preceding and current row) as attempts from t window w as (partition by source, candidate order by ts, nth)),
d as (select *, case outcome when 'failed' then ts + interval 1 hour when 'too_short' then ts + interval 168 hour end as due from n)
select source, candidate, epoch_us(due) as due_us, outcome, attempts from d where due is not null and (next is null or due <= next)""")
def candidates_due(t: Tables) -> DataFrame:
    """Each time a candidate came up again."""
    rows = C.come_up_again(outcomes(t), ["source", "candidate"])
    return rows.select("source", "candidate", F.unix_micros("due").alias("due_us"), "outcome", "attempts")


@query("""with x as (select p_partkey, lower(p_type) as cats, lower(p_type) || ' ' || lower(p_name) || ' ' || lower(p_brand) || ' ' || lower(split_part(p_name || ' on ' || p_brand, ' on ', 1)) as text from part)
select p_partkey, case when not (contains(text, 'red') or contains(text, 'small')) then case when contains(cats, 'promo') then 'PROMO' when contains(cats, 'econ') then 'Econ' when contains(text, 'bolt') then 'bolt' when contains(text, 'brand#7') then 'Brand#7' end end as hit from x""")
def genre_blocked(t: Tables) -> DataFrame:
    """What blocks a part by its type, name and description up to a cut."""
    about = F.concat("p_name", F.lit(" on "), "p_brand")
    return t.part.select("p_partkey", C.genre_blocked(F.array("p_type"), [F.col("p_name"), F.col("p_brand")], about, ["PROMO", "Econ"], ["bolt", "Brand#7"], ["red", "Small"], " on ").alias("hit"))


@query("""with c as (select l_partkey, count(*) as n, bool_or(l_returnflag = 'R') as hidden from lineitem group by 1), n as (select p_partkey, case when p_size % 5 = 0 then 'completed' else 'ongoing' end as status, coalesce(n, 0) as n, coalesce(hidden, false) as hidden, p_size % 3 = 0 as translated from part left join c on l_partkey = p_partkey)
select p_partkey, case when translated then 'keep' when not hidden and status <> 'completed' and n < 30 then 'hide' when hidden and (status = 'completed' or n >= 30) then 'unhide' else 'keep' end as action from n""")
def visibility(t: Tables) -> DataFrame:
    """Which parts are hidden as thin, and which come back."""
    c = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("l_returnflag") == "R").alias("hidden"))
    status = F.when(F.col("p_size") % 5 == 0, "completed").otherwise("ongoing")
    return t.part.join(c, "p_partkey", "left").select("p_partkey", C.visibility(status, F.col("n"), F.col("hidden"), F.col("p_size") % 3 == 0, 30).alias("action"))


@query("""with s as (select doc_id, regexp_replace(text, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g') as s from documents), h as (select doc_id, s, substr(s, 1, 400) as h from s)
select doc_id, md5(case when s = '' or contains(s, 'ß') then null when length(s) <= 400 then s else regexp_replace(case when regexp_matches(h, '[.!?…]') then regexp_extract(h, '^((?s:.*)[.!?…]["''”’)]*)', 1) else h end, '[ \\t\\n\\r]+$', '') end) as summary_md5 from h""")
def valid_summaries(t: Tables) -> DataFrame:
    """Summaries cut at a sentence end; texts with a letter that stands for leftover script have none."""
    return t.documents.select("doc_id", F.md5(P.valid_summary(F.col("text"), 400, "ß")).alias("summary_md5"))
